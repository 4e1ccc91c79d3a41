"""Session settings and the shared folder that cuts long lineages."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only below this size; beyond it the join shuffles.
BROADCAST_BYTES = 64 * 1024 * 1024


def local_session(cores: int | str = 8, app: str = "layerweave", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster job brings its own."""
    settings = {
        "spark.sql.shuffle.partitions": str(cores) if str(cores).isdigit() else "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        # Small tables still split over all cores of one machine.
        "spark.sql.files.openCostInBytes": str(256 * 1024),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it.

    ``spark.checkpoint.dir`` is authoritative.  Only a local master, where driver and executors
    are one process, falls back to a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    own = tempfile.mkdtemp(prefix="layerweave-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that lost executors never replay a loop."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def keep_table(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and read it from there.

    For large tables that many later steps scan: columnar files are pruned to the columns a step
    needs and tell the planner their size.  Cuts the lineage like ``cut_lineage``.
    """
    path = scratch_path(df.sparkSession, "table")
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_path = path
    return kept


def keep_in_buckets(df: DataFrame, keys: Sequence[str], buckets: int, folders: Sequence[str] = ()) -> DataFrame:
    """Like ``keep_table``, in buckets by ``keys``: a merge join on exactly these keys does not move the table.

    The rows of a bucket should lie in one task already (``repartition(buckets, *keys)``), which makes one file of each.
    """
    path, name = scratch_path(df.sparkSession, "table"), f"kept_{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    kept = df.sparkSession.table(name).select(*df.columns)
    kept._kept_path = path
    return kept


def forget_table(kept: DataFrame) -> None:
    """Delete the files of a table that ``keep_table`` wrote, once all that reads it is stored elsewhere."""
    context = kept.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(kept._kept_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for tables that one job writes and reads back."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
