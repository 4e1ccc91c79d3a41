"""Warehouse tables and graph exports."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that a task fills at the same time; with more it sorts what is left by folder.
OPEN_FOLDERS = 8

def read_table(spark: SparkSession, path: str, kind: str = "parquet", options: Mapping[str, str] | None = None) -> DataFrame:
    """Any Spark data source by name: parquet here, a warehouse connector on a cluster that has one."""
    return spark.read.format(kind).options(**(options or {})).load(path)


def write_table(
    df: DataFrame, path: str, kind: str = "parquet", mode: str = "append", options: Mapping[str, str] | None = None
) -> str:
    df.write.format(kind).options(**(options or {})).mode(mode).save(path)
    return path


@contextmanager
def _open_folders(spark: SparkSession, most: int) -> Iterator[None]:
    """Writes by folder keep so many folders open in a task, where they else sort all rows by folder first."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    if int(before) < most:
        spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def export_layers(vertices: DataFrame, edges: DataFrame, path: str, kind: str = "parquet") -> dict[str, str]:
    """Vertices and edges, one folder per layer: a reader of one layer scans that layer only.

    Rows are written in the order in which they come, so edges are neither sorted nor spilled on the way.
    """
    out = {"vertices": f"{path}/vertices", "edges": f"{path}/edges"}
    with _open_folders(edges.sparkSession, OPEN_FOLDERS):
        vertices.write.mode("overwrite").partitionBy("layer").format(kind).option("header", True).save(out["vertices"])
        edges.write.mode("overwrite").partitionBy("layer").format(kind).option("header", True).save(out["edges"])
    return out


def export_results(tables: Mapping[str, DataFrame | None], path: str, kind: str = "csv", single_file: bool = False) -> dict[str, str]:
    """One folder per named result table (adjacency, community, personality, lambda, input)."""
    out = {}
    for name, df in tables.items():
        if df is None:
            continue
        out[name] = f"{path}/{name}"
        written = df.coalesce(1) if single_file else df
        written.write.mode("overwrite").format(kind).option("header", True).save(out[name])
    return out


def _finished(spark: SparkSession, folder: str) -> bool:
    """Whether a writer has completed the folder; asked of the store that holds it."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def export_as_one(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, version: str, kind: str = "parquet") -> list[str]:
    """Write several tables that belong together: a reader sees all of them or none.

    The tables go to ``path/version``.  When all are there, a commit that names them is written to ``path/commits``; until
    then ``read_export`` does not know the version.  An export that broke off is resumed by the same call: tables that
    were finished stay as they are, half-written ones are written anew.  Returned are the names that were written now.
    """
    if _finished(spark, f"{path}/commits/{version}"):
        return []
    written = []
    for name, df in tables.items():
        folder = f"{path}/{version}/{name}"
        if not _finished(spark, folder):
            df.write.mode("overwrite").format(kind).save(folder)
            written.append(name)
    names = spark.createDataFrame([(name, kind, place) for place, name in enumerate(tables)], "name string, kind string, place int")
    names.coalesce(1).write.mode("overwrite").json(f"{path}/commits/{version}")
    return written


def read_export(spark: SparkSession, path: str, version: str) -> dict[str, DataFrame]:
    """The tables of a committed export; one without its commit is not there."""
    if not _finished(spark, f"{path}/commits/{version}"):
        raise FileNotFoundError(f"no finished export {version} in {path}")
    names = spark.read.schema("name string, kind string, place int").json(f"{path}/commits/{version}").orderBy("place").collect()
    return {r["name"]: spark.read.format(r["kind"]).load(f"{path}/{version}/{r['name']}") for r in names}


def store_nodes(vertices: DataFrame) -> DataFrame:
    """Node rows as a graph store loads them: ``layer, id, label, score, age, sex, country``."""
    return vertices.select(
        "layer", F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("label"),
        F.col("z").cast("float").alias("score"), F.col("age").cast("int").alias("age"), "sex", "country",
    )


def store_edges(edges: DataFrame, weight: str = "fit") -> DataFrame:
    """Relation rows as a graph store loads them: ``layer, src, dst, type, weight``."""
    return edges.select(
        "layer", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"),
        F.lit("INTERLOCK").alias("type"), F.col(weight).cast("float").alias("weight"),
    )
