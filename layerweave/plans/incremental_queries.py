"""Queries: weighted sampling of a tensor, and decompositions that grow slice by slice."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import cp
from layerweave.operators import incremental as I
from layerweave.operators import tensor as T
from layerweave.plans.registry import query
from layerweave.plans.tensor_queries import SALES, sales_tensor
from layerweave.session import scratch_path
from layerweave.streaming.slices import CELLS, SliceStream

_SAMPLE_SIZES = (12, 12, 3)


def _sample_sql(mode: int, name: str) -> str:
    index = T.MODES[mode]
    u = f"((('0x' || substr(md5('0:{mode}:' || {index}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    return (
        f"{name} AS (SELECT idx, row_number() OVER (ORDER BY idx) - 1 AS new FROM (SELECT {index} AS idx, ln({u}) / sum(value * value) AS score "
        f"FROM sales GROUP BY {index} ORDER BY score DESC, idx LIMIT {_SAMPLE_SIZES[mode]}))"
    )


_SAMPLES = ", ".join(_sample_sql(m, f"m{m}") for m in range(3))


@query(
    "slice_weights",
    f"WITH {SALES} " + " UNION ALL ".join(f"SELECT {m} AS mode, {T.MODES[m]} AS idx, round(sum(value * value) / 1000000, 2) AS weight FROM sales GROUP BY ALL" for m in range(3)),
)
def slice_weights(spark, folder):
    """Sum of squares of every slice, along all three modes."""
    tensor = sales_tensor(spark, folder)
    parts = [I.slice_weights(tensor, m).select(F.lit(m).alias("mode"), "idx", F.round(F.col("weight") / 1000000, 2).alias("weight")) for m in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "weighted_sample",
    f"WITH {SALES}, {_SAMPLES} " + " UNION ALL ".join(f"SELECT {m} AS mode, idx, new FROM m{m}" for m in range(3)),
)
def weighted_sample(spark, folder):
    """Indexes drawn with chance by weight, without replacement, along all three modes."""
    tensor = sales_tensor(spark, folder)
    parts = [
        I.weighted_sample(I.slice_weights(tensor, m), _SAMPLE_SIZES[m], 0, m).select(F.lit(m).alias("mode"), "idx", "new")
        for m in range(3)
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "subtensor",
    f"WITH {SALES}, {_SAMPLES} SELECT m0.new AS i, m1.new AS j, m2.new AS k, value FROM sales JOIN m0 ON i = m0.idx JOIN m1 ON j = m1.idx JOIN m2 ON k = m2.idx",
)
def subtensor(spark, folder):
    """The cells of the sampled indexes, renumbered."""
    tensor = sales_tensor(spark, folder)
    maps = [I.weighted_sample(I.slice_weights(tensor, m), _SAMPLE_SIZES[m], 0, m) for m in range(3)]
    return I.restrict(tensor, maps, _SAMPLE_SIZES).cells


def _halves(spark, folder):
    """The tensor of the earlier half of the years, the cells of the later ones, and where they begin."""
    whole = sales_tensor(spark, folder)
    years = max(1, whole.shape[2] // 2)
    return T.Tensor(whole.cells.filter(F.col("k") < years), T.updated(whole.shape, 2, years)), whole.cells, years


def _table(model: cp.CPModel):
    parts = [cp.factor_table(f, "x").withColumn("mode", F.lit(m)) for m, f in zip(T.MODES, model.factors)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("incremental_cp")
def incremental_cp(spark, folder):
    """The sales of the earlier years decomposed, then the later years received as new slices."""
    known, cells, years = _halves(spark, folder)
    later = cells.filter(F.col("k") >= years).withColumn("k", F.col("k") - years)
    state = I.start(known, rank=2, tolerance=0.002)
    state = state.receive(T.Tensor(later, T.updated(known.shape, 2, T.extent(later)[2])))
    return _table(state.model)


@query("streamed_slices")
def streamed_slices(spark, folder):
    """The same growth as a stream of files; a slice that arrives twice is set aside."""
    path, source = scratch_path(spark, "stream"), scratch_path(spark, "arrivals")
    known, cells, years = _halves(spark, folder)
    slices = SliceStream(spark, path, {"tolerance": 0.002})
    slices.seed(I.start(known, rank=2, tolerance=0.002))
    # One arrival: the later years, and the last known year once more.
    cells.filter(F.col("k") >= years - 1).write.parquet(source)
    stream = spark.readStream.schema(CELLS).parquet(source)
    slices.run(stream, f"{path}/progress").awaitTermination()
    late = slices.late_cells().count()
    return _table(slices.model()).withColumn("late_cells", F.lit(late))
