"""The incremental decomposition as a stream: every micro-batch brings new slices.

State lives in the shared folder under the number of the batch that made it, so a batch that is
run again after a failure replaces its own result and never appends twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from layerweave.operators import tensor as T
from layerweave.operators.cp import CPModel
from layerweave.operators.incremental import IncrementalCP
from layerweave.operators.tensor import Factor, Tensor

CELLS = "i long, j long, k long, value double"
_START = -1


@dataclass
class SliceStream:
    """Appends slices along mode k; cells of a slice that was appended before go to a side table."""

    spark: SparkSession
    path: str
    options: dict = field(default_factory=dict)

    def _model_path(self, batch: int) -> str:
        return f"{self.path}/model/batch={batch}"

    def _cells_path(self, batch: int) -> str:
        return f"{self.path}/cells/batch={batch}"

    def seed(self, state: IncrementalCP) -> None:
        """Store the decomposition of the first slices as the state before any batch."""
        state.tensor.cells.select(*T.MODES, "value").write.mode("overwrite").parquet(self._cells_path(_START))
        self._store(state, _START)

    def _store(self, state: IncrementalCP, batch: int) -> None:
        path, model = self._model_path(batch), state.model
        for mode, factor in enumerate(model.factors):
            factor.rows.write.mode("overwrite").parquet(f"{path}/factor={mode}")
        for mode, weights in enumerate(state.slice_weights()):
            weights.write.mode("overwrite").parquet(f"{path}/weights={mode}")
        head = [([float(w) for w in model.weights], list(model.shape))]
        # Written last: a batch without it is not a state.
        self.spark.createDataFrame(head, "weights array<double>, shape array<long>").coalesce(1).write.mode("overwrite").json(self._head_path(batch))

    def _head_path(self, batch: int) -> str:
        return f"{self.path}/heads/batch={batch}"

    def _newest(self, batch: int) -> int:
        """The newest batch before ``batch`` that left a state, by the names of the heads."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/heads")
        files = folder.getFileSystem(context._jsc.hadoopConfiguration())
        names = [status.getPath() for status in files.listStatus(folder)]
        done = [p for p in names if files.exists(context._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return max(b for b in (int(p.getName().removeprefix("batch=")) for p in done) if b < batch)

    def state_before(self, batch: int) -> tuple[int, IncrementalCP]:
        """The newest state that an earlier batch left: one head, its factors and weights, and the cells so far.

        Batches run in order and a failed one runs again before the next, so all cells of earlier batches count.
        """
        last = self._newest(batch)
        head = self.spark.read.schema("weights array<double>, shape array<long>").json(self._head_path(last)).first()
        rank, shape = len(head["weights"]), [int(n) for n in head["shape"]]
        path = self._model_path(last)
        factors = tuple(Factor(self.spark.read.parquet(f"{path}/factor={m}"), n, rank) for m, n in enumerate(shape))
        weights = tuple(self.spark.read.parquet(f"{path}/weights={m}") for m in range(len(shape)))
        cells = self.spark.read.schema(CELLS + ", batch long").parquet(f"{self.path}/cells").filter(F.col("batch") <= last).drop("batch")
        model = CPModel(factors, np.array(head["weights"]))
        seed = self.options.get("seed", 0) + batch
        return last, IncrementalCP(Tensor(cells, tuple(shape)), model, **{**self.options, "seed": seed, "weights": weights})

    def apply(self, cells: DataFrame, batch: int) -> None:
        """One micro-batch of cells with absolute slice numbers."""
        _, state = self.state_before(batch)
        known = state.tensor.shape[2]
        cells = cells.select(*T.MODES, "value")
        late = cells.filter(F.col("k") < known)
        late.write.mode("overwrite").parquet(f"{self.path}/late/batch={batch}")
        fresh = cells.filter(F.col("k") >= known)
        newest = fresh.agg(F.max("k").alias("k")).first()["k"]
        if newest is None:
            return
        # The slices are read back from their own folder: the state never depends on the source again.
        fresh.write.mode("overwrite").parquet(self._cells_path(batch))
        stored = self.spark.read.schema(CELLS).parquet(self._cells_path(batch))
        shape = (*state.tensor.shape[:2], int(newest) + 1 - known)
        slices = Tensor(stored.withColumn("k", F.col("k") - known), shape)
        self._store(state.receive(slices), batch)

    def model(self) -> CPModel:
        return self.state_before(2**62)[1].model

    def late_cells(self) -> DataFrame:
        return self.spark.read.schema(CELLS + ", batch long").parquet(f"{self.path}/late")

    def run(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        """Feed a streaming DataFrame of cells; ``trigger`` as in ``DataStreamWriter.trigger``."""
        return (
            stream.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch))
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )
