import numpy as np

from layerweave.operators import incremental as I
from layerweave.operators import tensor as T
from layerweave.streaming.slices import CELLS, SliceStream
from tests.test_tensor import dense


def test_slices_arrive_in_batches(spark, tmp_path):
    draw = np.random.default_rng(4)
    x = np.einsum("ir,jr,kr->ijk", *[draw.random((6, 2)) + 0.1 for _ in range(3)])
    known = dense(spark, x[:, :, :3])
    slices = SliceStream(spark, str(tmp_path / "state"), {"max_sweeps": 3, "tolerance": 0.01})
    slices.seed(I.start(known, rank=2, max_sweeps=3, tolerance=0.01))
    source = tmp_path / "in"
    whole = dense(spark, x).cells

    def arrive(first, last):
        whole.filter(f"k between {first} and {last}").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(CELLS).parquet(str(source))
        slices.run(stream, str(tmp_path / "progress")).awaitTermination()

    arrive(3, 4)
    assert slices.model().shape == (6, 6, 5)
    arrive(4, 5)  # slice 4 comes again
    assert slices.model().shape == (6, 6, 6)
    assert slices.late_cells().filter("k = 4").count() == 36
    _, state = slices.state_before(10)
    assert state.tensor.cells.count() == x.size and T.extent(state.tensor.cells) == (6, 6, 6)
    # A batch that is run again after a failure replaces its own result.
    slices.apply(whole.filter("k between 4 and 5"), 1)
    assert slices.model().shape == (6, 6, 6) and slices.state_before(10)[1].tensor.cells.count() == x.size
