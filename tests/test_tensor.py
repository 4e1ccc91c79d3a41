import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from layerweave.operators import cp
from layerweave.operators import graph as G
from layerweave.operators import incremental as I
from layerweave.operators import layers as L
from layerweave.operators import score_classes as K
from layerweave import session
from layerweave.operators import skew
from layerweave.operators import tensor as T


def factor(spark, rows):
    rank = len(rows[0])
    data = [(n, *map(float, r)) for n, r in enumerate(rows)]
    return T.Factor(spark.createDataFrame(data, "idx long, " + ", ".join(f"f{r} double" for r in range(rank))), len(rows), rank)


def dense(spark, array, modes=T.MODES):
    data = [(*map(int, c), float(array[c])) for c in np.ndindex(*array.shape) if array[c]]
    schema = ", ".join(f"{m} long" for m in modes) + ", value double"
    return T.Tensor(spark.createDataFrame(data, schema), array.shape, tuple(modes))


def numbers(tensor):
    out = np.zeros(tensor.shape)
    for row in tensor.cells.collect():
        out[tuple(row[m] for m in tensor.modes)] = row["value"]
    return out


def matrix(f):
    out = np.zeros((f.length, f.rank))
    for row in f.rows.collect():
        out[row["idx"]] = [row[c] for c in f.columns]
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [(2, 2), (3, 3), (4, 4)], [(1, 1), (2, 2)], [(5, 5), (4, 4), (3, 3)]
    return cp.CPModel(tuple(factor(spark, r) for r in rows), np.array([5.0, 5.0]))


def test_model_values(spark, model):
    cells = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 1, 2)], "i long, j long, k long")
    assert [r["estimate"] for r in model.value_at(cells).orderBy("i").collect()] == [100.0, 150.0, 240.0]


def test_error_after_lowering_one_cell(spark, model):
    full = model.reconstruct()
    assert full.cells.count() == 18
    first = (F.col("i") == 0) & (F.col("j") == 0) & (F.col("k") == 0)
    lowered = T.Tensor(full.cells.withColumn("value", F.when(first, F.col("value") - 3).otherwise(F.col("value"))), full.shape)
    assert model.error(lowered) == pytest.approx(3 / T.norm(lowered), abs=1e-7)
    assert model.error(lowered, masked=True) == pytest.approx(3 / T.norm(lowered), abs=1e-7)
    wanted = model.reconstruct(wanted=full.cells.filter(first).select("i", "j", "k"))
    assert [r["value"] for r in wanted.cells.collect()] == [r["value"] for r in full.cells.filter(first).collect()]


def test_vectors(spark):
    vec = lambda *v: spark.createDataFrame([(n, float(x)) for n, x in enumerate(v)], "idx long, value double")
    assert T.dot(vec(2, 2, 2, 2), vec(1, 2, 3, 4)) == 20.0
    scaled, size = T.normalize_vector(vec(2, 2, 2, 2))
    assert size == 4.0 and [r["value"] for r in scaled.collect()] == [0.5] * 4
    a, b = (T.Tensor(spark.createDataFrame([c], "i long, value double"), (2,), ("i",)) for c in ((0, 1.0), (1, 1.0)))
    assert numbers(T.subtract(a, b)).tolist() == [1.0, -1.0]
    assert not T.is_close(a, b) and T.is_close(a, a)


def test_index_tuples():
    c = (3, 2, 1)
    assert (*c, 0) == (3, 2, 1, 0) and T.without(c, 0, 2) == (2,) and T.updated(c, 1, 200) == (3, 200, 1)


def test_matrices(spark):
    one, two = np.array([[1.0, 2, 3]] * 3), np.array([[1.0, 2, 3], [4, 5, 6], [0, 0, 0]])
    for m in (one, two):
        f = factor(spark, m.tolist())
        assert T.gram(f.rows, f.columns) == pytest.approx(m.T @ m)
        assert T.column_norms(f.rows, f.columns) == pytest.approx(np.linalg.norm(m, axis=0))
        square = T.multiply(T.transpose(dense(spark, m, "ij")), dense(spark, m, "ij"))
        assert numbers(square) == pytest.approx(m.T @ m)
    assert numbers(T.hadamard(dense(spark, one, "ij"), dense(spark, two, "ij"))) == pytest.approx(one * two)
    kr = T.khatri_rao(factor(spark, one.tolist()), factor(spark, two.tolist()))
    assert matrix(kr) == pytest.approx(np.vstack([one[p] * two[q] for p in range(3) for q in range(3)]))
    zero, norms = T.normalize_columns(factor(spark, [[0.0, 3.0], [0.0, 4.0]]))
    assert norms.tolist() == [0.0, 5.0] and matrix(zero).tolist() == [[0.0, 0.6], [0.0, 0.8]]
    assert T.column_max(factor(spark, [[0.5, 3.0]]).rows, ["f0", "f1"]).tolist() == [1.0, 3.0]


@pytest.fixture(scope="module")
def cube():
    draw = np.random.default_rng(5)
    return draw.random((4, 5, 3)) * (draw.random((4, 5, 3)) < 0.7)


@pytest.mark.parametrize("limit", [None, 0])
def test_contractions(spark, cube, monkeypatch, limit):
    """Also with broadcasting forbidden and every index treated as crowded."""
    if limit is not None:
        monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(skew, "TASK_ROWS", 4)
    tensor = dense(spark, cube)
    factors = [np.random.default_rng(n).random((size, 2)) for n, size in enumerate(cube.shape)]
    frames = [factor(spark, f.tolist()) for f in factors]
    a, b, c = factors
    hot = [skew.HotKeys(tensor.cells, [m]) for m in T.MODES]
    assert matrix(T.mttkrp(tensor, frames, 0, hot)) == pytest.approx(np.einsum("ijk,jr,kr->ir", cube, b, c))
    assert matrix(T.mttkrp(tensor, frames, 1, hot)) == pytest.approx(np.einsum("ijk,ir,kr->jr", cube, a, c))
    assert matrix(T.mttkrp(tensor, frames, 2, hot)) == pytest.approx(np.einsum("ijk,ir,jr->kr", cube, a, b))
    vector = frames[1].rows.select("idx", F.col("f0").alias("value"))
    assert numbers(T.contract_vector(tensor, 1, vector, 5)) == pytest.approx(np.einsum("ijk,j->ik", cube, b[:, 0]))
    other = np.random.default_rng(9).random((5, 6))
    got = T.contract(tensor, 1, dense(spark, other, "ij"), 0, block_rows=3)  # blocks only when nothing is broadcast
    assert numbers(got) == pytest.approx(np.einsum("ijk,jl->ikl", cube, other))
    estimate = {tuple(r[m] for m in T.MODES): r["estimate"] for r in T.evaluate(tensor.cells, frames, [1.0, 2.0]).collect()}
    want = np.einsum("ir,jr,kr,r->ijk", a, b, c, [1.0, 2.0])
    assert all(v == pytest.approx(want[k]) for k, v in estimate.items())
    assert numbers(T.reconstruct(frames, [1.0, 2.0])) == pytest.approx(want)


def test_unfold_append_extent(spark, cube):
    tensor = dense(spark, cube)
    i, j, k = cube.shape
    assert numbers(T.unfold(tensor, 0)) == pytest.approx(np.transpose(cube, (0, 2, 1)).reshape(i, k * j))
    assert numbers(T.unfold(tensor, 1)) == pytest.approx(np.transpose(cube, (1, 2, 0)).reshape(j, k * i))
    assert numbers(T.unfold(tensor, 2)) == pytest.approx(np.transpose(cube, (2, 0, 1)).reshape(k, i * j))
    twice = T.append_mode(tensor, tensor)
    assert numbers(twice) == pytest.approx(np.concatenate([cube, cube], axis=2)) and T.extent(twice.cells) == twice.shape
    assert T.norm(tensor) == pytest.approx(np.linalg.norm(cube)) and T.stored_cells(tensor) == np.count_nonzero(cube)
    assert T.for_all(tensor, lambda v: v > 0) and not T.for_all(tensor, lambda v: v > 0.5)
    with pytest.raises(ValueError):
        T.append_mode(tensor, dense(spark, cube[:3]))


def als(x, start, sweeps):
    """Alternating least squares with unit columns, in numpy."""
    f, errors = [s.copy() for s in start], []
    for _ in range(sweeps):
        for m, spec in enumerate(("ijk,jr,kr->ir", "ijk,ir,kr->jr", "ijk,ir,jr->kr")):
            a, b = [f[n] for n in range(3) if n != m]
            raw = np.einsum(spec, x, a, b) @ np.linalg.pinv((a.T @ a) * (b.T @ b))
            weights = np.linalg.norm(raw, axis=0)
            f[m] = raw / weights
        errors.append(np.linalg.norm(np.einsum("ir,jr,kr,r->ijk", *f, weights) - x) / np.linalg.norm(x))
    return f, weights, errors


@pytest.mark.parametrize("shares", [True, False])
def test_decomposition_equals_numpy(spark, cube, shares):
    source = cp.CellSource(dense(spark, cube), 2)
    source.shares = shares
    start = [matrix(T.initial_factor(spark, n, 2, 6, m)) for m, n in enumerate(cube.shape)]
    factors, weights, errors = als(cube, start, 3)
    found = cp.cp_als(source, 2, 3, None)
    assert found.errors == pytest.approx(errors, abs=1e-9)
    assert found.weights == pytest.approx(weights)
    for a, b in zip(found.factors, factors):
        assert matrix(a) == pytest.approx(b, abs=1e-9)
    assert found.error(dense(spark, cube)) == pytest.approx(errors[-1], abs=1e-9)
    assert all(later <= earlier + 1e-9 for earlier, later in zip(found.errors, found.errors[1:]))


def test_recovery_of_a_rank_two_tensor(spark):
    draw = np.random.default_rng(0)
    x = np.einsum("ir,jr,kr->ijk", *[draw.random((3, 2)) for _ in range(3)])
    tensor = dense(spark, x)
    found = cp.cp_als(tensor, 2, 25, 0.01)
    assert found.errors[-1] < 0.1 and len(found.errors) < 25
    fit = cp.cp_fit(tensor, 2, 4)
    assert fit.errors[-1] < 0.3 and fit.error(tensor) == pytest.approx(fit.errors[-1], abs=1e-6)


def test_preconditions(spark, cube):
    tensor = dense(spark, cube)
    for wrong in ({"rank": 0}, {"max_sweeps": -1}, {"tolerance": -1.0}, {"norm": "l1"}, {"stop": "never"}):
        with pytest.raises(ValueError):
            cp.cp_als(tensor, **{"rank": 2, **wrong})
    with pytest.raises(ValueError):
        T.Tensor(tensor.cells, (1, 2))


def test_model_tables(spark, model):
    index = spark.createDataFrame([(10, 0), (20, 1), (30, 2)], "id long, idx long")
    square = cp.CPModel((model.factors[0], model.factors[2], model.factors[1]), model.weights)
    rows = {r["id"]: r.asDict() for r in cp.community_table(square, index).collect()}
    assert rows[30] == {"id": 30, "A_r0": 4.0, "A_r1": 4.0, "B_r0": 3.0, "B_r1": 3.0}
    assert {r["layer"]: r["C_r0"] for r in cp.personality_table(square, ["x", "y"]).collect()} == {"x": 1.0, "y": 2.0}
    assert cp.weight_table(square).first().asDict() == {"lambda_r0": 5.0, "lambda_r1": 5.0}


def test_initial_factors_do_not_depend_on_partitions(spark):
    for kind in ("gaussian", "uniform", "coin"):
        f = T.initial_factor(spark, 4000, 2, 1, 0, kind)
        again = T.Factor(f.rows.repartition(3), f.length, f.rank)
        values = matrix(f)
        assert (values == matrix(again)).all()
        if kind == "gaussian":
            assert abs(values.mean()) < 0.05 and abs(values.std() - 1) < 0.05
        if kind == "uniform":
            assert abs(values.mean() - 0.5) < 0.02 and 0 < values.min() and values.max() < 1
        if kind == "coin":
            assert set(np.unique(values)) == {0.0, 1.0}


def test_scores_give_the_products_of_the_listed_tensor(spark):
    """Also for layers without direction, where nobody is a partner of their own."""
    draw = np.random.default_rng(2)
    layers, length = ["OPN", "CSN", "AGR", "NEU", "HIGH", "ALL"], 30
    rules = {**L.RULES, "HIGH": L.DEFAULT_RULE, "ALL": L.LayerRule((L.Band(-0.5, 2.0),), L.BOTH)}
    rows = [(layer, n, round(float(z), 1)) for layer in layers for n, z in enumerate(draw.normal(0, 1.5, length))]
    points = spark.createDataFrame(rows, "layer string, idx long, z double")
    people = points.select("layer", F.col("idx").alias("id"), "z")
    edges = L.fit_edges(people, rules).select("layer", F.col("src").alias("i"), F.col("dst").alias("j"), F.col("fit").alias("value"))
    listed = cp.CellSource(T.from_layers(edges, layers, length), 2)
    scores = K.ScoreSource(points, layers, length, rules)
    assert scores.shape == listed.shape and scores.squares == pytest.approx(listed.squares)
    factors = [factor(spark, draw.random((n, 2)).tolist()) for n in listed.shape]
    for mode in range(3):
        a, b = (matrix(s.products(mode, factors, s.share(factors) if mode else None)) for s in (listed, scores))
        assert a == pytest.approx(b)
    one, two = cp.cp_als(listed, 2, 2, None), cp.cp_als(scores, 2, 2, None)
    assert one.errors == pytest.approx(two.errors, abs=1e-9)
    for model in (one, two):  # what the planner takes for the size of a factor does not pile up
        for f in model.factors:
            assert f.rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 40


# --- sampling and growth ----------------------------------------------------------------------


def test_matching_is_the_cheapest():
    from itertools import permutations

    draw = np.random.default_rng(1)
    for size in range(1, 6):
        for _ in range(30):
            cost = draw.random((size, size))
            best = min(sum(cost[r, p[r]] for r in range(size)) for p in permutations(range(size)))
            found = I.best_matching(cost)
            assert sorted(found) == list(range(size)) and sum(cost[r, c] for r, c in enumerate(found)) == pytest.approx(best)


def test_sample_sizes_and_large_form(spark, monkeypatch):
    weights = spark.range(500).select(F.col("id").alias("idx"), (F.col("id") % 7 * 1.0).alias("weight"))
    small = sorted((r["idx"], r["new"]) for r in I.weighted_sample(weights, 60, 0, 0).collect())
    monkeypatch.setattr(I, "SMALL_SAMPLE", 1)
    assert small == sorted((r["idx"], r["new"]) for r in I.weighted_sample(weights, 60, 0, 0).collect())
    assert [n for _, n in small] == list(range(60)) and all(i % 7 for i, _ in small)


def test_heavy_slices_are_drawn_more_often(spark):
    weights = spark.createDataFrame([(0, 50.0)] + [(n, 1.0) for n in range(1, 11)], "idx long, weight double")
    drawn = sum(I.weighted_sample(weights, 1, seed, 0).first()["idx"] == 0 for seed in range(8))
    assert drawn >= 4


def test_sampled_model_fits_sampled_tensor(spark):
    draw = np.random.default_rng(3)
    parts = [draw.random((5, 5)) for _ in range(3)]
    tensor = dense(spark, np.einsum("ir,jr,kr->ijk", *parts))
    maps = [I.weighted_sample(I.slice_weights(tensor, m), 3, 0, m) for m in range(3)]
    sample = I.restrict(tensor, maps, (3, 3, 3))
    cut = tuple(I.restrict_factor(factor(spark, p.tolist()), m, 3) for p, m in zip(parts, maps))
    assert sample.cells.count() == 27
    assert cp.CPModel(cut, np.ones(5)).error(sample, masked=True) < 1e-7


def test_only_zero_cells_are_filled(spark):
    known = factor(spark, [[1.0, 0.0], [0.0, 2.0]])
    fresh = spark.createDataFrame([(0, 9.0, 9.0), (5, 7.0, 0.0)], "idx long, f0 double, f1 double")
    rows = {r["idx"]: (r["f0"], r["f1"]) for r in I.fill_zero_cells(T.Factor(known.rows, 6, 2), fresh).rows.collect()}
    assert rows == {0: (1.0, 9.0), 1: (0.0, 2.0), 5: (7.0, 0.0)}


def test_scales_and_signs(spark):
    new, known = factor(spark, [[1.0, -2.0], [1.0, 2.0], [1.0, 2.0]]), factor(spark, [[3.0, 2.0], [3.0, -2.0], [3.0, -2.0]])
    chosen = spark.range(3).select(F.col("id").alias("idx"), F.col("id").alias("new"))
    assert I.align_scales(I._side_by_side(chosen, new, known), 2) == pytest.approx([3.0, -1.0])
    swapped = I.reorder(known, [1, 0])
    assert I.match_components(I._side_by_side(chosen, swapped, known), 2) == [1, 0]


def test_growth_follows_the_tensor(spark):
    draw = np.random.default_rng(4)
    parts = [draw.random((8, 2)) + 0.1 for _ in range(3)]
    x = np.einsum("ir,jr,kr->ijk", *parts)
    state = I.start(dense(spark, x[:, :, :6]), rank=2, max_sweeps=6, tolerance=1e-3, sampling_factor=2, repetitions=2)
    before = state.model.error(state.tensor)
    grown = state.receive(dense(spark, x[:, :, 6:]))
    assert grown.tensor.shape == (8, 8, 8) and grown.model.shape == (8, 8, 8)
    assert numbers(grown.tensor) == pytest.approx(x)
    for mode, kept in enumerate(grown.weights):  # added up per batch, equal to those of the whole
        whole = {r["idx"]: r["weight"] for r in I.slice_weights(grown.tensor, mode).collect()}
        assert {r["idx"]: r["weight"] for r in kept.collect()} == pytest.approx(whole)
    # The rows of the new slices go on from the known ones: the model still describes the whole.
    assert grown.model.error(grown.tensor) < before + 0.2
    old, new = matrix(state.model.factors[2]), matrix(grown.model.factors[2])
    assert new[:6] == pytest.approx(old) and np.abs(new[6:]).min() > 0
    with pytest.raises(ValueError):
        grown.receive(dense(spark, x[:3]))


def test_unknown_algorithm_leaves_tables(spark):
    index = spark.createDataFrame([(1, 0)], "id long, idx long")
    with pytest.warns(UserWarning):
        nodes, layers, weights = cp.analyse_layers(None, index, ["a"], algorithm="other")
    assert nodes.columns == ["id"] and layers.columns == ["layer"] and weights is None


def test_layer_tensor_has_unit_columns(spark):
    draw = np.random.default_rng(6)
    rows = [(layer, n, round(float(z), 2)) for layer in ("OPN", "NEU") for n, z in enumerate(draw.normal(0, 1.5, 20))]
    graph = G.build_graph(spark.createDataFrame(rows, "layer string, id long, z double"), rules=L.RULES)
    cells, index = G.indexed_edges(graph)
    tensor = T.from_layers(cells, ["OPN", "NEU"], index.count())
    nodes, layers, weights = cp.analyse_layers(tensor, index, ["OPN", "NEU"], rank=2, max_sweeps=3)
    assert nodes.count() == 20 and layers.count() == 2 and len(weights.columns) == 2
    for column in ("A_r0", "B_r1"):
        assert math.isclose(nodes.agg(F.sum(F.col(column) ** 2)).first()[0], 1.0, rel_tol=1e-6)
