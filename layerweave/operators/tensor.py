"""Sparse tensors and matrices as coordinate tables, factor matrices as one row per index.

A tensor is a table of non-zero cells with one index column per mode and a value column.  A
factor matrix is a table ``idx, f0..f{R-1}``; an index without a row stands for a row of zeros.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.functions.hashing import coin, gaussian, md5_uniform, uniform
from layerweave.operators.skew import HotKeys, block_join, fits_broadcast, key_blocks, spread_join

MODES = ("i", "j", "k")


@dataclass(frozen=True)
class Tensor:
    """Cells ``modes..., value`` with the length of every mode."""

    cells: DataFrame
    shape: tuple[int, ...]
    modes: tuple[str, ...] = MODES

    def __post_init__(self):
        if len(self.shape) != len(self.modes):
            raise ValueError(f"shape {self.shape} does not fit modes {self.modes}")

    @property
    def order(self) -> int:
        return len(self.modes)


@dataclass(frozen=True)
class Factor:
    """Rows ``idx, f0..f{rank-1}`` of a factor matrix with ``length`` rows."""

    rows: DataFrame
    length: int
    rank: int

    @property
    def columns(self) -> list[str]:
        return factor_columns(self.rank)

    def filled(self) -> DataFrame:
        """All rows, zeros where none is stored."""
        spark = self.rows.sparkSession
        full = spark.range(self.length).select(F.col("id").alias("idx")).join(self.rows, "idx", "left")
        return full.na.fill(0.0, self.columns)


def factor_columns(rank: int) -> list[str]:
    return [f"f{r}" for r in range(rank)]


def without(values: Sequence, *positions: int) -> tuple:
    """The tuple without the given positions."""
    return tuple(v for n, v in enumerate(values) if n not in positions)


def updated(values: Sequence, position: int, value) -> tuple:
    return tuple(value if n == position else v for n, v in enumerate(values))


# --- building and measuring -------------------------------------------------------------------


def extent(cells: DataFrame, modes: Sequence[str] = MODES) -> tuple[int, ...]:
    """Largest index of every mode + 1, in one pass."""
    row = cells.agg(*[(F.max(m) + 1).alias(m) for m in modes]).first()
    return tuple(int(row[m] or 0) for m in modes)


def from_layers(edges: DataFrame, layers: Sequence[str], length: int) -> Tensor:
    """Stack ``layer, i, j, value`` into an N×N×L tensor; k is the place of the layer."""
    place = reduce(
        lambda chain, n: chain.when(F.col("layer") == layers[n], F.lit(n).cast("long")),
        range(1, len(layers)),
        F.when(F.col("layer") == layers[0], F.lit(0).cast("long")),
    )
    cells = edges.select("i", "j", place.alias("k"), "value").filter(F.col("k").isNotNull() & (F.col("value") != 0))
    return Tensor(cells, (length, length, len(layers)))


def stack(frames: Sequence[DataFrame], shape: tuple[int, int]) -> Tensor:
    """Union of matrices ``i, j, value``; the position in the list becomes k."""
    parts = [f.select("i", "j", F.lit(k).cast("long").alias("k"), "value") for k, f in enumerate(frames)]
    return Tensor(reduce(DataFrame.unionByName, parts), (*shape, len(frames)))


def norm(tensor: Tensor) -> float:
    """Square root of the sum of squares."""
    total = tensor.cells.agg(F.sum(F.col("value") * F.col("value")).alias("s")).first()["s"]
    return float(total or 0.0) ** 0.5


def stored_cells(tensor: Tensor) -> int:
    return tensor.cells.count()


def for_all(tensor: Tensor, condition: Callable[[Column], Column]) -> bool:
    """Whether the condition holds for every stored value; true for no cells."""
    held = tensor.cells.agg(F.bool_and(condition(F.col("value"))).alias("held")).first()["held"]
    return held is None or held


# --- cell-wise --------------------------------------------------------------------------------


def append_mode(tensor: Tensor, other: Tensor, mode: int = -1) -> Tensor:
    """Put ``other`` behind ``tensor`` along one mode."""
    mode %= tensor.order
    if without(tensor.shape, mode) != without(other.shape, mode):
        raise ValueError(f"{tensor.shape} and {other.shape} differ outside mode {mode}")
    column = tensor.modes[mode]
    behind = other.cells.withColumn(column, F.col(column) + F.lit(tensor.shape[mode]))
    shape = updated(tensor.shape, mode, tensor.shape[mode] + other.shape[mode])
    return replace(tensor, cells=tensor.cells.unionByName(behind), shape=shape)


def cellwise(
    tensor: Tensor, other: Tensor, combine: Callable[[Column, Column], Column], full: bool = False
) -> Tensor:
    """Combine cells of the same coordinate; ``full`` takes a missing cell as zero."""
    if tensor.shape != other.shape:
        raise ValueError(f"shapes differ: {tensor.shape}, {other.shape}")
    right = other.cells.withColumnRenamed("value", "_other")
    joined = tensor.cells.join(right, list(tensor.modes), "full" if full else "inner")
    a, b = F.col("value"), F.col("_other")
    if full:
        a, b = F.coalesce(a, F.lit(0.0)), F.coalesce(b, F.lit(0.0))
    return replace(tensor, cells=joined.select(*tensor.modes, combine(a, b).alias("value")))


def subtract(tensor: Tensor, other: Tensor) -> Tensor:
    return cellwise(tensor, other, lambda a, b: a - b, full=True)


def hadamard(left: Tensor, right: Tensor) -> Tensor:
    """Cell-wise product; a cell missing on either side is zero and stays missing."""
    return cellwise(left, right, lambda a, b: a * b)


def is_close(tensor: Tensor, other: Tensor, tolerance: float = 1e-6) -> bool:
    return for_all(subtract(tensor, other), lambda v: F.abs(v) <= tolerance)


def unfold(tensor: Tensor, mode: int) -> Tensor:
    """Matrix of a three-way tensor along one mode (0, 1 or 2)."""
    i, j, k = (F.col(m) for m in tensor.modes)
    length_i, length_j, length_k = tensor.shape
    row, column, shape = [
        (i, k * length_j + j, (length_i, length_j * length_k)),
        (j, k * length_i + i, (length_j, length_i * length_k)),
        (k, i * length_j + j, (length_k, length_i * length_j)),
    ][mode]
    return Tensor(tensor.cells.select(row.alias("i"), column.alias("j"), "value"), shape, ("i", "j"))


# --- contraction ------------------------------------------------------------------------------


def contract(tensor: Tensor, mode: int, other: Tensor, other_mode: int, block_rows: int = 100_000) -> Tensor:
    """Sum over one shared index; the result has the remaining modes of both tensors.

    An index that many cells share on both sides is joined as a grid of blocks.
    """
    if tensor.shape[mode] != other.shape[other_mode]:
        raise ValueError(f"mode lengths differ: {tensor.shape[mode]}, {other.shape[other_mode]}")
    kept, others = without(tensor.modes, mode), without(other.modes, other_mode)
    names = tuple("ijklmnop"[: len(kept) + len(others)])
    left = tensor.cells.select(
        F.col(tensor.modes[mode]).alias("_c"), *[F.col(m).alias(f"_l{m}") for m in kept], F.col("value").alias("_v")
    )
    right = other.cells.select(
        F.col(other.modes[other_mode]).alias("_c"), *[F.col(m).alias(f"_r{m}") for m in others], F.col("value").alias("_w")
    )
    right_rows = right.count()
    blocks = None if fits_broadcast(right_rows, 2 + len(others)) else key_blocks(left, right, ["_c"], left.count(), right_rows, block_rows)
    pairs = block_join(
        left, right, ["_c"], [F.col(f"_l{m}") for m in kept] or [F.col("_v")],
        [F.col(f"_r{m}") for m in others] or [F.col("_w")], blocks, right_rows,
    )
    keys = [F.col(f"_l{m}").alias(n) for m, n in zip(kept, names)]
    keys += [F.col(f"_r{m}").alias(n) for m, n in zip(others, names[len(kept):])]
    cells = pairs.groupBy(*keys).agg(F.sum(F.col("_v") * F.col("_w")).alias("value"))
    return Tensor(cells, without(tensor.shape, mode) + without(other.shape, other_mode), names)


def contract_vector(tensor: Tensor, mode: int, vector: DataFrame, length: int) -> Tensor:
    """Sum over one index against a vector ``idx, value``; the mode disappears.

    The vector is broadcast only when its whole length fits the broadcast limit.
    """
    if tensor.shape[mode] != length:
        raise ValueError(f"mode {mode} has length {tensor.shape[mode]}, the vector {length}")
    column = tensor.modes[mode]
    kept = without(tensor.modes, mode)
    weights = vector.select(F.col("idx").alias(column), F.col("value").alias("_w"))
    joined = spread_join(
        tensor.cells, weights, [column], [F.col(m) for m in kept], HotKeys(tensor.cells, [column]), length
    )
    cells = joined.groupBy(*kept).agg(F.sum(F.col("value") * F.col("_w")).alias("value"))
    return Tensor(cells, without(tensor.shape, mode), kept)


def dot(left: DataFrame, right: DataFrame) -> float:
    """Inner product of two vectors ``idx, value``."""
    other = right.withColumnRenamed("value", "_w")
    total = left.join(other, "idx").agg(F.sum(F.col("value") * F.col("_w")).alias("s")).first()["s"]
    return float(total or 0.0)


def multiply(left: Tensor, right: Tensor) -> Tensor:
    """Matrix product."""
    return contract(left, 1, right, 0)


def transpose(matrix: Tensor) -> Tensor:
    cells = matrix.cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")
    return Tensor(cells, (matrix.shape[1], matrix.shape[0]), ("i", "j"))


def normalize_vector(vector: DataFrame) -> tuple[DataFrame, float]:
    """The vector scaled to length 1, and its length; zeros stay zeros."""
    total = vector.agg(F.sum(F.col("value") * F.col("value")).alias("s")).first()["s"]
    size = float(total or 0.0) ** 0.5
    scaled = F.col("value") / F.lit(size) if size else F.lit(0.0)
    return vector.withColumn("value", scaled), size


# --- factor matrices --------------------------------------------------------------------------


def gram_sums(rank: int, columns: Sequence[str] | None = None) -> list[Column]:
    """The R(R+1)/2 sums of products that make up XᵀX."""
    columns = list(columns or factor_columns(rank))
    return [
        F.sum(F.col(columns[r]) * F.col(columns[s])).alias(f"g{r}_{s}") for r in range(rank) for s in range(r, rank)
    ]


def gram_from(row, rank: int) -> np.ndarray:
    """The symmetric R×R matrix from the one row of ``gram_sums``."""
    out = np.zeros((rank, rank))
    for r in range(rank):
        for s in range(r, rank):
            out[r, s] = out[s, r] = row[f"g{r}_{s}"] or 0.0
    return out


def gram(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """XᵀX by one aggregate; R×R numbers reach the driver."""
    return gram_from(rows.agg(*gram_sums(len(columns), columns)).first(), len(columns))


def column_norms(rows: DataFrame, columns: Sequence[str]) -> np.ndarray:
    row = rows.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(c) for c in columns]).first()
    return np.array([row[c] or 0.0 for c in columns])


def column_max(rows: DataFrame, columns: Sequence[str], floor: float = 1.0) -> np.ndarray:
    """Largest entry per column, at least ``floor``."""
    row = rows.agg(*[F.greatest(F.max(c), F.lit(floor)).alias(c) for c in columns]).first()
    return np.array([floor if row[c] is None else row[c] for c in columns])


def scale_columns(rows: DataFrame, columns: Sequence[str], norms: np.ndarray) -> DataFrame:
    """Divide each column by its norm; a zero norm gives zeros."""
    scaled = {
        c: (F.col(c) / F.lit(float(n)) if n and np.isfinite(n) else F.lit(0.0)) for c, n in zip(columns, norms)
    }
    return rows.withColumns(scaled)


def normalize_columns(factor: Factor) -> tuple[Factor, np.ndarray]:
    norms = column_norms(factor.rows, factor.columns)
    return replace(factor, rows=scale_columns(factor.rows, factor.columns, norms)), norms


def times_matrix(factor: Factor, matrix: np.ndarray) -> Factor:
    """Every row times a small R×S matrix: a projection."""
    rank = matrix.shape[1]
    products = [
        reduce(Column.__add__, [F.col(c) * F.lit(float(matrix[r, s])) for r, c in enumerate(factor.columns)]).alias(f"f{s}")
        for s in range(rank)
    ]
    return Factor(factor.rows.select("idx", *products), factor.length, rank)


def khatri_rao(left: Factor, right: Factor) -> Factor:
    """Row (p, q) = row p of ``left`` times row q of ``right``, at index p·J + q.

    Each row of ``left`` lists its J partners; the partners are then an equi-join on q.
    """
    if left.rank != right.rank:
        raise ValueError("ranks differ")
    partners = F.sequence(F.lit(0).cast("long"), F.lit(right.length - 1).cast("long"))
    a = left.rows.select(F.col("idx").alias("p"), F.explode(partners).alias("q"), *[F.col(c).alias(f"_{c}") for c in left.columns])
    b = right.rows.withColumnRenamed("idx", "q")
    b = F.broadcast(b) if fits_broadcast(right.length, right.rank + 1) else b.hint("merge")
    products = [(F.col(f"_{c}") * F.col(c)).alias(c) for c in left.columns]
    rows = a.join(b, "q").select((F.col("p") * F.lit(right.length) + F.col("q")).alias("idx"), *products)
    return Factor(rows, left.length * right.length, left.rank)


def join_factor(
    cells: DataFrame, column: str, factor: Factor, prefix: str, spread: Sequence[str], hot: HotKeys | None = None,
    how: str = "inner",
) -> DataFrame:
    """Attach the factor row of an index column as ``{prefix}0..``.

    Broadcast when the factor's length allows it, else a shuffle join that spreads hot indexes.
    """
    rows = factor.rows.select(
        F.col("idx").alias(column), *[F.col(c).alias(f"{prefix}{r}") for r, c in enumerate(factor.columns)]
    )
    hot = hot or HotKeys(cells, [column])
    return spread_join(cells, rows, [column], [F.col(c) for c in spread], hot, factor.length, how)


def mttkrp(tensor: Tensor, factors: Sequence[Factor | None], mode: int, hot: Sequence[HotKeys] | None = None) -> Factor:
    """Matricised tensor times Khatri-Rao product, all ranks in one pass over the cells.

    The shuffle carries one partial row of R sums per index and map task.
    """
    rank = next(f.rank for n, f in enumerate(factors) if n != mode)
    joined, weights = tensor.cells, []
    for n, factor in enumerate(factors):
        if n == mode:
            continue
        column = tensor.modes[n]
        joined = join_factor(joined, column, factor, f"_{column}_", without(tensor.modes, n), hot[n] if hot else None)
        weights.append(f"_{column}_")
    sums = [
        F.sum(reduce(Column.__mul__, [F.col("value"), *[F.col(f"{w}{r}") for w in weights]])).alias(f"f{r}")
        for r in range(rank)
    ]
    rows = joined.groupBy(F.col(tensor.modes[mode]).alias("idx")).agg(*sums)
    return Factor(rows, tensor.shape[mode], rank)


def initial_factor(spark: SparkSession, length: int, rank: int, seed: int, mode: int, kind: str = "gaussian") -> Factor:
    """Starting values that depend on (seed, mode, index, column) only: gaussian, uniform, coin, or md5.

    ``md5`` draws uniforms that any engine with MD5 can repeat; ``uniform`` does so by the JVM's faster hash.
    """
    draw = {"gaussian": gaussian, "uniform": uniform, "coin": coin, "md5": lambda *parts: md5_uniform(F.lit(parts[0]), *parts[1:])}[kind]
    values = [draw(seed, F.lit(mode), F.col("id"), F.lit(r)).alias(f"f{r}") for r in range(rank)]
    return Factor(spark.range(length).select(F.col("id").alias("idx"), *values), length, rank)


# --- model values -----------------------------------------------------------------------------


def model_value(weights: Sequence[float], prefixes: Sequence[str]) -> Column:
    """Σ_r weight_r · ∏ factor entries, over columns ``{prefix}{r}``."""
    terms = [
        reduce(Column.__mul__, [F.lit(float(w)), *[F.col(f"{p}{r}") for p in prefixes]]) for r, w in enumerate(weights)
    ]
    return reduce(Column.__add__, terms)


def evaluate(
    cells: DataFrame, factors: Sequence[Factor], weights: Sequence[float], modes: Sequence[str] = MODES, name: str = "estimate"
) -> DataFrame:
    """Add the model's value at every coordinate; an index without a factor row counts as zero."""
    joined, prefixes = cells, []
    for n, factor in enumerate(factors):
        column, prefix = modes[n], f"_{modes[n]}_"
        joined = join_factor(joined, column, factor, prefix, without(modes, n), how="left")
        prefixes.append(prefix)
    value = F.coalesce(model_value(weights, prefixes), F.lit(0.0))
    return joined.select(*cells.columns, value.alias(name))


def reconstruct(
    factors: Sequence[Factor], weights: Sequence[float], modes: Sequence[str] = MODES, wanted: DataFrame | None = None
) -> Tensor:
    """The model's tensor at the ``wanted`` coordinates, or at every one, which is as many rows as the shape has cells."""
    shape = tuple(f.length for f in factors)
    if wanted is not None:
        return Tensor(evaluate(wanted.select(*modes), factors, weights, modes, "value"), shape, tuple(modes))
    total = math.prod(shape)
    spark = factors[0].rows.sparkSession
    # The coordinates are the digits of one running number, generated in parallel.
    strides = [math.prod(shape[n + 1:]) for n in range(len(shape))]
    digits = [F.expr(f"(id div {s}) % {n}").alias(m) for s, n, m in zip(strides, shape, modes)]
    cells = spark.range(total).select(*digits)
    return Tensor(evaluate(cells, factors, weights, modes, "value"), shape, tuple(modes))
