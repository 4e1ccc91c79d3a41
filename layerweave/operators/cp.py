"""CP (PARAFAC) decomposition of a three-way tensor by alternating least squares.

Tensor and factors stay distributed.  The driver holds the Gram matrices (R×R) and the column
weights; every update is one pass over the cells and one small aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.operators import tensor as T
from layerweave.operators.skew import HotKeys
from layerweave.operators.tensor import Factor, Tensor
from layerweave.session import forget_table, keep_table


@dataclass(frozen=True)
class CPModel:
    """Factor matrices with unit columns, and the weight of each component."""

    factors: tuple[Factor, ...]
    weights: np.ndarray
    errors: tuple[float, ...] = field(default=())
    #: Whether the stop rule ended the sweeps; False when their number did.
    converged: bool = True

    @property
    def rank(self) -> int:
        return len(self.weights)

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(f.length for f in self.factors)

    def value_at(self, cells: DataFrame, modes: Sequence[str] = T.MODES) -> DataFrame:
        """``cells`` with the model's ``estimate``."""
        return T.evaluate(cells, self.factors, self.weights, modes)

    def reconstruct(self, **options) -> Tensor:
        return T.reconstruct(self.factors, self.weights, **options)

    def error(self, tensor: Tensor, masked: bool = False) -> float:
        """Relative error; ``masked`` compares stored cells only, else absent cells count as zero.

        The full form uses ‖X−X̂‖² = ‖X‖² − 2⟨X,X̂⟩ + ‖X̂‖², so absent cells are never listed.
        """
        scored = self.value_at(tensor.cells, tensor.modes)
        row = scored.agg(
            F.sum(F.col("value") * F.col("value")).alias("xx"),
            F.sum(F.col("value") * F.col("estimate")).alias("xm"),
            F.sum((F.col("value") - F.col("estimate")) * (F.col("value") - F.col("estimate"))).alias("dd"),
        ).first()
        if not row["xx"]:
            return 0.0
        if masked:
            return math.sqrt(row["dd"] / row["xx"])
        grams = np.prod([T.gram(f.rows, f.columns) for f in self.factors], axis=0)
        model = float(self.weights @ grams @ self.weights)
        return math.sqrt(max(row["xx"] - 2 * row["xm"] + model, 0.0) / row["xx"])


class CellSource:
    """Products of a tensor that is stored as cells.

    The cells are kept in reliable storage; indexes too crowded for one task are found once, if at all.
    """

    def __init__(self, tensor: Tensor, rank: int):
        self.tensor = replace(tensor, cells=keep_table(tensor.cells.select(*tensor.modes, "value")))
        self.shape = tensor.shape
        row = self.tensor.cells.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col("value") * F.col("value")).alias("s"),
            F.approx_count_distinct(F.struct(*tensor.modes[1:])).alias("fibres"),
        ).first()
        self.squares = row["s"] or 0.0
        self.hot = [HotKeys(self.tensor.cells, [m], row["n"]) for m in tensor.modes]
        # Modes 1 and 2 share one pass over the cells when summing out mode 0 shrinks the table.
        self.shares = row["fibres"] * rank <= 2 * row["n"]

    @property
    def spark(self) -> SparkSession:
        return self.tensor.cells.sparkSession

    def share(self, factors: Sequence[Factor]) -> DataFrame | None:
        """``modes 1 and 2, t0..t{R-1}``: the tensor times the columns of the first factor."""
        if not self.shares:
            return None
        tensor, first = self.tensor, factors[0]
        joined = T.join_factor(tensor.cells, tensor.modes[0], first, "_a", tensor.modes[1:], self.hot[0])
        sums = [F.sum(F.col("value") * F.col(f"_a{r}")).alias(f"t{r}") for r in range(first.rank)]
        return keep_table(joined.groupBy(*tensor.modes[1:]).agg(*sums))

    def products(self, mode: int, factors: Sequence[Factor], shared: DataFrame | None) -> Factor:
        """Matricised tensor times Khatri-Rao product of the other factors."""
        if shared is None or mode == 0:
            return T.mttkrp(self.tensor, factors, mode, self.hot)
        column, other = self.tensor.modes[mode], self.tensor.modes[3 - mode]
        joined = T.join_factor(shared, other, factors[3 - mode], "_b", [column])
        rank = factors[mode].rank
        sums = [F.sum(F.col(f"t{r}") * F.col(f"_b{r}")).alias(f"f{r}") for r in range(rank)]
        return Factor(joined.groupBy(F.col(column).alias("idx")).agg(*sums), self.shape[mode], rank)


@dataclass
class _Update:
    factor: Factor
    gram: np.ndarray
    norms: np.ndarray
    inner: np.ndarray  # Σ over the index of mttkrp × new factor, per component
    table: DataFrame  # what the factor is computed from, in reliable storage


def _solve(products: Factor, others: np.ndarray, norm: str) -> _Update:
    """New factor = products · pinv(others), columns scaled by their norm.

    XᵀX of the products is one aggregate; Gram matrix, L2 norms and inner products of the new
    factor follow from it on the driver, so the factor itself is only a projection.  The products are
    a table, whose size the planner reads: a checkpoint would inherit an estimate, the product of
    the sizes of all that was joined, which grows without bound from sweep to sweep.
    """
    products = replace(products, rows=keep_table(products.rows))
    square = T.gram(products.rows, products.columns)
    inverse = np.linalg.pinv(others) if np.isfinite(others).all() else np.full_like(others, np.nan)
    raw = inverse.T @ square @ inverse
    if norm == "l2":
        norms = np.sqrt(np.maximum(np.diag(raw), 0.0))
    else:
        norms = T.column_max(T.times_matrix(products, inverse).rows, products.columns)
    scale = np.array([1.0 / n if n and math.isfinite(n) else 0.0 for n in norms])
    mix = inverse * scale
    return _Update(
        T.times_matrix(products, mix), raw * np.outer(scale, scale), norms, np.diag(square @ mix), products.rows,
    )


def cp_als(
    tensor: Tensor | CellSource,
    rank: int = 10,
    max_sweeps: int = 500,
    tolerance: float | None = 1e-4,
    seed: int = 6,
    norm: str = "l2",
    stop: str = "error",
    init: str = "gaussian",
    restarts: int = 3,
) -> CPModel:
    """Decompose a three-way tensor, given as cells or as any source of products.

    ``stop='error'`` ends when the relative error of two sweeps differs by at most ``tolerance``;
    ``stop='fit'`` when the fit does, strictly.  ``tolerance=None`` runs all sweeps.
    ``norm='l2'`` scales columns to length one; ``norm='max'`` does so in the first sweep and
    afterwards divides by the largest entry (at least 1).  Overflow restarts with another seed, at
    most ``restarts`` times; then an ArithmeticError names the seeds.  ``converged`` of the model
    tells whether the rule or the number of sweeps ended it.
    """
    if rank <= 0 or max_sweeps < 0 or (tolerance is not None and tolerance < 0):
        raise ValueError("rank must be positive, sweeps and tolerance not negative")
    if len(tensor.shape) != 3:
        raise ValueError("the tensor must have three modes")
    if norm not in ("l2", "max") or stop not in ("error", "fit"):
        raise ValueError("norm is 'l2' or 'max', stop is 'error' or 'fit'")
    source = CellSource(tensor, rank) if isinstance(tensor, Tensor) else tensor
    for attempt in range(restarts + 1):
        model = _attempt(source, rank, max_sweeps, tolerance, seed + attempt, norm, stop, init)
        if model is not None:
            return model
    raise ArithmeticError(f"the decomposition overflowed on every start, seeds {seed} to {seed + restarts}")


def _attempt(source, rank, max_sweeps, tolerance, seed, norm, stop, init) -> CPModel | None:
    factors = [T.initial_factor(source.spark, n, rank, seed, m, init) for m, n in enumerate(source.shape)]
    grams = [None, *[T.gram(f.rows, f.columns) for f in factors[1:]]]
    weights = np.ones(rank)
    errors: list[float] = []
    before, now, settled = math.inf, 0.0, False
    size = math.sqrt(source.squares)
    tables: list[DataFrame | None] = [None] * 3
    for sweep in range(max_sweeps):
        scaling = norm if sweep else "l2"
        shared = None
        for mode in range(3):
            others = [m for m in range(3) if m != mode]
            products = source.products(mode, factors, shared)
            update = _solve(products, grams[others[0]] * grams[others[1]], scaling)
            factors[mode], grams[mode] = update.factor, update.gram
            if tables[mode] is not None:
                forget_table(tables[mode])
            tables[mode] = update.table
            if mode == 0:
                shared = source.share(factors)
        if shared is not None:
            forget_table(shared)
        weights = update.norms
        if not math.isfinite(weights[0]):
            return None
        model_squares = abs(float(weights @ (grams[0] * grams[1] * grams[2]) @ weights))
        residue = math.sqrt(max(source.squares - 2.0 * float(weights @ update.inner) + model_squares, 0.0))
        before, now = now, (residue / size if size else 0.0)
        errors.append(now)
        if tolerance is None:
            continue
        fit_before = 0.0 if len(errors) == 1 else 1.0 - before
        settled = abs(before - now) <= tolerance if stop == "error" else abs((1.0 - now) - fit_before) < tolerance
        if settled:
            break
    return CPModel(tuple(factors), weights, tuple(errors), settled)


def cp_fit(
    tensor: Tensor, rank: int = 2, max_sweeps: int = 100, tolerance: float = 1e-4, seed: int = 6, init: str = "uniform"
) -> CPModel:
    """The variant that starts from uniforms, scales by the largest entry and stops on the fit."""
    return cp_als(tensor, rank, max_sweeps, tolerance, seed, norm="max", stop="fit", init=init)


# --- tables of a model ------------------------------------------------------------------------


def factor_table(factor: Factor, name: str) -> DataFrame:
    """``idx, {name}_r0..`` with all rows, zeros where none is stored."""
    return factor.filled().select("idx", *[F.col(c).alias(f"{name}_r{r}") for r, c in enumerate(factor.columns)])


def community_table(model: CPModel, index: DataFrame) -> DataFrame:
    """``id, A_r0.., B_r0..``: A is the source side of an edge, B the target side."""
    a, b = factor_table(model.factors[0], "A"), factor_table(model.factors[1], "B")
    return index.select("id", "idx").join(a, "idx").join(b, "idx").drop("idx")


def personality_table(model: CPModel, layers: Sequence[str]) -> DataFrame:
    """``layer, C_r0..``, one row per layer."""
    spark = model.factors[2].rows.sparkSession
    names = spark.createDataFrame([(n, name) for n, name in enumerate(layers)], "idx long, layer string")
    return names.join(factor_table(model.factors[2], "C"), "idx").drop("idx")


def weight_table(model: CPModel) -> DataFrame:
    """One row ``lambda_r0..``."""
    spark = model.factors[0].rows.sparkSession
    columns = ", ".join(f"lambda_r{r} double" for r in range(model.rank))
    return spark.createDataFrame([tuple(float(w) for w in model.weights)], columns)


def analyse_layers(
    tensor: Tensor, index: DataFrame, layers: Sequence[str], rank: int = 2, tolerance: float = 0.002,
    max_sweeps: int = 20, algorithm: str = "CPALS",
) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Community, personality and weight tables; an unknown algorithm leaves the tables unfactored."""
    if algorithm.upper() != "CPALS":
        import warnings

        warnings.warn(f"unknown decomposition {algorithm!r}; tables are left unfactored", stacklevel=2)
        spark = index.sparkSession
        return index.select("id"), spark.createDataFrame([(name,) for name in layers], "layer string"), None
    model = cp_als(tensor, rank, max_sweeps, tolerance)
    return community_table(model, index), personality_table(model, layers), weight_table(model)
