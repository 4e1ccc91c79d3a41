"""Updating a decomposition when new slices arrive on one mode of the tensor.

A weighted sample of the known tensor, with the new slices behind it, is decomposed; its
components are matched with the known ones, rescaled, and only the new rows and the cells that
were still zero are taken over.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerweave.functions.hashing import md5_uniform
from layerweave.operators import tensor as T
from layerweave.operators.cp import CPModel, cp_als
from layerweave.operators.ordering import dense_index
from layerweave.operators.skew import HotKeys, spread_join
from layerweave.operators.tensor import Factor, Tensor
from layerweave.session import cut_lineage, keep_table

# Fixed value: entries below this are zero.
EPSILON = 1e-7
# A sample up to this many indexes is picked by a top-N and numbered in one small task.
SMALL_SAMPLE = 10_000


def slice_weights(tensor: Tensor, mode: int) -> DataFrame:
    """``idx, weight``: sum of squares of every slice along a mode."""
    return tensor.cells.groupBy(F.col(tensor.modes[mode]).alias("idx")).agg(
        F.sum(F.col("value") * F.col("value")).alias("weight")
    )


def weighted_sample(weights: DataFrame, size: int, seed: int, mode: int) -> DataFrame:
    """``idx, new``: ``size`` indexes, drawn without replacement with chance by weight, renumbered.

    Keeps the largest u^(1/weight), compared as ln(u)/weight, which does not round to one for heavy
    slices.  u depends on (seed, mode, idx) only.
    """
    score = F.log(md5_uniform(F.lit(seed), F.lit(mode), F.col("idx"))) / F.col("weight")
    scored = weights.filter(F.col("weight") > 0).select("idx", score.alias("_score"))
    order = [F.desc("_score"), F.asc("idx")]
    if size <= SMALL_SAMPLE:
        chosen = scored.orderBy(*order).limit(size)
        number = F.row_number().over(Window.orderBy("idx")).cast("long") - 1
        return chosen.select("idx", number.alias("new"))
    chosen = dense_index(scored, order, "_place").filter(F.col("_place") < size)
    return dense_index(chosen.select("idx"), [F.col("idx")], "new").select("idx", "new")


def restrict(tensor: Tensor, maps: Sequence[DataFrame | None], sizes: Sequence[int]) -> Tensor:
    """Cells whose index is in the sample of every mode, renumbered; ``None`` keeps a mode as it is.

    The join with a map filters and renumbers at once.
    """
    cells = tensor.cells.select(*tensor.modes, "value")
    for mode, chosen in enumerate(maps):
        if chosen is None:
            continue
        column = tensor.modes[mode]
        pairs = chosen.select(F.col("idx").alias(column), F.col("new").alias("_new"))
        spread = [F.col(m) for m in T.without(tensor.modes, mode)]
        cells = spread_join(cells, pairs, [column], spread, HotKeys(cells, [column]), sizes[mode])
        cells = cells.withColumn(column, F.col("_new")).drop("_new")
    return Tensor(cells.select(*tensor.modes, "value"), tuple(sizes), tensor.modes)


def restrict_factor(factor: Factor, chosen: DataFrame, size: int) -> Factor:
    """The factor rows of the sampled indexes, renumbered."""
    rows = factor.rows.join(chosen, "idx").drop("idx").withColumnRenamed("new", "idx")
    return Factor(rows.select("idx", *factor.columns), size, factor.rank)


def best_matching(cost: np.ndarray) -> list[int]:
    """Column of every row in the cheapest one-to-one matching of a small square matrix.

    Rows are added one at a time; each is fitted in along the cheapest chain of exchanges.
    """
    size = len(cost)
    row_price, column_price = np.zeros(size), np.zeros(size + 1)
    owner = np.full(size + 1, -1)  # the last column is the entry point of the row being added
    for row in range(size):
        owner[size] = row
        reach = np.full(size, np.inf)
        came_from = np.full(size, size)
        done = np.zeros(size + 1, dtype=bool)
        at = size
        while owner[at] >= 0:
            done[at] = True
            reduced = cost[owner[at]] - row_price[owner[at]] - column_price[:size]
            better = ~done[:size] & (reduced < reach)
            reach[better], came_from[better] = reduced[better], at
            nearest = int(np.argmin(np.where(done[:size], np.inf, reach)))
            step = reach[nearest]
            row_price[owner[done]] += step
            column_price[done] -= step
            reach[~done[:size]] -= step
            at = nearest
        while at != size:
            owner[at] = owner[came_from[at]]
            at = came_from[at]
    result = [0] * size
    for column in range(size):
        result[owner[column]] = column
    return result


def _side_by_side(chosen: DataFrame, new: Factor, known: Factor) -> DataFrame:
    """``n0.., o0..`` per sampled index: new and known rows, zeros where none is stored."""
    a = new.rows.select(F.col("idx").alias("new"), *[F.col(c).alias(f"n{r}") for r, c in enumerate(new.columns)])
    b = known.rows.select("idx", *[F.col(c).alias(f"o{r}") for r, c in enumerate(known.columns)])
    columns = [f"{side}{r}" for side in "no" for r in range(new.rank)]
    return chosen.join(a, "new", "left").join(b, "idx", "left").na.fill(0.0, columns)


def match_components(pairs: DataFrame, rank: int) -> list[int]:
    """Known component of every new one: the matching with the largest total |cosine|."""
    products = [F.sum(F.col(f"n{r}") * F.col(f"o{s}")).alias(f"p{r}_{s}") for r in range(rank) for s in range(rank)]
    squares = [F.sum(F.col(f"{side}{r}") * F.col(f"{side}{r}")).alias(f"{side}{r}") for side in "no" for r in range(rank)]
    row = pairs.agg(*products, *squares).first()
    similarity = np.zeros((rank, rank))
    for r in range(rank):
        for s in range(rank):
            scale = ((row[f"n{r}"] or 0.0) * (row[f"o{s}"] or 0.0)) ** 0.5
            similarity[r, s] = abs(row[f"p{r}_{s}"] or 0.0) / scale if scale else 0.0
    return best_matching(1.0 - similarity)


def reorder(factor: Factor, place: Sequence[int]) -> Factor:
    """Put column r at ``place[r]``."""
    source = {p: r for r, p in enumerate(place)}
    return replace(factor, rows=factor.rows.select("idx", *[F.col(f"f{source[s]}").alias(f"f{s}") for s in range(factor.rank)]))


def align_scales(pairs: DataFrame, rank: int) -> np.ndarray:
    """Per column: norm of the known rows over norm of the new rows, with the sign most rows agree on."""
    sign = lambda c: F.when(F.col(c) >= 0, 1.0).otherwise(-1.0)
    sums = []
    for r in range(rank):
        sums += [
            F.sqrt(F.sum(F.col(f"o{r}") * F.col(f"o{r}"))).alias(f"o{r}"),
            F.sqrt(F.sum(F.col(f"n{r}") * F.col(f"n{r}"))).alias(f"n{r}"),
            F.sum(sign(f"o{r}") * sign(f"n{r}")).alias(f"s{r}"),
        ]
    row = pairs.agg(*sums).first()
    out = np.zeros(rank)
    for r in range(rank):
        ratio = (row[f"o{r}"] or 0.0) / row[f"n{r}"] if row[f"n{r}"] else 0.0
        out[r] = ratio * (1.0 if (row[f"s{r}"] or 0.0) >= 0 else -1.0)
    return out


def scale_by(factor: Factor, scales: np.ndarray) -> Factor:
    scaled = {c: F.col(c) * F.lit(float(s)) for c, s in zip(factor.columns, scales)}
    return replace(factor, rows=factor.rows.withColumns(scaled))


def fill_zero_cells(known: Factor, fresh: DataFrame) -> Factor:
    """Take entries of ``fresh`` where the known entry is zero; ``fresh`` has the known indexes."""
    other = fresh.select("idx", *[F.col(c).alias(f"_{c}") for c in known.columns])

    def pick(c: str) -> Column:
        old = F.coalesce(F.col(c), F.lit(0.0))
        return F.when(F.abs(old) < EPSILON, F.coalesce(F.col(f"_{c}"), old)).otherwise(old).alias(c)

    rows = known.rows.join(other, "idx", "full").select("idx", *[pick(c) for c in known.columns])
    return replace(known, rows=rows)


@dataclass(frozen=True)
class IncrementalCP:
    """A stored tensor and its model, ready to receive slices on ``mode``.

    The cells of ``tensor`` lie in reliable storage and are never copied.  ``weights`` holds
    ``idx, weight`` per mode: small tables to which every batch adds its own cells.
    """

    tensor: Tensor
    model: CPModel
    mode: int = 2
    sampling_factor: int = 2
    repetitions: int = 1
    max_sweeps: int = 500
    tolerance: float = 1e-4
    seed: int = 0
    weights: tuple[DataFrame, ...] | None = None

    def slice_weights(self) -> tuple[DataFrame, ...]:
        """Sums of squares of the slices of every mode; computed from the cells only if nobody kept them."""
        return self.weights or tuple(cut_lineage(slice_weights(self.tensor, m)) for m in range(self.tensor.order))

    def _grown_weights(self, known: Sequence[DataFrame], slices: Tensor) -> tuple[DataFrame, ...]:
        """The weights with those of the new slices added."""
        grown = []
        for m, before in enumerate(known):
            added = slice_weights(slices, m)
            if m == self.mode:
                added = added.withColumn("idx", F.col("idx") + F.lit(self.tensor.shape[m]))
            both = before.unionByName(added).groupBy("idx").agg(F.sum("weight").alias("weight"))
            grown.append(cut_lineage(both))
        return tuple(grown)

    def receive(self, slices: Tensor) -> IncrementalCP:
        """The state after the new slices, whose index on ``mode`` counts from zero."""
        tensor, mode, rank = self.tensor, self.mode, self.model.rank
        if T.without(tensor.shape, mode) != T.without(slices.shape, mode):
            raise ValueError(f"slices {slices.shape} do not fit {tensor.shape}")
        known, weights = tensor, self.slice_weights()
        slices = replace(slices, cells=keep_table(slices.cells.select(*slices.modes, "value")))
        batch = slices.shape[mode]
        factors = list(self.model.factors)
        collected: list[DataFrame] = []
        for repetition in range(self.repetitions):
            seed = self.seed + repetition
            maps, sizes = [], []
            for m in range(tensor.order):
                size = max(1, tensor.shape[m] // self.sampling_factor)
                chosen = cut_lineage(weighted_sample(weights[m], size, seed, m))
                maps.append(chosen)
                sizes.append(chosen.count())
            sample = restrict(known, maps, sizes)
            cut = restrict(slices, [None if m == mode else c for m, c in enumerate(maps)], T.updated(sizes, mode, batch))
            found = cp_als(T.append_mode(sample, cut, mode), rank, self.max_sweeps, self.tolerance, seed + 6)
            pairs = _side_by_side(maps[0], found.factors[0], factors[0])
            place = match_components(pairs, rank)
            for m in range(tensor.order):
                fresh = reorder(found.factors[m], place)
                fresh = scale_by(fresh, align_scales(_side_by_side(maps[m], fresh, factors[m]), rank))
                old_rows = fresh.rows.withColumnRenamed("idx", "new").join(maps[m], "new").select("idx", *fresh.columns)
                factors[m] = fill_zero_cells(factors[m], old_rows)
                factors[m] = replace(factors[m], rows=cut_lineage(factors[m].rows))
                if m == mode:
                    behind = F.col("idx") - F.lit(sizes[mode]) + F.lit(tensor.shape[mode])
                    share = {c: F.col(c) / F.lit(float(self.repetitions)) for c in fresh.columns}
                    new_rows = fresh.rows.filter(F.col("idx") >= sizes[mode])
                    collected.append(cut_lineage(new_rows.withColumn("idx", behind).withColumns(share)))
        columns = T.factor_columns(rank)
        appended = reduce(DataFrame.unionByName, collected).groupBy("idx").agg(*[F.sum(c).alias(c) for c in columns])
        grown = factors[mode].rows.unionByName(appended)
        factors[mode] = Factor(cut_lineage(grown), tensor.shape[mode] + batch, rank)
        model = CPModel(tuple(factors), self.model.weights)
        return replace(
            self, tensor=T.append_mode(known, slices, mode), model=model, seed=self.seed + self.repetitions,
            weights=self._grown_weights(weights, slices),
        )


def start(
    tensor: Tensor, rank: int = 5, mode: int = 2, sampling_factor: int = 2, repetitions: int = 1,
    max_sweeps: int = 500, tolerance: float = 1e-4, seed: int = 0,
) -> IncrementalCP:
    """Decompose the first slices and keep them, with their weights, ready for more."""
    tensor = replace(tensor, cells=keep_table(tensor.cells.select(*tensor.modes, "value")))
    model = cp_als(tensor, rank, max_sweeps, tolerance, seed + 6)
    state = IncrementalCP(tensor, model, mode, sampling_factor, repetitions, max_sweeps, tolerance, seed)
    return replace(state, weights=state.slice_weights())
