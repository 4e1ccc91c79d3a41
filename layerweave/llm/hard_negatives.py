"""Hard negatives by segment summaries: means and deviations of vector segments bound inner products before they are computed.

Over a segment of n components the inner product of two vectors is n times the product of their means plus the inner
product of what deviates from them, which is at most n times the product of the deviations either way.  Summed over the
segments this gives a lower and an upper bound.  Segments are halved level by level; a pair that the bounds decide is not
refined, all others are at last scored exactly in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from layerweave.session import keep_table

SCALE = 256
CANDIDATE_ROWS = 16_384
ANCHOR_ROWS = 512
# Numbers of segments, coarse to fine; every list of bounds is a multiple of the one before.
SEGMENTS = (8, 32)
# Pairs of rows whose coarse bounds are in memory at once.
STEP_PAIRS = 1 << 20


def prepared(embeddings: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``vec_id, label, width, vector, uid``: floor(scale * x) of every component, for the rows that take part.

    Rows whose id, label or vector is null, whose vector is empty or holds a null or non-finite component take no part.
    Rows that repeat id, label and vector count once.
    """
    x = F.transform("embedding", lambda value: F.floor(value.cast("double") * F.lit(scale)).cast("long"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    rows = embeddings.filter(sound & F.coalesce(finite, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size("embedding").alias("width"), x.alias("vector")).distinct()
    # Two rows of one id are two anchors.
    return rows.withColumn("uid", F.xxhash64("vec_id", "label", "vector"))


class Summaries:
    """Means and deviations of the segments of integer vectors, one pair of matrices per level."""

    def __init__(self, vectors: np.ndarray, levels: tuple[int, ...] = SEGMENTS):
        width = vectors.shape[1]
        values = vectors.astype(np.float64)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        for parts in levels:
            if parts >= width:
                break
            starts = np.arange(parts) * width // parts
            sizes = np.diff([*starts, width])
            mean = np.add.reduceat(values, starts, axis=1) / sizes
            off = values - np.repeat(mean, sizes, axis=1)
            # Both are scaled by the root of the segment's length, so that products need no further factor.
            root = np.sqrt(sizes)
            self.levels.append((mean * root, np.sqrt(np.add.reduceat(off * off, starts, axis=1))))

    def bounds(self, level: int, other: "Summaries", mine, others) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the products of rows ``mine`` with rows ``others`` of another set.

        A little is added for rounding, so that a bound never lies on the wrong side.
        """
        (mean, spread), (their_mean, their_spread) = self.levels[level], other.levels[level]
        middle, reach = mean[mine] @ their_mean[others].T, spread[mine] @ their_spread[others].T
        slack = 1e-9 * (np.abs(mean[mine]) @ np.abs(their_mean[others]).T + reach) + 1e-6
        return middle - reach - slack, middle + reach + slack


def undecided(asked: Summaries, known: Summaries, row: int, rows: np.ndarray, first: int, low: float, high: float, best: int | None) -> np.ndarray:
    """The ``rows`` whose product with ``row`` may lie in [low, high] and, with ``best``, among the ``best`` largest.

    Levels from ``first`` on are looked at, each for the rows that the one before left.
    """
    for level in range(first, len(asked.levels)):
        if not len(rows):
            break
        least, most = (b[0] for b in asked.bounds(level, known, slice(row, row + 1), rows))
        floor = low
        if best is not None and len(rows) > best:
            floor = max(floor, np.partition(least, len(rows) - best)[len(rows) - best])
        rows = rows[(most >= floor) & (least <= high)]
    return rows


def _matrix(table: pa.Table) -> np.ndarray:
    values = table.column("vector").combine_chunks()
    return values.flatten().to_numpy().reshape(table.num_rows, -1)


def _met(rows: DataFrame, anchors: DataFrame, counts: tuple[int, int], candidate_rows: int, anchor_rows: int) -> tuple[DataFrame, DataFrame]:
    """Anchors and rows dealt into a grid of cells of bounded size; equal vectors lie wherever their ids send them."""
    groups, blocks = max(1, -(-counts[1] // anchor_rows)), max(1, -(-counts[0] // candidate_rows))

    def dealt(side: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("uid"), F.lit(parts)).cast("int")
        # Columns of their own: the sides come from one table.
        own_columns = [F.col(c).alias(c) for c in side.columns]
        return side.select(*own_columns, mine.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    return dealt(anchors, "_a", groups, "_c", blocks), dealt(rows, "_c", blocks, "_a", groups)


def _cell_scores(asking: pa.Table, known: pa.Table, wanted) -> list[tuple[np.ndarray, ...]]:
    """``wanted`` for every anchor of a cell, with the rows that coarse bounds leave and the summaries for finer ones."""
    queries, vectors = _matrix(asking), _matrix(known)
    ask, have = Summaries(queries), Summaries(vectors)
    found, step = [], max(1, STEP_PAIRS // len(vectors))
    for begin in range(0, len(queries), step):
        here = slice(begin, min(begin + step, len(queries)))
        coarse = ask.bounds(0, have, here, slice(None)) if ask.levels else None
        for row in range(here.start, here.stop):
            least, most = (b[row - begin] for b in coarse) if coarse else (np.full(len(vectors), -np.inf), np.full(len(vectors), np.inf))
            found += wanted(row, queries[row], vectors, ask, have, least, most)
    return found


def _table(parts: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.Table:
    columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.empty(0, np.int64)] * len(schema)
    return pa.table([pa.array(c.astype(np.int64), pa.int64()) for c in columns], schema=schema)


def _longs(*names: str) -> tuple[pa.Schema, str]:
    return pa.schema([(n, pa.int64()) for n in names]), ", ".join(f"{n} long" for n in names)


def mine(
    embeddings: DataFrame, is_anchor: Column, label: Column | str = "label", positives: int = 5, negatives: int = 5,
    lowest_percent: int = 80, scale: int = SCALE, candidate_rows: int = CANDIDATE_ROWS, anchor_rows: int = ANCHOR_ROWS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``, exact.

    An anchor's positives are its best rows of the same label; for each of them the best rows of another label whose score
    lies between ``lowest_percent`` of the positive's score and that score.  Ties go to the smaller id,
    then label.  A row never meets rows of its own id, nor vectors of another length.  Fewer rows give all; an empty table gives none; rows that take no
    part and repeated rows are as in ``prepared``; two different rows of one id are two rows, and two anchors.
    """
    named = F.col(label) if isinstance(label, str) else label
    rows = keep_table(prepared(embeddings, named, scale))
    asks = is_anchor.alias("asks")
    counted = {r["asks"]: r["n"] for r in rows.groupBy(asks).agg(F.count(F.lit(1)).alias("n")).collect()}
    counts = sum(counted.values()), counted.get(True, 0)
    anchors = rows.filter(is_anchor)
    keys = ["width", "_a", "_c"]

    first_schema, first_columns = _longs("anchor", "anchor_id", "vec_id", "label", "score")

    def nearest(asking: pa.Table, known: pa.Table) -> pa.Table:
        if not asking.num_rows or not known.num_rows:
            return _table([], first_schema)
        uids, ask_ids, ask_labels = (asking.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        ids, labels = known.column("vec_id").to_numpy(), known.column("label").to_numpy()

        def wanted(row, query, vectors, ask, have, least, most):
            left = np.flatnonzero((labels == ask_labels[row]) & (ids != ask_ids[row]))
            if len(left) > positives:
                left = left[most[left] >= np.partition(least[left], len(left) - positives)[len(left) - positives]]
            left = undecided(ask, have, row, left, 1, -np.inf, np.inf, positives)
            score = vectors[left] @ query
            best = np.lexsort((ids[left], -score))[:positives]
            left, score = left[best], score[best]
            return [(np.full(len(left), uids[row]), np.full(len(left), ask_ids[row]), ids[left], labels[left], score)]

        return _table(_cell_scores(asking, known, wanted), first_schema)

    left, right = _met(rows, anchors, counts, candidate_rows, anchor_rows)
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, first_columns)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id", "label")
    chosen = near.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= positives)
    # At most ``positives`` rows per anchor; each anchor takes its own to every cell.
    held = F.sort_array(F.collect_list(F.struct("place", F.col("vec_id").alias("positive_id"), "score"))).alias("positives")
    seeking = anchors.join(chosen.groupBy(F.col("anchor").alias("uid")).agg(held).hint("merge"), "uid")

    second_schema, second_columns = _longs("anchor", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "label", "negative_score")

    def between(asking: pa.Table, known: pa.Table) -> pa.Table:
        if not asking.num_rows or not known.num_rows:
            return _table([], second_schema)
        uids, ask_ids, ask_labels = (asking.column(c).to_numpy() for c in ("uid", "vec_id", "label"))
        ids, labels, goals = known.column("vec_id").to_numpy(), known.column("label").to_numpy(), asking.column("positives").to_pylist()

        def wanted(row, query, vectors, ask, have, least, most):
            goal = [(g["place"], g["positive_id"], g["score"]) for g in goals[row] if 100 * g["score"] >= lowest_percent * g["score"]]
            if not goal:
                return []
            low, high = min(g[2] for g in goal) * lowest_percent / 100 - 1, max(g[2] for g in goal)
            left = np.flatnonzero((labels != ask_labels[row]) & (ids != ask_ids[row]) & (most >= low) & (least <= high))
            left = undecided(ask, have, row, left, 1, low, high, None)
            score = vectors[left] @ query
            best = np.lexsort((labels[left], ids[left], -score))
            left, score = left[best], score[best]
            made = []
            for place, positive_id, top in goal:
                fits = np.flatnonzero((100 * score >= lowest_percent * top) & (score <= top))[:negatives]
                n = len(fits)
                made.append((np.full(n, uids[row]), np.full(n, ask_ids[row]), np.full(n, place), np.full(n, positive_id), np.full(n, top), ids[left[fits]], labels[left[fits]], score[fits]))
            return made

        return _table(_cell_scores(asking, known, wanted), second_schema)

    left, right = _met(rows, seeking, counts, candidate_rows, anchor_rows)
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(between, second_columns)
    order = Window.partitionBy("anchor", "place").orderBy(F.col("negative_score").desc(), "negative_id", "label")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
