"""Exact top-k inner products by an impact-ordered index, read score at a time.

Vectors become integers.  The candidates are cut into blocks; a block keeps, for every component, its rows in descending
order of value in segments of fixed length.  The impact of a segment for a query is the largest product it can hold.
A query reads segments in descending impact, adds exact products, and stops as soon as the bounds prove that every row
still able to reach the k best is known; those rows are scored again in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SCALE = 1024
BLOCK_ROWS = 4096
QUERY_ROWS = 512
SEGMENT_ROWS = 256
# Shares of the segments after which the bounds are looked at, and the share of rows (1/FEW) that is cheap to score again.
LOOKS = (0.4, 0.7, 1.0)
FEW = 4


class ImpactBlock:
    """The index of one block of integer vectors.  Sums of products stay below 2^53, where doubles are exact."""

    def __init__(self, vectors: np.ndarray, segment_rows: int = SEGMENT_ROWS):
        self.vectors = vectors.astype(np.float64)
        rows, self.width = vectors.shape
        self.segments = -(-rows // segment_rows)
        # The last segment is filled up with a row past the end, whose score nobody reads.
        filled = np.full((self.segments * segment_rows, self.width), rows)
        filled[:rows] = np.argsort(-vectors, axis=0, kind="stable")  # per component, descending value
        values = np.take_along_axis(np.vstack([self.vectors, np.zeros((1, self.width))]), filled, axis=0)
        shape = (self.segments, segment_rows, self.width)
        self.order = np.ascontiguousarray(filled.reshape(shape).transpose(0, 2, 1))  # segment, component, row of the segment
        self.values = np.ascontiguousarray(values.reshape(shape).transpose(0, 2, 1))
        starts = np.arange(self.segments) * segment_rows
        self.top = values[starts]
        self.bottom = values[np.minimum(starts + segment_rows, rows) - 1]  # segment x component

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best, proved complete; ties with the k-th stay in."""
        rows = len(self.vectors)
        if rows <= k:
            return np.arange(rows)
        # A negative component reads its segments from the smallest values upwards.
        up = query < 0
        impact = np.where(up, self.bottom[::-1] * query, self.top * query)  # falls along the segments of a component
        reading = np.argsort(-impact, axis=None, kind="stable")
        score, read = np.zeros(rows + 1), np.zeros(self.width, np.int64)
        places, components = np.divmod(reading, self.width)
        segments = np.where(up[components], self.segments - 1 - places, places)
        found, ends = [], (np.array(LOOKS) * len(reading)).astype(int)
        for begin, end in zip([0, *ends], ends):
            now = components[begin:end]
            found.append(self.order[segments[begin:end], now])
            products = self.values[segments[begin:end], now] * query[now, None]
            score += np.bincount(found[-1].ravel(), products.ravel(), rows + 1)
            read += np.bincount(now, minlength=self.width)
            # What a row may still gain on the components where it was not read yet.
            rest = np.where(read < self.segments, impact[np.minimum(read, self.segments - 1), np.arange(self.width)], 0)
            settled = np.repeat(rest[components[:end]], self.order.shape[2])
            most = (score + rest.sum() - np.bincount(np.concatenate(found).ravel(), settled, rows + 1))[:rows]
            # Any k rows give a floor for the k-th best; the most promising ones give a high one.
            likely = np.argpartition(-most, k - 1)[:k]
            possible = np.flatnonzero(most >= (self.vectors[likely] @ query).min())
            if len(possible) <= max(k, rows // FEW):
                break
        return possible

    def best(self, query: np.ndarray, query_id: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best rows other than the query's own, ties to the smaller id."""
        own = int(np.count_nonzero(ids == query_id))
        rows = self.candidates(query.astype(np.float64), k + own)
        rows = rows[ids[rows] != query_id]
        scores = (self.vectors[rows] @ query).astype(np.int64)
        chosen = np.lexsort((ids[rows], -scores))[:k]
        return ids[rows][chosen], scores[chosen]


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table.column("vec_id").to_numpy()
    values = pa.chunked_array(table.column("vector")).combine_chunks()
    return ids, values.flatten().to_numpy().reshape(len(ids), -1)


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, width, vector`` of the rows that take part: floor(scale * x) of every component."""
    x = F.transform("embedding", lambda value: F.floor(value.cast("double") * F.lit(scale)).cast("long"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    return embeddings.filter(sound & F.coalesce(finite, F.lit(False))).select("vec_id", F.size("embedding").alias("width"), x.alias("vector"))


def top_k(
    embeddings: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for every query row, exact.

    Query blocks meet candidate blocks; each meeting is one group of bounded size, whatever the values, so equal vectors
    make no hot group.  Rows whose id or vector is null, empty, or not finite take no part; vectors of different length
    do not meet; rows that repeat an id and vector count once; a query never finds its own id.  Fewer rows than ``k``
    give all; an empty table gives none.
    """
    rows = usable(embeddings, scale).distinct()
    queries = rows.filter(is_query)
    sizes = {
        (r["width"], r["asks"]): r["n"]
        for r in rows.groupBy("width", is_query.alias("asks")).agg(F.count(F.lit(1)).alias("n")).limit(1024).collect()
    }
    total, asked = sum(sizes.values()), sum(n for (_, asks), n in sizes.items() if asks)
    blocks, groups = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))

    def of(side: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        mine = F.pmod(F.xxhash64("vec_id", "vector"), F.lit(parts)).cast("int")
        return side.withColumn(own, mine).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    left, right = of(queries, "_q", groups, "_c", blocks), of(rows, "_c", blocks, "_q", groups)

    def search(asking: pa.Table, known: pa.Table) -> pa.Table:
        out: list[tuple] = [np.empty(0, np.int64)] * 3
        if asking.num_rows and known.num_rows:
            query_ids, wanted = _vectors(asking)
            ids, vectors = _vectors(known)
            block, parts = ImpactBlock(vectors), []
            for query_id, query in zip(query_ids, wanted):
                found, scores = block.best(query, query_id, ids, k)
                parts.append((np.full(len(found), query_id), found, scores))
            out = [np.concatenate(column) for column in zip(*parts)]
        return pa.table({"query_id": out[0], "vec_id": out[1], "score": out[2]}, schema=schema)

    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    keys = ["width", "_q", "_c"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score long")
    best_first = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(best_first).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
