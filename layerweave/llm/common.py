"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of characters outside these; bytes.split() and bytes.lower() of Python follow the same sets.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; an id that is null counts as the empty text."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(parts)).cast("int")


def digest(text: Column | str) -> Column:
    """MD5 of a text; null counts as the empty text."""
    value = F.col(text) if isinstance(text, str) else text
    return F.md5(F.coalesce(value, F.lit("")))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column; null becomes the empty text."""
    return [value or b"" for value in batch.column(column).cast(pa.binary()).to_pylist()]


def largest_counts(counts: DataFrame, key: str, n: str, most: int) -> pa.Table:
    """Columns ``key, n`` of the largest counts, at most ``most`` of them, largest first.

    A histogram of the counts (eighths of a power of two, a few hundred rows) tells from which count on the rows are few
    enough; only those leave the executors, whatever the number of partitions.
    """
    step = F.floor(F.log2(F.col(n).cast("double")) * 8).cast("int")
    left, floor = most, None
    for row in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("least")).orderBy(F.col("step").desc()).collect():
        left -= row["rows"]
        if left < 0:
            break
        floor = row["least"]
    enough = F.lit(False) if floor is None else F.col(n) >= floor
    return counts.filter(enough).select(key, n).toArrow().sort_by([(n, "descending"), (key, "ascending")])


def bounded_sample(rows: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest hash of their keys.

    Beyond ``most`` rows the hash is cut at the share that is wanted first, so that no partition sorts or sends more.
    """
    total, hashed = rows.count(), F.xxhash64(*keys)
    if total > most:
        rows = rows.filter(F.pmod(hashed, F.lit(1 << 30)) < F.lit(int((1 << 30) * most / total)))
    return rows.orderBy(hashed, *keys).limit(most)


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch that returns one batch or None."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                made = run(batch)
                if made is not None:
                    yield made

    return df.mapInArrow(batches, schema)
