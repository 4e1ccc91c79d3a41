"""Equi-joins that survive a key holding a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave import session
from layerweave.session import cut_lineage

# A key is hot when it holds more than 1/HOT_KEYS of the rows, so there are fewer than HOT_KEYS
# hot keys however large the table is: some ten megabytes, always small enough to broadcast.
HOT_KEYS = 200_000
# Groups over which the rows without a key are spread in a join that keeps them.
NULL_SALTS = 4096
# Below this many rows a whole table fits one task and no key needs splitting.
TASK_ROWS = 1_000_000


def tasks_for(df: DataFrame, rows: int, share: int = 1) -> int:
    """Tasks for so many rows: what the session sets, more if one of them would get above ``share`` times TASK_ROWS."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (share * TASK_ROWS)) if TASK_ROWS else 0)


def hot_keys(
    df: DataFrame, keys: Sequence[str], total: int, task_rows: int | None = None, bounded: bool = True
) -> DataFrame | None:
    """``keys..., splits`` for every key whose rows do not fit one task; None when there is none.

    Counts are combined map-side, so a hot key costs one row per map task.  The few rows found are
    kept, because joins in a loop ask for them again and again.  ``bounded`` holds the table below
    HOT_KEYS rows by letting the rows per task grow; without it every split has ``task_rows``.
    """
    task_rows = TASK_ROWS if task_rows is None else task_rows
    if total <= task_rows:
        return None
    limit = max(task_rows, -(-total // HOT_KEYS)) if bounded else task_rows
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    found = counts.filter(F.col("_rows") > F.lit(limit)).select(
        *keys, F.ceil(F.col("_rows") / F.lit(limit)).cast("int").alias("splits")
    )
    found = cut_lineage(found)
    return None if found.isEmpty() else found


def with_salt(big: DataFrame, keys: Sequence[str], spread: Sequence[Column], hot: DataFrame) -> DataFrame:
    """Add ``_salt``: 0 for ordinary keys, one of ``splits`` numbers for the rows of a hot key."""
    own = F.pmod(F.xxhash64(*spread), F.col("splits"))
    # A NULL key meets nothing, so its rows may lie anywhere.
    nowhere = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    salt = F.when(nowhere, F.pmod(F.xxhash64(*spread), F.lit(NULL_SALTS))).when(F.col("splits").isNull(), F.lit(0)).otherwise(own)
    return big.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt.cast("int")).drop("splits")


def for_each_salt(small: DataFrame, keys: Sequence[str], hot: DataFrame) -> DataFrame:
    """One copy of a row per salt of its key."""
    last = F.coalesce(F.col("splits"), F.lit(1)) - F.lit(1)
    return (
        small.join(F.broadcast(hot), list(keys), "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), last)))
        .drop("splits")
    )


class HotKeys:
    """The hot keys of a table, looked for only when a join turns out to need them."""

    def __init__(self, df: DataFrame, keys: Sequence[str], rows: int | None = None):
        self.df, self.keys, self.rows = df, list(keys), rows

    @cached_property
    def table(self) -> DataFrame | None:
        rows = self.df.count() if self.rows is None else self.rows
        return hot_keys(self.df, self.keys, rows)


def fits_broadcast(rows: int | None, columns: int, text_bytes: int = 0) -> bool:
    """Whether so many rows of so many columns, and so much text, stay below the broadcast limit."""
    return rows is not None and rows * (32 + 24 * columns) + text_bytes <= session.BROADCAST_BYTES


def spread_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread: Sequence[Column],
    hot: HotKeys,
    small_rows: int | None = None,
    how: str = "inner",
    text_bytes: int = 0,
) -> DataFrame:
    """Join ``big`` with ``small``, which holds one or few rows per key.

    ``small_rows`` (and ``text_bytes`` for text columns) bound its size: below the broadcast limit ``small`` goes to every
    task and ``big`` does not move.  Beyond it both sides shuffle, and the rows of a hot key are
    spread over ``splits`` groups by the columns ``spread``, with one copy of its ``small`` rows per
    group.  The planner never gets to choose: it would take the compressed size of ``big`` for its
    size and broadcast that.  ``how`` may be inner or left (big side).
    """
    if fits_broadcast(small_rows, len(small.columns), text_bytes):
        return big.join(F.broadcast(small), list(keys), how)
    table = hot.table
    if table is None:
        return big.join(small.hint("merge"), list(keys), how)
    left, right = with_salt(big, keys, spread, table), for_each_salt(small, keys, table)
    return left.join(right.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def key_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_rows: int, right_rows: int, block_rows: int
) -> DataFrame | None:
    """``keys..., _left_blocks, _right_blocks`` for the keys that are crowded on either side; no block is larger."""
    left_hot = hot_keys(left, keys, left_rows, block_rows, bounded=False)
    right_hot = hot_keys(right, keys, right_rows, block_rows, bounded=False)
    if left_hot is None and right_hot is None:
        return None
    one = F.lit(1)
    if right_hot is None:
        return left_hot.select(*keys, F.col("splits").alias("_left_blocks"), one.alias("_right_blocks"))
    if left_hot is None:
        return right_hot.select(*keys, one.alias("_left_blocks"), F.col("splits").alias("_right_blocks"))
    both = left_hot.withColumnRenamed("splits", "_left_blocks").join(
        right_hot.withColumnRenamed("splits", "_right_blocks"), list(keys), "full"
    )
    return both.na.fill(1, ["_left_blocks", "_right_blocks"])


def block_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_spread: Sequence[Column],
    right_spread: Sequence[Column],
    blocks: DataFrame | None,
    right_rows: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Many-to-many equi-join in which a crowded key becomes a grid of tasks.

    Each side of such a key is cut into blocks and copied once per block of the other side, so
    every pair still meets exactly once and no task sees more than one block of either side.
    ``blocks`` has one row per crowded key (see ``key_blocks``) or per bin and is broadcast only when
    they are few.  A right
    side whose known size is below the broadcast limit goes to every task instead; the caller has
    then spread ``left``.  ``tasks`` fixes the number of tasks of the shuffle form, for joins whose
    output is far larger than the input by which adaptive execution would merge partitions.
    """
    if fits_broadcast(right_rows, len(right.columns)):
        return left.join(F.broadcast(right), list(keys))

    def met(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
        if not tasks:
            return a.join(b.hint("merge"), list(on))
        # One key of all columns: a column that is the same everywhere would drop out of the join's keys, and both sides
        # would shuffle again, into as few tasks as the session sets.
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in on])
        # The coalesce only tells the planner that nothing is null, so that both sides have keys of one type.
        cell = F.struct(*[F.coalesce(F.col(k), F.lit(0).cast(a.schema[k].dataType)).alias(k) for k in on])
        cells = [side.filter(known).withColumn("_cell", cell) for side in (a, b)]
        return cells[0].repartition(tasks, "_cell").join(cells[1].drop(*on).repartition(tasks, "_cell").hint("merge"), "_cell").drop("_cell")

    if blocks is None:
        return met(left, right, keys)
    blocks = F.broadcast(blocks) if fits_broadcast(blocks.count(), len(blocks.columns)) else blocks.hint("merge")

    def cut(side: DataFrame, own: str, own_block: str, other: str, other_block: str, spread: Sequence[Column]) -> DataFrame:
        own_blocks, other_blocks = F.coalesce(F.col(own), F.lit(1)), F.coalesce(F.col(other), F.lit(1))
        return (
            side.join(blocks, list(keys), "left")
            .withColumn(own_block, F.pmod(F.xxhash64(*spread), own_blocks).cast("int"))
            .withColumn(other_block, F.explode(F.sequence(F.lit(0), (other_blocks - 1).cast("int"))))
            .drop(own, other)
        )

    a = cut(left, "_left_blocks", "_lb", "_right_blocks", "_rb", left_spread)
    b = cut(right, "_right_blocks", "_rb", "_left_blocks", "_lb", right_spread)
    grid = [*keys, "_lb", "_rb"]
    return met(a, b, grid).drop("_lb", "_rb")
