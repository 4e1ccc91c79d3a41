"""Edges of a score layer: pairs of people whose mean score lies in a band.

The pair search is a theta self-join.  People are sorted by score and cut into short lists and blocks of lists, and
two lists meet in a task when a pair out of them can be inside a band.  A score that a third of the
people share is cut like all others, so it becomes many tasks of bounded size instead of one.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.operators.ordering import laid_out
from layerweave.operators.skew import block_join
from layerweave.session import cut_lineage, keep_table

UP, DOWN, BOTH = "up", "down", "both"
# Candidate pairs that one task should meet.
PAIRS_PER_TASK = 20_000_000
# Tasks of the edge search, per core of the cluster at most.
TASKS_PER_CORE = 64
# Pairs of blocks that one task should get, so that the tasks come out even.
CELLS_PER_TASK = 16
# People of a list.
CHUNK_ROWS = 128


@dataclass(frozen=True)
class Band:
    """An interval of the mean score of a pair."""

    low: float | None = None
    high: float | None = None
    low_closed: bool = True
    high_closed: bool = False

    def holds(self, mean: Column) -> Column:
        parts = []
        if self.low is not None:
            parts.append(mean >= self.low if self.low_closed else mean > self.low)
        if self.high is not None:
            parts.append(mean <= self.high if self.high_closed else mean < self.high)
        return reduce(Column.__and__, parts)

    def reached(self, least: Column, most: Column) -> Column:
        """Whether a mean between two values can lie in the band."""
        parts = []
        if self.low is not None:
            parts.append(most >= self.low if self.low_closed else most > self.low)
        if self.high is not None:
            parts.append(least <= self.high if self.high_closed else least < self.high)
        return reduce(Column.__and__, parts)


@dataclass(frozen=True)
class LayerRule:
    """Bands of the mean and the direction an edge points: to the higher score, lower, or both."""

    bands: tuple[Band, ...]
    direction: str = UP

    def holds(self, src: Column, dst: Column) -> Column:
        mean = (src + dst) / F.lit(2.0)
        inside = reduce(Column.__or__, [band.holds(mean) for band in self.bands])
        if self.direction == UP:
            return inside & (src < dst)
        if self.direction == DOWN:
            return inside & (src > dst)
        return inside

    def can_hold(self, src_low: Column, src_high: Column, dst_low: Column, dst_high: Column) -> Column:
        """Whether a source and a target with scores between these ends can be an edge.

        A rounded mean grows with either score, so the means of the ends are exact bounds of all means.
        """
        least, most = (src_low + dst_low) / F.lit(2.0), (src_high + dst_high) / F.lit(2.0)
        inside = reduce(Column.__or__, [band.reached(least, most) for band in self.bands])
        if self.direction == UP:
            return inside & (src_low < dst_high)
        if self.direction == DOWN:
            return inside & (src_high > dst_low)
        return inside


# The bands and directions of the five factors, of any other layer, and of the
# single-layer network.
RULES = {
    "OPN": LayerRule((Band(1.0, 3.0),)),
    "CSN": LayerRule((Band(1.0, 3.0), Band(-3.0, -1.0, low_closed=False, high_closed=True))),
    "EXT": LayerRule((Band(1.0, 3.0),)),
    "AGR": LayerRule((Band(1.0, 3.0), Band(-1.0, 1.0, low_closed=False))),
    "NEU": LayerRule((Band(-3.0, -1.0),), DOWN),
}
DEFAULT_RULE = LayerRule((Band(2.0),), BOTH)
SIMPLE_RULE = LayerRule((Band(1.0),), BOTH)


def rule_for(layer: str) -> LayerRule:
    """The rule of the factor that the layer name starts with, else the default rule."""
    return next((rule for factor, rule in RULES.items() if layer.startswith(factor)), DEFAULT_RULE)


def listed_people(people: DataFrame, source: Sequence[str], target: Sequence[str], block_rows: int) -> tuple[DataFrame, int]:
    """People in the order of their scores, in lists of at most CHUNK_ROWS; and the tasks of the search.

    ``layer, block, low, high, sources, targets``: the scores of a list lie between ``low`` and ``high``, lists that follow each
    other form a block of at most ``block_rows`` people.  Equal scores may lie in several lists.
    """
    spark = people.sparkSession
    rows = laid_out(people, ["z", "id"], ["layer"])
    counts = [row["n"] for row in rows.groupBy("layer").agg(F.count(F.lit(1)).alias("n")).collect()]  # a row per layer
    # The output is a share of all pairs: the tasks are sized by it, not by the few bytes that go in, but
    # are no more than a scheduler handles well.
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = max(least, TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    tasks = min(most, max(least, sum(counts) ** 2 // PAIRS_PER_TASK))
    size = min(block_rows, max(CHUNK_ROWS, math.isqrt(sum(n * n for n in counts) // (CELLS_PER_TASK * tasks))))
    at = F.col("_at") - F.shiftleft(F.col("_part"), 33)
    block, chunk = F.floor(at / F.lit(size)), F.floor(F.pmod(at, F.lit(size)) / F.lit(CHUNK_ROWS))
    keys = ["layer", "_part", "_block", "_chunk"]
    # Lists are copied to many blocks: so many tasks should read them, however small they are.
    placed = rows.withColumns({"_block": block, "_chunk": chunk}).repartition(least, *keys)
    lists = placed.groupBy(*keys).agg(
        F.min("z").alias("low"), F.max("z").alias("high"),
        F.collect_list(F.struct("id", "z", *source)).alias("sources"), F.collect_list(F.struct("id", "z", *target)).alias("targets"),
    )
    block = (F.shiftleft(F.col("_part"), 33) + F.col("_block")).alias("block")
    return keep_table(lists.select("layer", block, "low", "high", "sources", "targets")), tasks


def layer_edges(
    people: DataFrame,
    rules: dict[str, LayerRule] | None = None,
    block_rows: int = 16_384,
    source_columns: Sequence[str] = (),
    target_columns: Sequence[str] = (),
) -> DataFrame:
    """All edges of all layers in one join: ``layer, src, dst, src_z, dst_z``.

    ``people`` holds ``layer, id, z``; rules are looked up by layer.  Every pair is met in exactly
    one pair of lists, so nothing has to be made distinct afterwards.
    Columns of the people that an edge should have come along as ``src_*`` and ``dst_*``, which
    spares a join of the edges with the people.

    Edges come list by list: the same few targets for one source after the other, in the order of the scores.  A columnar
    file then holds a source as one run and a list of targets as a repetition of the one before, a small part
    of the bytes that the same rows take in another order.
    """
    others = [[c for c in columns if c != "z"] for columns in (source_columns, target_columns)]
    people = people.select("layer", "id", "z", *dict.fromkeys([*others[0], *others[1]]))
    if rules is None:
        rules = {row["layer"]: rule_for(row["layer"]) for row in people.select("layer").distinct().collect()}
    known = F.col("layer").isin(*rules) & F.col("id").isNotNull() & F.col("z").isNotNull()
    lists, tasks = listed_people(people.filter(known), *others, block_rows)
    # Which rule holds, as a number: it is asked once an edge.
    number = reduce(lambda chain, n: F.when(F.col("layer") == n[1], F.lit(n[0])).otherwise(chain), enumerate(rules), F.lit(-1))

    def by_rule(build) -> Column:
        return reduce(lambda chain, n: F.when(F.col("_rule") == n[0], build(n[1])).otherwise(chain), enumerate(rules.values()), F.lit(False))

    ends = [F.col(c) for c in ("low", "high", "dst_low", "dst_high")]
    can_hold = by_rule(lambda rule: rule.can_hold(*ends))
    heads = cut_lineage(lists.groupBy("layer", "block").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    # One row per block: the lists go to the blocks of the other side in which they can have partners.
    sources = lists.select("layer", number.alias("_rule"), F.col("block").alias("_lb"), "low", "high", "sources")
    targets = lists.select("layer", F.col("block").alias("_rb"), F.col("low").alias("dst_low"), F.col("high").alias("dst_high"), "targets")
    right = heads.select("layer", F.col("block").alias("_rb"), F.col("low").alias("dst_low"), F.col("high").alias("dst_high"))
    left = heads.select("layer", number.alias("_rule"), F.col("block").alias("_lb"), "low", "high")
    sources = sources.join(F.broadcast(right), "layer").filter(can_hold).drop("dst_low", "dst_high")
    targets = targets.join(F.broadcast(left), "layer").filter(can_hold).drop("low", "high", "_rule")
    met = block_join(targets, sources, ["layer", "_lb", "_rb"], [], [], None, tasks=tasks).filter(can_hold)
    # As many tasks as before: it ends the compiled loop, which would keep all edges of a list of targets in memory
    # before it hands on the first one.
    met = met.select("layer", "_rule", "sources", "targets").coalesce(tasks)
    edges = met.select("layer", "_rule", "targets", F.inline("sources").alias("src", "src_z", *[f"src_{c}" for c in others[0]]))
    edges = edges.select(
        "layer", "_rule", "src", "src_z", *[f"src_{c}" for c in others[0]],
        F.inline("targets").alias("dst", "dst_z", *[f"dst_{c}" for c in others[1]]),
    )
    holds = by_rule(lambda rule: rule.holds(F.col("src_z"), F.col("dst_z")))
    return edges.filter(holds & (F.col("src") != F.col("dst"))).select(
        "layer", "src", "dst", "src_z", "dst_z", *[f"src_{c}" for c in others[0]], *[f"dst_{c}" for c in others[1]]
    )


def fit_edges(people: DataFrame, rules: dict[str, LayerRule] | None = None, **options) -> DataFrame:
    """Layer edges weighted by the mean score of the pair: ``layer, src, dst, fit``, and the columns that were asked for."""
    mean = (F.col("src_z") + F.col("dst_z")) / F.lit(2.0)
    asked = [f"{end}_{c}" for end, name in (("src", "source_columns"), ("dst", "target_columns")) for c in options.get(name, ())]
    return layer_edges(people, rules, **options).select("layer", "src", "dst", mean.alias("fit"), *asked)


def distance_edges(people: DataFrame, rule: LayerRule = SIMPLE_RULE, **options) -> DataFrame:
    """Single-layer network weighted by the score distance of the pair: ``src, dst, dist``."""
    rows = people.select(F.lit("all").alias("layer"), "id", "z")
    edges = layer_edges(rows, {"all": rule}, **options)
    return edges.select("src", "dst", F.abs(F.col("src_z") - F.col("dst_z")).alias("dist"))


def layer_vertices(scored: DataFrame, layers: Sequence[str], id_column: str = "id", suffix: str = "_Z") -> DataFrame:
    """Scored people → one vertex row per layer: ``layer, id, z``."""
    columns = [f"{layer}{suffix}" for layer in layers]
    long = scored.unpivot([F.col(id_column).alias("id")], [F.col(c).cast("double").alias(c) for c in columns], "_column", "z")
    return long.select(F.expr(f"substring(_column, 1, length(_column) - {len(suffix)})").alias("layer"), "id", "z")
