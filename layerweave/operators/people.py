"""Giving people names and goals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerweave.functions.cleaning import birth_year
from layerweave.functions.hashing import md5_int
from layerweave.operators.ordering import dense_index
from layerweave.operators.scores import FACTORS
from layerweave.operators.skew import HotKeys, spread_join
from layerweave.session import cut_lineage, keep_table

# Topics that suit a high score in each factor.
TOPICS_OF = {
    "OPN": ("knowledge", "adventure", "spiritual"),
    "CSN": ("career", "financial", "personal"),
    "EXT": ("social", "adventure", "career"),
    "AGR": ("spiritual", "financial", "health"),
    "NEU": ("health", "knowledge", "personal"),
}
# A quintile above this one counts as high; a person gets at most this many goals.
HIGH_QUINTILE = 3
MOST_GOALS = 5


def pick_names(people: DataFrame, names: DataFrame, seed: int = 0, id_column: str = "case") -> DataFrame:
    """Add to every person one random name of the same sex and birth year; people without one drop out.

    The list is numbered once in the order (year, sex, name).  Each person draws a number inside
    its own stretch and fetches that one row, so people are never multiplied by the names that
    would fit them, and the same person draws the same name every time.
    """
    listed = names.select(F.col("year").try_cast("int").alias("_year"), F.col("sex").alias("_sex"), F.col("name").alias("_name"))
    listed = listed.filter(F.col("_year").isNotNull())
    numbered = dense_index(listed, [F.col("_year"), F.col("_sex"), F.col("_name")], "_number", ties=True)
    stretches = cut_lineage(
        numbered.groupBy("_year", "_sex").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_size"))
    )
    size = numbered.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("_name")), F.lit(0)).alias("text")).first()
    # Kept, as hot keys are counted on the people before they are joined: they are made once.
    born = keep_table(people.withColumn("_year", birth_year(F.col("date"), F.col("age"))).withColumn("_sex", F.col("sex")))
    group, own = ["_year", "_sex"], [F.col(id_column)]
    drawn = spread_join(born, stretches, group, own, HotKeys(born, group), stretches.count()).withColumn(
        "_number", F.col("_first") + F.pmod(md5_int(F.col(id_column), F.lit(seed)), F.col("_size"))
    )
    listed = numbered.select("_number", F.col("_name").alias("name"))
    found = spread_join(
        drawn, listed, ["_number"], own, HotKeys(drawn, ["_number"]), size["rows"], text_bytes=size["text"]
    )
    return found.select(id_column, "name", *[c for c in people.columns if c not in (id_column, "name")])


def topic_list(goals: DataFrame) -> tuple[dict[str, int], int]:
    """Number of goals per topic of the topic map (others are never drawn from), and bytes of all texts."""
    wanted = sorted({t for topics in TOPICS_OF.values() for t in topics})
    counts = goals.filter(F.col("topic").isin(*wanted)).groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("goal") + F.octet_length("topic")).alias("bytes")
    ).collect()
    return {row["topic"]: row["n"] for row in counts}, sum(row["bytes"] or 0 for row in counts)


def chosen_factors(quintiles: Mapping[str, Column], invert: Sequence[str] = ()) -> Column:
    """Factors with a high quintile; if none, the one with the highest, by name on a tie."""
    rank = {f: (F.lit(6) - q if f in invert else q) for f, q in quintiles.items()}
    high = F.filter(
        F.array(*[F.when(q > HIGH_QUINTILE, F.lit(f)) for f, q in rank.items()]), lambda f: f.isNotNull()
    )
    # Smallest (-rank, name) is the highest rank, the first name on a tie; NULL ranks go last.
    best = F.array_min(F.array(*[F.struct((-F.coalesce(q, F.lit(0))).alias("r"), F.lit(f).alias("f")) for f, q in rank.items()]))
    return F.when(F.size(high) > 0, high).otherwise(F.array(best["f"]))


def draw_positions(key: Column, size: Column, most: int, seed: int) -> Column:
    """Between 1 and ``most`` distinct numbers out of 0..size-1, sorted, drawn without replacement.

    Draw d picks one of the size-d numbers that are left: a number in 0..size-d-1, moved past the
    ones already taken.  All inside the row.
    """
    count = F.least(F.lit(1) + F.pmod(md5_int(key, F.lit(seed), F.lit("count")), F.lit(most)), size)

    def draw(taken: Column, d: Column) -> Column:
        start = F.pmod(md5_int(key, F.lit(seed), d), size - d)
        moved = F.aggregate(taken, start, lambda number, t: number + F.when(number >= t, 1).otherwise(0))
        return F.array_sort(F.concat(taken, F.array(moved)))

    draws = F.sequence(F.lit(0).cast("long"), count - 1)
    return F.when(size > 0, F.aggregate(draws, F.array().cast("array<long>"), draw)).otherwise(F.array().cast("array<long>"))


def assign_goals(
    people: DataFrame,
    goals: DataFrame,
    id_column: str = "id",
    most: int = MOST_GOALS,
    seed: int = 0,
    invert: Sequence[str] = (),
    suffix: str = "_Q",
) -> DataFrame:
    """Add ``goals``: 1 to ``most`` goals from the topics of the person's high factors.

    ``goals`` holds ``topic, goal``.  Only the topic sizes (at most one per topic of the map) reach
    the driver.  A person draws positions in the joined topics, not the goals themselves; the texts
    are fetched by (topic, position), so a person is one to ``most`` narrow rows and never a copy of
    the goal list.
    """
    sizes, text = topic_list(goals)
    topics = sorted(sizes)
    size_of = F.create_map(*[x for t in topics for x in (F.lit(t), F.lit(sizes[t]).cast("long"))]) if topics else None
    if size_of is None:
        return people.withColumn("goals", F.array().cast("array<string>"))
    allowed = F.create_map(*[
        x for f in FACTORS for x in (F.lit(f), F.array(*[F.lit(t) for t in TOPICS_OF[f]]))
    ])
    factors = chosen_factors({f: F.col(f"{f}{suffix}") for f in FACTORS}, invert)
    open_topics = F.array_sort(F.array_distinct(F.flatten(F.transform(factors, lambda f: allowed[f]))))
    open_topics = F.filter(open_topics, lambda t: F.array_contains(F.array(*[F.lit(t) for t in topics]), t))
    drawn = people.withColumn("_topics", open_topics).withColumn(
        "_pool", F.aggregate("_topics", F.lit(0).cast("long"), lambda total, t: total + size_of[t])
    )
    drawn = drawn.withColumn("_drawn", draw_positions(F.col(id_column), F.col("_pool"), most, seed))

    def locate(number: Column) -> Column:
        """Topic and position inside it of a number in the joined topics."""
        start = F.struct(number.alias("left"), F.lit(None).cast("string").alias("topic"))
        step = lambda at, t: F.when(at["topic"].isNotNull(), at).when(
            at["left"] < size_of[t], F.struct(at["left"].alias("left"), t.alias("topic"))
        ).otherwise(F.struct((at["left"] - size_of[t]).alias("left"), F.lit(None).cast("string").alias("topic")))
        return F.aggregate("_topics", start, step)

    wanted = drawn.select(id_column, F.explode(F.transform("_drawn", locate)).alias("_at")).select(
        id_column, F.col("_at.topic").alias("topic"), F.col("_at.left").alias("_position")
    )
    listed = dense_index(goals.filter(F.col("topic").isin(*topics)).select("topic", "goal"), [F.col("topic"), F.col("goal")], "_number", ties=True)
    first, total = {}, 0
    for t in topics:
        first[t], total = total, total + sizes[t]
    first_of = F.create_map(*[x for t in topics for x in (F.lit(t), F.lit(first[t]).cast("long"))])
    listed = listed.select("topic", (F.col("_number") - first_of[F.col("topic")]).alias("_position"), "goal")
    place = ["topic", "_position"]
    got = spread_join(wanted, listed, place, [F.col(id_column)], HotKeys(wanted, place), total, text_bytes=text)
    got = got.groupBy(id_column).agg(
        # At most ``most`` members per person: a bounded list.
        F.transform(F.array_sort(F.collect_list(F.struct("topic", "_position", "goal"))), lambda x: x["goal"]).alias("goals")
    )
    none = F.array().cast("array<string>")
    return people.join(got, id_column, "left").withColumn("goals", F.coalesce("goals", none))
