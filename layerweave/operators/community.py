"""Reading communities off a decomposition: component scores, profile match, best members."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from layerweave.operators.skew import HotKeys, spread_join

# The wanted profile per layer: 1 high, -1 low, 0 indifferent.
DEFAULT_PROFILE = {"OPN": 1, "CSN": 1, "EXT": 1, "AGR": 1, "NEU": -1}
RUN_PROFILE = {"OPN": 1, "CSN": 1, "EXT": 1, "AGR": 0, "NEU": -1}


def top_per_group(df: DataFrame, by: Sequence[str], score: str, tie: str, n: int) -> DataFrame:
    """The best ``n`` rows of every group with their ``place``.

    Spark keeps only ``n`` rows per group and map task before the shuffle (window group limit),
    so a group with a third of all rows does not reach one task whole.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def component_scores(model_table: DataFrame, layers: DataFrame, side: str = "A") -> DataFrame:
    """``layer, s_r0..``: C[layer, r] times the sum of the side's column r over all nodes.

    The sums are one aggregate of R numbers; the result has one row per layer.
    """
    rank = len([c for c in layers.columns if c.startswith("C_r")])
    sums = model_table.agg(*[F.sum(f"{side}_r{r}").alias(f"r{r}") for r in range(rank)]).first()
    total = [float(sums[f"r{r}"] or 0.0) for r in range(rank)]
    return layers.select("layer", *[(F.col(f"C_r{r}") * F.lit(total[r])).alias(f"s_r{r}") for r in range(rank)])


def best_profile(scores: DataFrame, profile: Mapping[str, float] = DEFAULT_PROFILE) -> DataFrame:
    """Add ``best`` per layer: the row's largest score where high is wanted, smallest where low, else 0.

    A layer that the profile does not name has no best value.
    """
    columns = [F.col(c) for c in scores.columns if c.startswith("s_r")]
    high = F.greatest(*columns) if len(columns) > 1 else columns[0]
    low = F.least(*columns) if len(columns) > 1 else columns[0]
    wanted = F.lit(None).cast("double")
    for layer, mask in profile.items():
        wanted = F.when(F.col("layer") == layer, F.lit(float(mask))).otherwise(wanted)
    best = F.when(wanted > 0, high).when(wanted < 0, low).otherwise(wanted)
    return scores.withColumn("best", best)


def component_misfit(scores: DataFrame, profile: Mapping[str, float] = DEFAULT_PROFILE) -> DataFrame:
    """``component, misfit``: sum over the layers of the squared distance to the best profile."""
    columns = [c for c in scores.columns if c.startswith("s_r")]
    long = best_profile(scores, profile).unpivot(["layer", "best"], columns, "component", "score")
    squared = (F.col("best") - F.col("score")) * (F.col("best") - F.col("score"))
    return long.groupBy(F.regexp_replace("component", "^s_", "").alias("component")).agg(F.sum(squared).alias("misfit"))


def match_component(scores: DataFrame, profile: Mapping[str, float] = DEFAULT_PROFILE) -> str:
    """The component with the least misfit; the lower-numbered one on a tie."""
    number = F.regexp_replace("component", "^r", "").cast("int")
    row = component_misfit(scores, profile).agg(F.min_by("component", F.struct(F.col("misfit"), number)).alias("c")).first()
    return row["c"]


def top_members(community: DataFrame, column: str, n: int = 5, values: bool = False) -> DataFrame:
    """The ``n`` nodes with the largest entry, ids break ties: ``place, id`` and optionally the entry."""
    best = community.select("id", F.col(column).alias("weight")).orderBy(F.desc("weight"), F.asc("id")).limit(n)
    order = Window.orderBy(F.desc("weight"), F.asc("id"))  # over the n rows of the report only
    ranked = best.withColumn("place", F.row_number().over(order))
    return ranked.select("place", "id", "weight") if values else ranked.select("place", "id")


def merge_layers(vertices: DataFrame, layers: Sequence[str], on: Sequence[str] = ("id",), suffix: str = "_Z") -> DataFrame:
    """One row per person with a score column per layer; people missing in a layer drop out."""
    columns = [F.max(F.when(F.col("layer") == layer, F.col("z"))).alias(f"{layer}{suffix}") for layer in layers]
    present = F.count_distinct(F.when(F.col("layer").isin(*layers), F.col("layer")))
    return vertices.groupBy(*on).agg(*columns, present.alias("_layers")).filter(F.col("_layers") == len(layers)).drop("_layers")


def member_profiles(people: DataFrame, members: DataFrame) -> DataFrame:
    """The rows of the chosen members, in the order of their place."""
    known = members.count()
    return spread_join(people, members, ["id"], [F.xxhash64("id")], HotKeys(people, ["id"]), known).orderBy("place")
