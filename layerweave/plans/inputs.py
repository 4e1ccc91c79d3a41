"""How the given tables play the roles of people, items, layers and tensors.

Each role exists twice: as a DataFrame and as the SQL common table expression that the twins use.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from layerweave.operators.layers import layer_vertices
from layerweave.operators.scores import FACTORS, with_z_scores
from layerweave.plans.registry import table

# Which kind of event feeds which factor.
KIND_OF = {"OPN": "view", "CSN": "click", "EXT": "purchase", "AGR": "signup", "NEU": "error"}
# Factor of item 1, 2, 3, 4, 5, 6, ... of the questionnaire; 24 items per factor.
ITEM_CYCLE = ("NEU", "EXT", "OPN", "AGR", "CSN")
HOURS = 24

MONEY = "decimal(18,2)"


def user_scores(spark: SparkSession, folder: str) -> DataFrame:
    """People with five factor scores: the event value of each user, summed per kind of event."""
    events = table(spark, folder, "events")
    amount = F.col("value").cast(MONEY)
    return events.groupBy(F.col("user_id").alias("id")).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("event_type") == kind, amount)), F.lit(0)).cast("double").alias(factor)
            for factor, kind in KIND_OF.items()
        ]
    )


USER_SCORES = "users AS (SELECT user_id AS id, " + ", ".join(
    f"coalesce(sum(CASE WHEN event_type = '{kind}' THEN CAST(value AS DECIMAL(18,2)) END), 0)::DOUBLE AS {factor}"
    for factor, kind in KIND_OF.items()
) + " FROM events GROUP BY user_id)"


def questionnaire(spark: SparkSession, folder: str) -> DataFrame:
    """``id, I1..I120``: the value of a user's events per hour of the day and kind of event."""
    events = table(spark, folder, "events")
    position = F.coalesce(
        *[F.when(F.col("event_type") == KIND_OF[f], F.lit(n + 1)) for n, f in enumerate(ITEM_CYCLE)]
    )
    item = F.concat(F.lit("I"), F.hour("ts") * len(ITEM_CYCLE) + position)
    names = [f"I{n + 1}" for n in range(HOURS * len(ITEM_CYCLE))]
    wide = events.withColumn("item", item).groupBy(F.col("user_id").alias("id")).pivot("item", names)
    return wide.agg(F.sum(F.col("value").cast(MONEY)).cast("double")).na.fill(0.0, names)


def scorecard(spark: SparkSession) -> DataFrame:
    """``id, key``: item n belongs to factor and facet by its place in the cycle."""
    n = F.col("id")
    factor = F.element_at(F.array(*[F.lit(f) for f in ITEM_CYCLE]), (n % 5 + 1).cast("int"))
    facet = (F.floor(n / 5) % 6 + 1).cast("string")
    return spark.range(HOURS * len(ITEM_CYCLE)).select(
        F.concat(F.lit("I"), (n + 1).cast("string")).alias("id"), F.concat(factor, facet).alias("key")
    )


def user_z(spark: SparkSession, folder: str) -> DataFrame:
    return with_z_scores(user_scores(spark, folder), FACTORS)


def user_layers(spark: SparkSession, folder: str) -> DataFrame:
    """``layer, id, z`` of the five user layers."""
    return layer_vertices(user_z(spark, folder), FACTORS)


USER_Z = USER_SCORES + ", moments AS (SELECT " + ", ".join(
    f"avg({f}) AS {f}_m, stddev({f}) AS {f}_s" for f in FACTORS
) + " FROM users), zs AS (SELECT users.*, " + ", ".join(
    f"round_even(({f} - {f}_m) / nullif({f}_s, 0), 3) AS {f}_Z" for f in FACTORS
) + " FROM users, moments)"

USER_LAYERS = USER_Z + ", people AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS layer, id, {f}_Z AS z FROM zs" for f in FACTORS
) + ")"


def customer_layer(spark: SparkSession, folder: str, layer: str) -> DataFrame:
    """``layer, id, z``: all customers as one layer, scored by account balance."""
    customers = table(spark, folder, "customer").select(
        F.lit(layer).alias("layer"), F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("score")
    )
    scored = with_z_scores(customers, ["score"], "_z")
    return scored.select("layer", "id", F.col("score_z").alias("z"))


CUSTOMER_LAYER = (
    "people AS (SELECT c_custkey AS id, round_even((c_acctbal - m) / nullif(s, 0), 3) AS z FROM customer, "
    "(SELECT avg(c_acctbal) AS m, stddev(c_acctbal) AS s FROM customer))"
)

# Fixed values as SQL: band and direction of each layer over the scores a and b of a pair.
BAND_SQL = {
    "OPN": "(a.z + b.z) / 2.0 >= 1 AND (a.z + b.z) / 2.0 < 3 AND a.z < b.z",
    "CSN": "((a.z + b.z) / 2.0 >= 1 AND (a.z + b.z) / 2.0 < 3 OR (a.z + b.z) / 2.0 > -3 AND (a.z + b.z) / 2.0 <= -1) AND a.z < b.z",
    "EXT": "(a.z + b.z) / 2.0 >= 1 AND (a.z + b.z) / 2.0 < 3 AND a.z < b.z",
    "AGR": "((a.z + b.z) / 2.0 >= 1 AND (a.z + b.z) / 2.0 < 3 OR (a.z + b.z) / 2.0 > -1 AND (a.z + b.z) / 2.0 < 1) AND a.z < b.z",
    "NEU": "(a.z + b.z) / 2.0 >= -3 AND (a.z + b.z) / 2.0 < -1 AND a.z > b.z",
    "DEFAULT": "(a.z + b.z) / 2.0 >= 2",
}

USER_EDGES = USER_LAYERS + ", edges AS (" + " UNION ALL ".join(
    f"SELECT a.layer, a.id AS src, b.id AS dst, (a.z + b.z) / 2.0 AS fit FROM people a JOIN people b "
    f"ON a.layer = '{f}' AND b.layer = '{f}' AND a.id <> b.id AND {BAND_SQL[f]}"
    for f in FACTORS
) + ")"
