"""Queries: factor scores, z-scores, quintiles, selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import scores as S
from layerweave.plans.inputs import (
    HOURS, ITEM_CYCLE, KIND_OF, USER_SCORES, USER_Z, questionnaire, scorecard, user_scores, user_z,
)
from layerweave.plans.registry import query, table

_ITEMS_SQL = "answers AS (SELECT user_id AS id, " + ", ".join(
    f"coalesce(sum(CASE WHEN event_type = '{KIND_OF[f]}' AND hour(ts) = {h} "
    f"THEN CAST(value AS DECIMAL(18,2)) END), 0)::DOUBLE AS I{h * 5 + n + 1}"
    for h in range(HOURS) for n, f in enumerate(ITEM_CYCLE)
) + " FROM events GROUP BY user_id)"
_SUMS_SQL = ", ".join(
    f"round({' + '.join(f'I{h * 5 + n + 1}' for h in range(HOURS))}, 4) AS {f}" for n, f in enumerate(ITEM_CYCLE)
)


@query("factor_scores", f"WITH {_ITEMS_SQL} SELECT id, {_SUMS_SQL} FROM answers")
def factor_scores(spark, folder):
    """120 item columns → five factor sums by the scorecard."""
    answers = questionnaire(spark, folder)
    sums = S.factor_sums(answers, S.items_by_factor(scorecard(spark)))
    return sums.select("id", *[F.round(f, 4).alias(f) for f in S.FACTORS])


@query(
    "factor_moments",
    f"WITH {USER_SCORES}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS factor, {f} AS v FROM users" for f in S.FACTORS)
    + ") SELECT factor, round(avg(v), 6) AS mean, round(stddev(v), 6) AS sd, count(v) AS n FROM long GROUP BY factor",
)
def factor_moments(spark, folder):
    long = S.unpivot(user_scores(spark, folder), ["id"], S.FACTORS, "factor", "v")
    return long.groupBy("factor").agg(
        F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev("v"), 6).alias("sd"), F.count("v").alias("n")
    )


@query("zscores", f"WITH {USER_Z} SELECT id, " + ", ".join(f"{f}_Z" for f in S.FACTORS) + " FROM zs")
def zscores(spark, folder):
    return user_z(spark, folder).select("id", *[f"{f}_Z" for f in S.FACTORS])


_CUTS = ", cuts AS (SELECT " + ", ".join(
    f"quantile_disc({f}, 0.{2 * k}) AS {f}_{k}" for f in S.FACTORS for k in range(1, 5)
) + " FROM users)"


@query(
    "quantile_cuts",
    f"WITH {USER_SCORES}{_CUTS} " + " UNION ALL ".join(
        f"SELECT '{f}' AS factor, {k} AS cut_no, {f}_{k} AS cut FROM cuts" for f in S.FACTORS for k in range(1, 5)
    ),
)
def quantile_cuts(spark, folder):
    """Exact quintile cuts of all factors, by counting equal values before a range-partitioned sort."""
    long = S.unpivot(user_scores(spark, folder), [], S.FACTORS, "factor", "value")
    cuts = S.exact_quantiles(long, "value", S.QUINTILE_SHARES, ["factor"])
    return cuts.select("factor", F.round(F.col("probability") * 5).cast("int").alias("cut_no"), "cut")


@query(
    "quintiles",
    f"WITH {USER_SCORES}{_CUTS} SELECT id, " + ", ".join(
        "1 + " + " + ".join(f"(trunc({f}) >= {f}_{k})::INT" for k in range(1, 5)) + f" AS {f}_Q" for f in S.FACTORS
    ) + " FROM users, cuts",
)
def quintiles(spark, folder):
    return S.with_quintiles(user_scores(spark, folder), S.FACTORS).select("id", *[f"{f}_Q" for f in S.FACTORS])


@query(
    "customer_quintiles",
    "WITH cuts AS (SELECT " + ", ".join(f"quantile_disc(c_acctbal, 0.{2 * k}) AS q{k}" for k in range(1, 5))
    + " FROM customer) SELECT c_custkey, 1 + " + " + ".join(f"(trunc(c_acctbal) >= q{k})::INT" for k in range(1, 5))
    + " AS c_acctbal_Q FROM customer, cuts",
)
def customer_quintiles(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return S.with_quintiles(customers, ["c_acctbal"]).select("c_custkey", "c_acctbal_Q")


@query(
    "scored_people",
    f"WITH {USER_Z}{_CUTS} SELECT id, " + ", ".join(S.FACTORS) + ", " + ", ".join(f"{f}_Z" for f in S.FACTORS) + ", "
    + ", ".join("1 + " + " + ".join(f"(trunc({f}) >= {f}_{k})::INT" for k in range(1, 5)) + f" AS {f}_Q" for f in S.FACTORS)
    + " FROM zs, cuts",
)
def scored_people(spark, folder):
    """Sums, z-scores and quintiles side by side."""
    return S.with_quintiles(user_z(spark, folder), S.FACTORS)


@query(
    "first_people",
    "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 100",
)
def first_people(spark, folder):
    """The first N people by id (a top-N report)."""
    return table(spark, folder, "customer").select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


@query("one_country", "SELECT c_custkey, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name = 'NATION_7'")
def one_country(spark, folder):
    """Equality filter on the country of a person."""
    nations = table(spark, folder, "nation").filter(F.col("n_name") == "NATION_7")
    return table(spark, folder, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi"
    ).select("c_custkey", "c_acctbal")
