"""Queries: component scores, profile match, best members."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import community as M
from layerweave.operators import scores as S
from layerweave.plans.inputs import USER_LAYERS, USER_SCORES, user_layers, user_scores
from layerweave.plans.registry import query

_A, _B = ("OPN", "CSN", "EXT"), ("AGR", "NEU", "EXT")


def community(spark, folder):
    """``id, A_r*, B_r*``: factor scores in the place of a decomposition's node factors."""
    users = user_scores(spark, folder)
    return users.select(
        "id", *[(F.col(f) / 1000.0).alias(f"A_r{r}") for r, f in enumerate(_A)],
        *[(F.col(f) / 1000.0).alias(f"B_r{r}") for r, f in enumerate(_B)],
    )


def personality(spark, folder):
    """``layer, C_r*``: moments of each factor in the place of a decomposition's layer factors."""
    long = S.unpivot(user_scores(spark, folder), ["id"], S.FACTORS, "layer", "v")
    return long.groupBy("layer").agg(
        (F.avg("v") / 1000.0).alias("C_r0"), (F.stddev("v") / 1000.0).alias("C_r1"), (F.max("v") / 5000.0).alias("C_r2")
    )


_SCORED = (
    f"WITH {USER_SCORES}, long AS (" + " UNION ALL ".join(f"SELECT '{f}' AS layer, {f} AS v FROM users" for f in S.FACTORS)
    + "), ffm AS (SELECT layer, avg(v) / 1000.0 AS c0, stddev(v) / 1000.0 AS c1, max(v) / 5000.0 AS c2 FROM long GROUP BY layer), "
    "sums AS (SELECT " + ", ".join(f"sum({f} / 1000.0) AS a{r}" for r, f in enumerate(_A)) + ", "
    + ", ".join(f"sum({f} / 1000.0) AS b{r}" for r, f in enumerate(_B))
    + " FROM users), scores AS (SELECT 'A' AS side, layer, c0 * a0 AS s_r0, c1 * a1 AS s_r1, c2 * a2 AS s_r2 FROM ffm, sums "
    "UNION ALL SELECT 'B', layer, c0 * b0, c1 * b1, c2 * b2 FROM ffm, sums)"
)
_MISFIT = (
    _SCORED + ", best AS (SELECT *, CASE layer WHEN 'OPN' THEN greatest(s_r0, s_r1, s_r2) WHEN 'CSN' THEN greatest(s_r0, s_r1, s_r2) "
    "WHEN 'EXT' THEN greatest(s_r0, s_r1, s_r2) WHEN 'AGR' THEN 0 ELSE least(s_r0, s_r1, s_r2) END AS best FROM scores), "
    "misfits AS (SELECT side, 'r0' AS component, sum((best - s_r0) ** 2) AS misfit FROM best GROUP BY side UNION ALL "
    "SELECT side, 'r1', sum((best - s_r1) ** 2) FROM best GROUP BY side UNION ALL SELECT side, 'r2', sum((best - s_r2) ** 2) FROM best GROUP BY side)"
)


def _both_sides(make):
    return make("A").withColumn("side", F.lit("A")).unionByName(make("B").withColumn("side", F.lit("B")))


@query("component_scores", _SCORED + " SELECT side, layer, round(s_r0, 6) AS s_r0, round(s_r1, 6) AS s_r1, round(s_r2, 6) AS s_r2 FROM scores")
def component_scores(spark, folder):
    """Score of every component in every layer, for both sides of the edges."""
    nodes, layers = community(spark, folder), personality(spark, folder)
    scores = _both_sides(lambda side: M.component_scores(nodes, layers, side))
    return scores.withColumns({f"s_r{r}": F.round(f"s_r{r}", 6) for r in range(3)})


@query("profile_misfit", _MISFIT + " SELECT side, component, round(misfit, 4) AS misfit FROM misfits")
def profile_misfit(spark, folder):
    """Squared distance of every component to the wanted profile."""
    nodes, layers = community(spark, folder), personality(spark, folder)
    misfits = _both_sides(lambda side: M.component_misfit(M.component_scores(nodes, layers, side), M.RUN_PROFILE))
    return misfits.withColumn("misfit", F.round("misfit", 4))


@query("profile_match", _MISFIT + " SELECT side, arg_min(component, (misfit, component)) AS component FROM misfits GROUP BY side")
def profile_match(spark, folder):
    """The component that fits the wanted profile best, per side."""
    nodes, layers = community(spark, folder), personality(spark, folder)
    found = [(s, M.match_component(M.component_scores(nodes, layers, s), M.RUN_PROFILE)) for s in ("A", "B")]
    return spark.createDataFrame(found, "side string, component string")


@query(
    "top_members",
    f"WITH {USER_SCORES} SELECT id, (row_number() OVER (ORDER BY EXT DESC, id))::INT AS place, round(EXT / 1000.0, 6) AS weight FROM users "
    "ORDER BY EXT DESC, id LIMIT 5",
)
def top_members(spark, folder):
    """The five nodes with the largest entry in one component."""
    best = M.top_members(community(spark, folder), "A_r2", 5, values=True)
    return best.withColumn("weight", F.round("weight", 6))


_FIVE = ", ".join(f"max(CASE WHEN layer = '{f}' THEN z END) AS {f}_Z" for f in S.FACTORS)


@query("merge_layers", f"WITH {USER_LAYERS} SELECT id, {_FIVE} FROM people GROUP BY id")
def merge_layers(spark, folder):
    """The layers' vertex tables merged into one row per person."""
    return M.merge_layers(user_layers(spark, folder), S.FACTORS)


@query(
    "member_profiles",
    f"WITH {USER_LAYERS}, merged AS (SELECT id, {_FIVE} FROM people GROUP BY id), top AS (SELECT id, "
    "(row_number() OVER (ORDER BY EXT DESC, id))::INT AS place FROM users ORDER BY EXT DESC, id LIMIT 5) "
    "SELECT * FROM merged JOIN top USING (id)",
)
def member_profiles(spark, folder):
    """Scores of the best members in the order of their place."""
    people = M.merge_layers(user_layers(spark, folder), S.FACTORS)
    return M.member_profiles(people, M.top_members(community(spark, folder), "A_r2", 5))
