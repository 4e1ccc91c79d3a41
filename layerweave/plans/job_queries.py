"""Queries: the whole jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators.scores import FACTORS
from layerweave.plans import jobs
from layerweave.plans.als_sql import als_sql
from layerweave.plans.class_queries import _STACKED
from layerweave.plans.graph_queries import _pagerank_sql
from layerweave.plans.inputs import CUSTOMER_LAYER, customer_layer, questionnaire, scorecard, user_z
from layerweave.plans.people_queries import goal_list
from layerweave.plans.registry import query


@query(
    "simple_network",
    f"WITH RECURSIVE {CUSTOMER_LAYER}, edges AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM people a JOIN people b "
    f"ON a.id <> b.id AND (a.z + b.z) / 2.0 >= 1.0), {_pagerank_sql('edges', 'people', 10, '')}, "
    # Every linked person reaches the one with the highest score in at most two steps.
    "linked AS (SELECT min(src) AS root FROM edges) "
    "SELECT p.id, z, round(rank * count(*) OVER () / sum(rank) OVER (), 6) AS rank, "
    "CASE WHEN p.id IN (SELECT src FROM edges) THEN root ELSE p.id END AS component FROM people p JOIN r10 ON r10.id = p.id, linked",
)
def simple_network(spark, folder):
    """All customers as one undirected layer: rank and component of everyone."""
    found = jobs.simple_network(customer_layer(spark, folder, "x"))
    return found.withColumn("rank", F.round("rank", 6))


@query("scored_answers")
def scored_answers(spark, folder):
    """Answers of 120 items → scores, ranks and goals of everyone."""
    answers = questionnaire(spark, folder).withColumnRenamed("id", "case")
    scored = jobs.score_answers(answers, scorecard(spark), goal_list(spark, folder))
    return jobs.input_table(scored)


def _sides_sql() -> str:
    """Component scores, the component that fits the wanted profile, and its best members, for both sides."""
    sums = ", ".join(f"side{s} AS (SELECT sum(f0) AS t0, sum(f1) AS t1 FROM solution JOIN stopped USING (sweep) WHERE mode = {m})" for m, s in enumerate("AB"))
    layers = " UNION ALL ".join(f"SELECT {k} AS idx, '{f}' AS layer" for k, f in enumerate(FACTORS))
    scored = " UNION ALL ".join(
        f"SELECT '{s}' AS side, layer, f0 * t0 AS s0, f1 * t1 AS s1 FROM solution JOIN stopped USING (sweep) JOIN layers USING (idx), side{s} WHERE mode = 2" for s in "AB"
    )
    best = "CASE WHEN layer IN ('OPN', 'CSN', 'EXT') THEN greatest(s0, s1) WHEN layer = 'AGR' THEN 0 ELSE least(s0, s1) END"
    fits = f"fits AS (SELECT side, CASE WHEN sum(({best} - s0) ** 2) <= sum(({best} - s1) ** 2) THEN 'r0' ELSE 'r1' END AS component FROM scored GROUP BY side)"
    top = (
        "top AS (SELECT side, component, id, (row_number() OVER (PARTITION BY side ORDER BY w DESC, id))::INT AS place FROM (SELECT side, component, idx.id, "
        "CASE component WHEN 'r0' THEN f0 ELSE f1 END AS w FROM fits JOIN solution ON mode = CASE side WHEN 'A' THEN 0 ELSE 1 END JOIN stopped USING (sweep) JOIN idx ON idx.n = solution.idx) "
        "QUALIFY place <= 5)"
    )
    columns = ", ".join(f"{f}_Z" for f in FACTORS)
    return f"{sums}, layers AS ({layers}), scored AS ({scored}), {fits}, {top} SELECT id, {columns}, place, side, component FROM top JOIN zs USING (id)"


@query("communities", f"{_STACKED}, {als_sql('cells', 20, 0.002)}, {_sides_sql()}")
def communities(spark, folder):
    """Five user layers → decomposition → the members that fit the wanted profile best."""
    found = jobs.find_communities(user_z(spark, folder), id_column="id", init="md5")
    sides = [found.members[s].withColumn("side", F.lit(s)).withColumn("component", F.lit(found.component[s])) for s in ("A", "B")]
    return sides[0].unionByName(sides[1])
