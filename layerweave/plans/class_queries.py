"""Queries: layer graphs answered from score classes, beside the same SQL over listed edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import cp
from layerweave.operators import score_classes as K
from layerweave.operators.ordering import dense_index
from layerweave.operators.scores import FACTORS
from layerweave.plans.als_sql import als_sql
from layerweave.plans.graph_queries import _PARTITION, _pagerank_sql
from layerweave.plans.inputs import BAND_SQL, CUSTOMER_LAYER, USER_EDGES, customer_layer, user_layers
from layerweave.plans.registry import query

_ALL = (
    f"WITH RECURSIVE {CUSTOMER_LAYER}, edges AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT '{f}' AS layer, a.id AS src, b.id AS dst, (a.z + b.z) / 2.0 AS fit FROM people a JOIN people b ON a.id <> b.id AND {BAND_SQL[f]}"
        for f in ("OPN", "NEU")
    ) + "), nodes AS (SELECT 'OPN' AS layer, id FROM people UNION ALL SELECT 'NEU', id FROM people)"
)


def customer_layers(spark, folder):
    """Customers in an upward and a downward layer."""
    return customer_layer(spark, folder, "OPN").unionByName(customer_layer(spark, folder, "NEU"))


@query(
    "class_degrees",
    _ALL + ", ends AS (SELECT layer, src AS id, fit FROM edges UNION ALL SELECT layer, dst, fit FROM edges) "
    "SELECT layer, id, count(*) AS degree, round(sum(fit), 5) AS strength FROM ends GROUP BY ALL",
)
def class_degrees(spark, folder):
    """Degree and strength of every customer, no edge listed."""
    found = K.degrees(customer_layers(spark, folder))
    return found.select("layer", "id", "degree", F.round("strength", 5).alias("strength"))


@query(
    "class_pagerank",
    f"{_ALL}, {_pagerank_sql('edges', 'nodes', 10)} SELECT layer, id, round(rank * count(*) {_PARTITION} / sum(rank) {_PARTITION}, 6) AS rank FROM r10",
)
def class_pagerank(spark, folder):
    """Ten rounds of PageRank over all customers, no edge listed."""
    ranks = K.pagerank(customer_layers(spark, folder))
    return ranks.select("layer", "id", F.round("rank", 6).alias("rank"))


@query(
    "class_components",
    f"WITH RECURSIVE {USER_EDGES}, links AS MATERIALIZED (SELECT layer, src AS u, dst AS v FROM edges UNION SELECT layer, dst, src FROM edges), "
    "reach(layer, id, root) AS (SELECT layer, id, id FROM people UNION SELECT l.layer, l.v, r.root FROM reach r JOIN links l "
    "ON l.layer = r.layer AND l.u = r.id) SELECT layer, id, min(root) AS component FROM reach GROUP BY ALL",
)
def class_components(spark, folder):
    """Components of the user layers, no edge listed."""
    return K.components(user_layers(spark, folder))


_STACKED = (
    f"WITH {USER_EDGES}, idx AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM people)), "
    "cells AS MATERIALIZED (SELECT s.n AS i, d.n AS j, CASE layer " + " ".join(f"WHEN '{f}' THEN {k}" for k, f in enumerate(FACTORS))
    + " END::BIGINT AS k, fit AS value FROM edges JOIN idx s ON src = s.id JOIN idx d ON dst = d.id)"
)


@query(
    "layer_communities",
    f"{_STACKED}, {als_sql('cells', 20, 0.002)} SELECT id, " + ", ".join(f"round(coalesce({t}.f{r}, 0), 5) AS {t}_r{r}" for t in "AB" for r in (0, 1))
    + ", round(e.error, 5) AS error, converged FROM stopped st JOIN errors e ON e.sweep = st.sweep CROSS JOIN idx "
    "LEFT JOIN solution A ON A.sweep = st.sweep AND A.mode = 0 AND A.idx = n LEFT JOIN solution B ON B.sweep = st.sweep AND B.mode = 1 AND B.idx = n",
)
def layer_communities(spark, folder):
    """Rank-two decomposition of the five stacked user layers, straight from the scores."""
    people = user_layers(spark, folder)
    index = dense_index(people.select("id").distinct(), [F.col("id")])
    points = people.join(index, "id").select("layer", "idx", "z")
    source = K.ScoreSource(points, FACTORS, index.count())
    model = cp.cp_als(source, rank=2, max_sweeps=20, tolerance=0.002, init="md5")
    table = cp.community_table(model, index)
    entries = {c: F.round(c, 5) for c in table.columns if c != "id"}
    return table.withColumns({**entries, "error": F.lit(round(float(model.errors[-1]), 5)), "converged": F.lit(model.converged)})
