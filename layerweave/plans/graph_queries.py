"""Queries: adjacency, strength, patterns, ranking and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from layerweave.operators import graph as G
from layerweave.operators import layers as L
from layerweave.operators import push as P
from layerweave.operators import score_classes as K
from layerweave.operators.scores import with_z_scores
from layerweave.operators.skew import tasks_for
from layerweave.plans.inputs import MONEY, USER_EDGES, user_layers
from layerweave.plans.registry import query, table


def user_graph(spark, folder) -> G.LayerGraph:
    return G.build_graph(user_layers(spark, folder), rules=L.RULES)


@query(
    "adjacency_coo",
    f"WITH {USER_EDGES}, idx AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM users) "
    "SELECT layer, a.k AS i, b.k AS j, avg(fit) AS value FROM edges JOIN idx a ON src = a.id "
    "JOIN idx b ON dst = b.id GROUP BY ALL",
)
def adjacency_coo(spark, folder):
    """All layers as one coordinate table over dense vertex indexes."""
    cells, _ = G.indexed_edges(user_graph(spark, folder))
    return cells.select("layer", "i", "j", "value")


def nation_layer(spark, folder):
    """Nations as a layer of 25 vertices, scored by the balance of their customers."""
    sums = table(spark, folder, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(
        F.sum(F.col("c_acctbal").cast(MONEY)).cast("double").alias("score")
    )
    scored = with_z_scores(sums, ["score"], "_z")
    return scored.select(F.lit("AGR").alias("layer"), "id", F.col("score_z").alias("z"))


_NATIONS = (
    "sums AS (SELECT c_nationkey AS id, sum(CAST(c_acctbal AS DECIMAL(18,2)))::DOUBLE AS s FROM customer GROUP BY 1), "
    "people AS (SELECT id, round_even((s - (SELECT avg(s) FROM sums)) / (SELECT stddev(s) FROM sums), 3) AS z FROM sums)"
)


@query(
    "adjacency_wide",
    f"WITH {_NATIONS}, edges AS (SELECT a.id AS src, b.id AS dst, (a.z + b.z) / 2.0 AS fit FROM people a JOIN people b "
    "ON a.id <> b.id AND ((a.z + b.z) / 2.0 >= 1 AND (a.z + b.z) / 2.0 < 3 OR (a.z + b.z) / 2.0 > -1 AND (a.z + b.z) / 2.0 < 1) "
    "AND a.z < b.z) SELECT id, " + ", ".join(f'round(coalesce(max(CASE WHEN dst = {n} THEN fit END), 0), 6) AS "{n}"' for n in range(25))
    + " FROM people LEFT JOIN edges ON src = id GROUP BY id",
)
def adjacency_wide(spark, folder):
    """Export form of the adjacency: a column per vertex, zero rows kept."""
    graph = G.build_graph(nation_layer(spark, folder), rules=L.RULES)
    wide = G.adjacency_wide(graph.vertices, graph.edges, range(25))
    return wide.select("id", *[F.round(F.col(c), 6).alias(c) for c in wide.columns if c != "id"])


@query(
    "node_strength",
    f"WITH {USER_EDGES}, ends AS (SELECT layer, src AS id, fit FROM edges UNION ALL SELECT layer, dst, fit FROM edges) "
    "SELECT layer, id, round(sum(fit), 6) AS strength, count(*) AS degree FROM ends GROUP BY ALL",
)
def node_strength(spark, folder):
    """Strength and degree of everyone in every layer, from score classes."""
    strength = K.degrees(user_layers(spark, folder))
    return strength.select("layer", "id", F.round("strength", 6).alias("strength"), "degree")


@query(
    "edge_pattern",
    f"WITH {USER_EDGES} SELECT e.layer, e.src, e.dst, fit, n.z AS src_z, m.z AS dst_z FROM edges e "
    "JOIN people n ON e.layer = n.layer AND e.src = n.id JOIN people m ON e.layer = m.layer AND e.dst = m.id "
    "WHERE e.layer IN ('OPN', 'NEU')",
)
def edge_pattern(spark, folder):
    """Edges of two layers with the scores of both ends."""
    found = G.edge_pattern(user_graph(spark, folder), ["z"], ["OPN", "NEU"])
    return found.select("layer", "src", "dst", "fit", "src_z", "dst_z")


def _pagerank_sql(edges: str, nodes: str, rounds: int, keys: str = "layer, ") -> str:
    """PageRank as one common table expression per round, over ``edges`` and ``nodes``."""
    on = "n.layer = {0}.layer AND " if keys else ""
    parts = [
        f"w AS MATERIALIZED (SELECT {keys}src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY {keys}src) AS weight FROM {edges})",
        f"r0 AS MATERIALIZED (SELECT {keys}id, 1.0::DOUBLE AS rank FROM {nodes})",
    ]
    for n in range(1, rounds + 1):
        link = "w.layer = r.layer AND " if keys else ""
        wkeys = "w.layer, " if keys else ""
        nkeys = "n.layer, " if keys else ""
        parts.append(
            f"m{n} AS MATERIALIZED (SELECT {wkeys}dst AS id, sum(rank * weight) AS got FROM w JOIN r{n - 1} r ON {link}w.src = r.id GROUP BY ALL)"
        )
        parts.append(
            f"r{n} AS MATERIALIZED (SELECT {nkeys}n.id, 0.15 + 0.85 * coalesce(got, 0) AS rank FROM r0 n LEFT JOIN m{n} ON "
            + on.format(f"m{n}") + f"n.id = m{n}.id)"
        )
    return ", ".join(parts)


_PARTITION = "OVER (PARTITION BY layer)"


@query(
    "pagerank10",
    f"WITH {USER_EDGES}, {_pagerank_sql('edges', 'people', 10)} "
    f"SELECT layer, id, round(rank * count(*) {_PARTITION} / sum(rank) {_PARTITION}, 6) AS rank FROM r10",
)
def pagerank10(spark, folder):
    """Ten rounds of PageRank on all user layers at once."""
    ranks = K.pagerank(user_layers(spark, folder), iterations=10)
    return ranks.select("layer", "id", F.round("rank", 6).alias("rank"))


def trade_edges(spark, folder):
    """Customer → supplier through their orders, one edge per pair; suppliers carry negative ids."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    tasks = tasks_for(lines, lines.count())
    pairs = lines.repartition(tasks, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return pairs.select(F.col("o_custkey").alias("src"), (-F.col("l_suppkey") - 1).alias("dst")).repartition(tasks, "src", "dst").distinct()


_TRADE = (
    "trade AS (SELECT DISTINCT o_custkey AS src, -l_suppkey - 1 AS dst FROM lineitem JOIN orders ON l_orderkey = o_orderkey), "
    "both_ways AS (SELECT src, dst FROM trade UNION ALL SELECT dst, src FROM trade), "
    "nodes AS (SELECT DISTINCT src AS id FROM both_ways)"
)


@query(
    "pagerank_trade",
    f"WITH {_TRADE}, {_pagerank_sql('both_ways', 'nodes', 10, '')} "
    "SELECT id, round(rank * count(*) OVER () / sum(rank) OVER (), 6) AS rank FROM r10",
)
def pagerank_trade(spark, folder):
    """Ten rounds of PageRank on the customer-supplier graph, whose suppliers are hubs."""
    one_way = trade_edges(spark, folder)
    edges = one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = edges.select(F.col("src").alias("id"))
    ranks = G.pagerank(nodes, edges, 10, by=())
    return ranks.select("id", F.round("rank", 6).alias("rank"))


def trade_both_ways(spark, folder):
    one_way = trade_edges(spark, folder)
    return one_way.unionByName(one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _residual_sql(rounds: int, moves: str, keys: str = "") -> str:
    """Residuals spread round by round; a round in which nothing moves changes nothing."""
    parts = ["w AS MATERIALIZED (SELECT src, 1.0::DOUBLE / count(*) AS weight FROM both_ways GROUP BY src)"]
    for n in range(1, rounds + 1):
        parts.append(
            f"a{n} AS MATERIALIZED (SELECT {keys}dst AS id, sum(0.85::DOUBLE * rest * weight) AS rest FROM both_ways e JOIN w USING (src) "
            f"JOIN s{n - 1} s ON s.id = src WHERE {moves} GROUP BY ALL)"
        )
        parts.append(
            f"s{n} AS MATERIALIZED (SELECT {keys}id, sum(rank) AS rank, sum(rest) AS rest FROM (SELECT {keys}id, rank + CASE WHEN {moves} THEN rest ELSE 0 END AS rank, "
            f"CASE WHEN {moves} THEN 0 ELSE rest END AS rest FROM s{n - 1} JOIN w ON id = src UNION ALL SELECT {keys}id, 0, rest FROM a{n}) GROUP BY ALL)"
        )
    return ", ".join(parts)


@query(
    "pagerank_residuals",
    f"WITH {_TRADE}, s0 AS (SELECT id, 0.0::DOUBLE AS rank, 0.15::DOUBLE AS rest FROM nodes), {_residual_sql(60, 'rest > 0.01')} "
    "SELECT id, round(rank * count(*) OVER () / sum(rank) OVER (), 6) AS rank FROM s60",
)
def pagerank_residuals(spark, folder):
    """PageRank of the trade graph until no vertex has more than 0.01 left to add; settled vertices send no more."""
    edges = trade_both_ways(spark, folder)
    ranks, _ = P.pagerank_by_residuals(edges.select(F.col("src").alias("id")), edges, 0.01, by=())
    return ranks.select("id", F.round("rank", 6).alias("rank"))


@query(
    "pushed_ranks",
    f"WITH {_TRADE}, s0 AS (SELECT id AS source, id, 0.0::DOUBLE AS rank, 0.15::DOUBLE AS rest FROM nodes WHERE id >= 0 AND id % 20 = 0), "
    f"{_residual_sql(60, 'rest * weight > 1e-5', 'source, ')} SELECT source, id, round(rank, 7) AS rank FROM s60 WHERE rank > 0",
)
def pushed_ranks(spark, folder):
    """Personalized PageRank of every twentieth customer on the trade graph, pushed no further than the bound."""
    edges = trade_both_ways(spark, folder)
    sources = edges.select(F.col("src").alias("id")).filter((F.col("id") >= 0) & (F.col("id") % 20 == 0))
    ranks, _ = P.push_from(edges, sources, 1e-5, by=())
    return ranks.select("source", "id", F.round("rank", 7).alias("rank"))


def _settled_sql(rounds: int, tolerance: float) -> str:
    """Ranks of the first round in which none moves by more than the tolerance."""
    moved = " UNION ALL ".join(
        f"SELECT {n} AS round, max(abs(a.rank - b.rank)) AS d FROM r{n} a JOIN r{n - 1} b ON a.layer = b.layer AND a.id = b.id" for n in range(1, rounds + 1)
    )
    every = " UNION ALL ".join(f"SELECT {n} AS round, layer, id, rank FROM r{n}" for n in range(1, rounds + 1))
    return f"moved AS ({moved}), last_round AS MATERIALIZED (SELECT min(round) AS round FROM moved WHERE d <= {tolerance}), every AS ({every}), settled AS (SELECT * FROM every JOIN last_round USING (round))"


@query(
    "pagerank_tolerance",
    f"WITH {USER_EDGES}, {_pagerank_sql('edges', 'people', 40)}, {_settled_sql(40, 0.01)} "
    f"SELECT layer, id, round(rank * count(*) {_PARTITION} / sum(rank) {_PARTITION}, 3) AS rank FROM settled",
)
def pagerank_tolerance(spark, folder):
    """PageRank of the user layers until no rank moves by more than 0.01, from score classes."""
    ranks = K.pagerank_until(user_layers(spark, folder), 0.01)
    return ranks.select("layer", "id", F.round("rank", 3).alias("rank"))


def _personal_sql(rounds: int) -> str:
    parts = [
        "w AS MATERIALIZED (SELECT layer, src, dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY layer, src) AS weight FROM edges)",
        "p0 AS MATERIALIZED (SELECT layer, id AS source, id, 1.0::DOUBLE AS rank FROM sources)",
    ]
    for n in range(1, rounds + 1):
        parts.append(
            f"p{n} AS MATERIALIZED (SELECT layer, source, id, sum(rank) AS rank FROM (SELECT p.layer, source, dst AS id, "
            f"0.85 * rank * weight AS rank FROM w JOIN p{n - 1} p ON w.layer = p.layer AND w.src = p.id "
            "UNION ALL SELECT layer, id, id, 0.15 FROM sources) GROUP BY ALL)"
        )
    return ", ".join(parts)


@query(
    "personalized_pagerank",
    f"WITH {USER_EDGES}, sources AS (SELECT DISTINCT layer, first_value(id) OVER (PARTITION BY layer ORDER BY abs(z), id) AS id "
    f"FROM people), {_personal_sql(10)} SELECT layer, source, id, round(rank / sum(rank) OVER (PARTITION BY layer, source), 6) AS rank FROM p10",
)
def personalized_pagerank(spark, folder):
    """PageRank seen from the most average person of every layer, from score classes."""
    people = user_layers(spark, folder)
    nearest = F.min_by("id", F.struct(F.abs("z"), F.col("id")))
    sources = people.filter(F.col("z").isNotNull()).groupBy("layer").agg(nearest.alias("id"))
    ranks = K.personalized_pagerank(people, sources, 10)
    return ranks.select("layer", "source", "id", F.round("rank", 6).alias("rank"))


@query(
    "transition_edges",
    f"WITH {USER_EDGES} SELECT layer, src, dst, round(1.0::DOUBLE / count(*) OVER (PARTITION BY layer, src), 9) AS weight FROM edges",
)
def transition_edges(spark, folder):
    """Edges weighted by one over the out-degree, as the ranking leaves them."""
    edges = K.transition_edges(user_layers(spark, folder), L.RULES, digits=9)
    return edges.select("layer", "src", "dst", "weight")


@query(
    "components",
    f"WITH RECURSIVE {USER_EDGES}, links AS MATERIALIZED (SELECT layer, src AS u, dst AS v FROM edges UNION SELECT layer, dst, src FROM edges), "
    "reach(layer, id, root) AS (SELECT layer, id, id FROM people UNION SELECT l.layer, l.v, r.root FROM reach r JOIN links l "
    "ON l.layer = r.layer AND l.u = r.id) SELECT layer, id, min(root) AS component FROM reach GROUP BY ALL",
)
def components(spark, folder):
    """Connected components of the user layers; people without edges stand alone."""
    return K.components(user_layers(spark, folder))


@query(
    "components_trade",
    "WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT u, v FROM (SELECT o_custkey AS u, -o_orderkey - 1 AS v FROM orders "
    "UNION ALL SELECT -o_orderkey - 1, o_custkey FROM orders)), reach(id, root) AS (SELECT u, u FROM links UNION "
    "SELECT v, root FROM reach JOIN links ON u = id) SELECT id, min(root) AS component FROM reach GROUP BY id",
)
def components_trade(spark, folder):
    """Components of the customer-order graph: one star per customer; orders carry negative ids."""
    orders = table(spark, folder, "orders")
    edges = orders.select(F.col("o_custkey").alias("src"), (-F.col("o_orderkey") - 1).alias("dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return G.connected_components(nodes, edges, by=())


@query(
    "ranked_members",
    f"WITH {USER_EDGES}, {_pagerank_sql('edges', 'people', 10)}, scaled AS (SELECT layer, id, "
    f"round(rank * count(*) {_PARTITION} / sum(rank) {_PARTITION}, 6) AS rank FROM r10) "
    "SELECT layer, id, rank, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY rank DESC, id) AS place FROM scaled) WHERE place <= 10",
)
def ranked_members(spark, folder):
    """The ten best-ranked people of every layer."""
    from layerweave.operators.community import top_per_group

    return top_per_group(pagerank10(spark, folder), ["layer"], "rank", "id", 10)
