import random

import pytest
from pyspark.sql import functions as F

from layerweave.operators import graph as G
from layerweave.operators import layers as L
from layerweave.operators import score_classes as K
from layerweave import session
from layerweave.operators import skew


def frames(spark, nodes, pairs):
    v = spark.createDataFrame([("a", n) for n in nodes], "layer string, id long")
    e = spark.createDataFrame([("a", s, d) for s, d in pairs], "layer string, src long, dst long")
    return v, e


def test_rank_of_isolated_nodes(spark):
    """70 nodes in one symmetric component keep mass 1 each; the other 30 hold 0.15 before scaling."""
    pairs = [(n, (n + 1) % 70) for n in range(70)] + [((n + 1) % 70, n) for n in range(70)]
    v, e = frames(spark, range(100), pairs)
    ranks = {r["id"]: r["rank"] for r in G.pagerank(v, e, 10).collect()}
    assert ranks[99] == pytest.approx(0.20134228187919467, abs=1e-12)
    assert sum(ranks.values()) == pytest.approx(100.0)


def power(nodes, pairs, rounds, reset=0.15):
    out = {}
    for s, _ in pairs:
        out[s] = out.get(s, 0) + 1
    rank = {n: 1.0 for n in nodes}
    for _ in range(rounds):
        got = {n: 0.0 for n in nodes}
        for s, d in pairs:
            got[d] += rank[s] / out[s]
        rank = {n: reset + (1 - reset) * got[n] for n in nodes}
    total = sum(rank.values())
    return {n: rank[n] * len(nodes) / total for n in nodes}


@pytest.mark.parametrize("task_rows", [None, 20])
def test_pagerank_equals_power_iteration_even_with_a_hub(spark, monkeypatch, task_rows):
    if task_rows:
        monkeypatch.setattr(skew, "TASK_ROWS", task_rows)
        monkeypatch.setattr(skew, "HOT_KEYS", 50)
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    draw = random.Random(3)
    pairs = [(0, n) for n in range(1, 60)] + [(n, 0) for n in range(1, 60)]
    pairs += [(draw.randrange(60), draw.randrange(60)) for _ in range(60)]
    v, e = frames(spark, range(60), pairs)
    want = power(range(60), pairs, 7)
    got = {r["id"]: r["rank"] for r in G.pagerank(v, e, 7, cut_every=3).collect()}
    assert got == pytest.approx(want)


def test_tolerance_form_reaches_the_fixed_point(spark):
    pairs = [(n, (3 * n + 1) % 20) for n in range(20)] + [(n, (n + 7) % 20) for n in range(20)]
    v, e = frames(spark, range(20), pairs)
    want = power(range(20), pairs, 200)
    got = {r["id"]: r["rank"] for r in G.pagerank_until(v, e, 1e-6).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_personalized_ranks_add_up_to_one(spark):
    v, e = frames(spark, range(6), [(0, 1), (1, 2), (2, 0), (3, 4)])
    sources = v.filter("id in (0, 3)")
    rows = G.personalized_pagerank(e, sources, 10).collect()
    for s in (0, 3):
        assert sum(r["rank"] for r in rows if r["source"] == s) == pytest.approx(1.0)
    assert {r["id"] for r in rows if r["source"] == 3} == {3, 4}


def test_unknown_ranking_leaves_the_graph(spark):
    v, e = frames(spark, range(3), [(0, 1)])
    graph = G.LayerGraph(v, e)
    with pytest.warns(UserWarning):
        assert G.run_ranking(graph, "triangle") is graph
    ranked = G.run_ranking(graph)
    assert ranked.vertices.columns == ["layer", "id", "rank"] and ranked.edges.first()["weight"] == 1.0


@pytest.mark.parametrize("task_rows", [None, 10])
def test_components_of_chain_star_and_singles(spark, monkeypatch, task_rows):
    if task_rows:
        monkeypatch.setattr(skew, "TASK_ROWS", task_rows)
        monkeypatch.setattr(skew, "HOT_KEYS", 50)
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    chain = [(n, n + 1) for n in range(100, 160)]
    star = [(500 + n, 300) for n in range(40)]
    loop = [(900, 900)]
    nodes = list(range(100, 161)) + [300] + [500 + n for n in range(40)] + [900, 901]
    v, e = frames(spark, nodes, chain + star + loop + [(7, 8)][:0])
    got = {r["id"]: r["component"] for r in G.connected_components(v, e).collect()}
    want = {n: 100 for n in range(100, 161)} | {300: 300, 900: 900, 901: 901} | {500 + n: 300 for n in range(40)}
    assert got == want


def test_components_name_the_smallest_id(spark):
    """69 nodes that point at 263: the assigned ids of the larger ones add up to 69 * 263."""
    ids = [263] + list(range(300, 369))
    v, e = frames(spark, ids + [64], [(n, 263) for n in ids[1:]])
    rows = {r["id"]: r["component"] for r in G.connected_components(v, e).collect()}
    assert rows[64] == 64 and sum(rows[n] for n in ids[1:]) == 18147


def test_wide_adjacency_keeps_silent_nodes(spark):
    v = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "layer string, id long")
    e = spark.createDataFrame([("a", 1, 2, 0.5), ("a", 1, 2, 1.5)], "layer string, src long, dst long, fit double")
    wide = {r["id"]: (r["1"], r["2"], r["3"]) for r in G.adjacency_wide(v, e, [1, 2, 3]).collect()}
    assert wide == {1: (0.0, 1.0, 0.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    block = {r["id"]: r["2"] for r in G.adjacency_wide(v, e, [2]).collect()}
    assert block == {1: 1.0, 2: 0.0, 3: 0.0}


@pytest.mark.parametrize("hot_rows", [5, 10**6])
def test_spread_and_block_joins_equal_plain_joins(spark, monkeypatch, hot_rows):
    big = spark.range(300).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 20).alias("k"), F.col("id").alias("x"))
    small = spark.range(15).select(F.col("id").alias("k"), (F.col("id") * 10).alias("y"))
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(skew, "TASK_ROWS", hot_rows)
    hot = skew.HotKeys(big, ["k"], 300)
    assert (hot.table is None) == (hot_rows > 300)
    for how in ("inner", "left"):
        want = sorted(map(str, big.join(small, "k", how).select("k", "x", "y").collect()))
        assert sorted(map(str, skew.spread_join(big, small, ["k"], [F.col("x")], hot, 15, how).select("k", "x", "y").collect())) == want
    other = big.select("k", F.col("x").alias("y")).filter("y < 100")
    blocks = skew.key_blocks(big, other, ["k"], 300, 100, hot_rows)
    want = sorted(map(str, big.join(other, "k").select("k", "x", "y").collect()))
    got = skew.block_join(big, other, ["k"], [F.col("x")], [F.col("y")], blocks).select("k", "x", "y").collect()
    assert sorted(map(str, got)) == want


def exact_walk(nodes, pairs, start, damping=0.85, rounds=400):
    """Σ over walks of the start mass, damped per step; vertices without edges keep what reaches them."""
    out = {}
    for s, _ in pairs:
        out[s] = out.get(s, 0) + 1
    total, now = dict(start), dict(start)
    for _ in range(rounds):
        after = {n: 0.0 for n in nodes}
        for s, d in pairs:
            after[d] += damping * now.get(s, 0.0) / out[s]
        now = after
        for n in nodes:
            total[n] = total.get(n, 0.0) + now[n]
    return total


def random_pairs(nodes, edges, seed):
    draw = random.Random(seed)
    return [(0, n) for n in range(1, nodes // 2)] + [(n, 0) for n in range(1, nodes // 2)] + [(draw.randrange(nodes - 5), draw.randrange(nodes)) for _ in range(edges)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_ranks_by_residuals(spark, monkeypatch, broadcast):
    """Below the fixed point by what is left, and fewer and fewer vertices send."""
    from layerweave.operators import push as P

    if not broadcast:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(skew, "TASK_ROWS", 20)
        monkeypatch.setattr(skew, "HOT_KEYS", 50)
    pairs = random_pairs(60, 90, 8)
    v, e = frames(spark, range(63), pairs)  # three vertices without any edge
    ranks, sent = P.spread(P.EdgeBuckets(e, G.LAYER), v.withColumn("rest", F.lit(0.15)), 0.05, False)
    exact = exact_walk(range(63), pairs, {n: 0.15 for n in range(63)})
    rows = {r["id"]: r for r in ranks.collect()}
    assert set(rows) == set(range(63)) and all(r["rest"] <= 0.05 for r in rows.values())
    left = sum(r["rest"] for r in rows.values())
    assert all(-1e-9 <= exact[n] - rows[n]["rank"] <= left / 0.15 + 1e-9 for n in rows)
    assert sent[0] == 63 and sent[-1] < 10 and sum(sent) < 0.75 * 63 * len(sent)
    if broadcast:
        scaled, _ = P.pagerank_by_residuals(v, e, 0.005)
        power_form = power(range(63), pairs, 100)
        assert {r["id"]: r["rank"] for r in scaled.collect()} == pytest.approx(power_form, abs=0.1)


def test_push_from_many_sources(spark):
    from layerweave.operators import push as P

    pairs = random_pairs(80, 160, 5)
    v, e = frames(spark, range(80), pairs)
    sources = [0, 7, 33, 79]
    ranks, sent = P.push_from(e, v.filter(F.col("id").isin(sources)), 2e-3)
    got = {(r["source"], r["id"]): r["rank"] for r in ranks.collect()}
    degree = {n: max(1, sum(s == n for s, _ in pairs)) for n in range(80)}
    for source in sources:
        exact = exact_walk(range(80), pairs, {source: 0.15})
        slack = 2e-3 * sum(degree.values()) / 0.15
        assert all(-1e-9 <= exact[n] - got.get((source, n), 0.0) <= slack for n in range(80))
        assert got[source, source] >= 0.15
    # A wide bound stays in the neighbourhood.
    near, few = P.push_from(e, v.filter(F.col("id").isin(sources)), 0.05)
    assert near.count() < len(got) / 4 and len(few) < len(sent)
    assert P.push_from(e, v.filter("id < 0"))[0].count() == 0


def test_a_round_reads_the_buckets_of_its_senders(spark):
    from layerweave.operators import push as P

    _, e = frames(spark, range(200), [(n, n + 1) for n in range(200)])
    kept = P.EdgeBuckets(e, G.LAYER)
    one = [r["bucket"] for r in e.filter("src = 5").select(F.col("layer"), F.col("src").alias("id")).select(kept.bucket().alias("bucket")).collect()]
    found = kept.of(one)
    assert found.filter("src = 5").count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [(bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert found.select("src").distinct().count() < 40


def listed(spark, repeat=False):
    draw = random.Random(11)
    rows = [(layer, n * 3, round(draw.gauss(0, 1.5), 1)) for layer in ("OPN", "NEU", "AGR") for n in range(25)]
    rows += [("OPN", None, 0.5), ("NEU", 900, None), ("AGR", 903, 9.0)]
    rows += [("OPN", 3, 2.5), ("OPN", 3, 2.5), ("NEU", 6, None)] if repeat else []
    return spark.createDataFrame(rows, "layer string, id long, z double")


def stored(people):
    """The same graph with its edges listed beforehand."""
    return G.LayerGraph(people, G.fit_edges(people, L.RULES))


def same_rows(one, other):
    columns = sorted(one.columns)
    return columns == sorted(other.columns) and sorted(map(repr, one.select(columns).collect())) == sorted(map(repr, other.select(columns).collect()))


@pytest.mark.parametrize("limit", [None, 0])
@pytest.mark.parametrize("repeat", [False, True])
def test_searched_edges_equal_stored_ones(spark, monkeypatch, repeat, limit):
    if limit is not None:
        monkeypatch.setattr(session, "BROADCAST_BYTES", limit)
    people = listed(spark, repeat)
    graph = G.build_graph(people, rules=L.RULES)
    assert same_rows(G.edge_pattern(graph, ["z"], ["OPN", "NEU"]), G.edge_pattern(stored(people), ["z"], ["OPN", "NEU"]))
    assert same_rows(G.indexed_edges(graph)[0], G.indexed_edges(stored(people))[0])
    assert same_rows(K.transition_edges(people, L.RULES), G.transition_edges(stored(people).edges))


def test_searched_edges_are_not_stored_nor_joined_again(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    people = listed(spark)
    graph = G.build_graph(people, rules=L.RULES)
    found = {"pattern": G.edge_pattern(graph, ["z"]), "cells": G.indexed_edges(graph)[0], "transition": K.transition_edges(people, L.RULES)}
    for name, df in found.items():
        plan = df._jdf.queryExecution().executedPlan().toString()
        above = plan.split("SortMergeJoin")[0]
        # Nothing stands above the edge search itself, and a search is there: the edges were not written before.
        assert plan.count("SortMergeJoin [_cell") == 1 and "Join" not in above and "Exchange" not in above and "Aggregate" not in above, (name, plan)
