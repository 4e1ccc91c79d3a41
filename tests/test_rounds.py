"""Edges laid out for many rounds: hubs by target, all others in buckets by source."""

import pytest
from pyspark.sql import functions as F

from layerweave import session
from layerweave.operators import graph as G
from layerweave.operators import push as P
from tests.test_graph import exact_walk, frames, power, random_pairs


@pytest.fixture
def few_hubs(monkeypatch):
    """Room for two hubs of a graph with one layer: rows * (32 + 24 * 3) bytes."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 2 * (32 + 24 * 3))


def test_a_round_moves_no_edge(spark, few_hubs):
    pairs = random_pairs(60, 90, 8)
    v, e = frames(spark, range(63), pairs)
    walk = G.Walk(e, G.LAYER)
    nodes = session.cut_lineage(walk.weighted(v, 0.15))
    hubs, own, rest, _ = walk.laid
    assert 0 < hubs.rows <= 2 and own.count() + rest.count() == len(pairs)
    assert [r["src"] for r in own.select("src").distinct().collect()] == [0]
    plan = walk.step(nodes, nodes, 0.85)._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "BroadcastHashJoin" in plan
    ranks = {r["id"]: r["rank"] for r in G.pagerank(v, e, 6).collect()}
    assert ranks == pytest.approx(power(range(63), pairs, 6))


def test_residuals_with_hubs_by_target(spark, few_hubs):
    pairs = random_pairs(60, 90, 8)
    v, e = frames(spark, range(63), pairs)
    kept = P.EdgeBuckets(e, G.LAYER)
    assert kept.of_hubs.count() + kept.rows.filter("not hub").count() == len(pairs) == kept.rows.count()
    ranks, _ = P.spread(kept, v.withColumn("rest", F.lit(0.15)), 0.05, False)
    exact = exact_walk(range(63), pairs, {n: 0.15 for n in range(63)})
    rows = {r["id"]: r for r in ranks.collect()}
    left = sum(r["rest"] for r in rows.values())
    assert all(r["rest"] <= 0.05 for r in rows.values())
    assert all(-1e-9 <= exact[n] - rows[n]["rank"] <= left / 0.15 + 1e-9 for n in rows)
