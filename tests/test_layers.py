import pytest
from pyspark.sql import functions as F

from layerweave import session
from layerweave.operators import layers as L
from layerweave.operators import score_classes as K
from layerweave.operators import graph as G


def people(spark, scores, layer):
    return spark.createDataFrame([(layer, n, float(z)) for n, z in enumerate(scores)], "layer string, id long, z double")


def brute(scores, rule):
    """All pairs, by the words of the rule."""
    out = set()
    for i, a in enumerate(scores):
        for j, b in enumerate(scores):
            mean = (a + b) / 2.0
            inside = any(
                (band.low is None or (mean >= band.low if band.low_closed else mean > band.low))
                and (band.high is None or (mean <= band.high if band.high_closed else mean < band.high))
                for band in rule.bands
            )
            points = {L.UP: a < b, L.DOWN: a > b, L.BOTH: True}[rule.direction]
            if i != j and inside and points:
                out.add((i, j))
    return out


SCORES = [round(-4 + 0.173 * n % 8.5, 3) for n in range(60)] + [1.0, 1.0, 3.0, 3.0, -1.0, -1.0, -3.0, -3.0, 0.0, 9.0, -9.0]


@pytest.mark.parametrize("layer, block", [("OPN", 4096), ("CSN", 3), ("EXT", 3), ("AGR", 3), ("NEU", 4096), ("OTHER", 3)])
def test_edges_equal_brute_force(spark, monkeypatch, layer, block):
    if block < 10:
        monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rule = L.rule_for(layer)
    edges = L.layer_edges(people(spark, SCORES, layer), block_rows=block).collect()
    found = [(r["src"], r["dst"]) for r in edges]
    assert len(found) == len(set(found))
    assert set(found) == brute(SCORES, rule)


def test_simple_rule_and_distance(spark):
    edges = L.distance_edges(people(spark, SCORES, "x")).collect()
    assert {(r["src"], r["dst"]) for r in edges} == brute(SCORES, L.SIMPLE_RULE)
    assert all(r["dist"] == abs(SCORES[r["src"]] - SCORES[r["dst"]]) for r in edges)


def test_band_ends(spark):
    up = L.RULES["OPN"]
    for pair, linked in (((0.5, 1.5), True), ((2.5, 3.5), False), ((0.4, 1.5), False), ((2.0, 2.0), False)):
        assert (len(L.layer_edges(people(spark, pair, "OPN")).collect()) == 1) is linked, pair
    down = {r: L.layer_edges(people(spark, p, "NEU")).count() for r, p in (("at -1", (-0.5, -1.5)), ("at -3", (-2.5, -3.5)))}
    assert down == {"at -1": 0, "at -3": 1}
    assert up.direction == L.UP


def test_a_third_of_all_people_with_one_score(spark, monkeypatch):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    scores = [1.2] * 40 + [round(0.05 * n - 2, 3) for n in range(80)]
    for layer in ("OPN", "AGR", "NEU"):
        found = {(r["src"], r["dst"]) for r in L.layer_edges(people(spark, scores, layer), block_rows=7).collect()}
        assert found == brute(scores, L.RULES[layer])


def test_no_edges_and_no_people(spark):
    assert L.layer_edges(people(spark, [0.0, 0.1], "OPN")).count() == 0
    assert L.layer_edges(people(spark, [], "OPN")).count() == 0


CLASS_RULES = {**L.RULES, "BOTH": L.LayerRule((L.Band(1.0),), L.BOTH)}


def test_score_classes_equal_listed_edges(spark):
    scores = [1.2] * 9 + [2.0, 2.0] + [round(0.1 * n - 3.3, 3) for n in range(40)]
    rows = people(spark, scores, "OPN")
    for layer in list(CLASS_RULES)[1:]:
        rows = rows.unionByName(people(spark, scores, layer))
    rows = rows.persist()
    edges = L.fit_edges(rows, CLASS_RULES).persist()
    near = lambda df, c: {(r["layer"], r["id"]): round(r[c], 6) for r in df.collect()}
    listed, classes = G.node_strength(edges), K.degrees(rows, CLASS_RULES)
    assert near(listed, "degree") == near(classes, "degree")
    assert near(listed, "strength") == near(classes, "strength")
    assert near(G.pagerank(rows, edges, 6), "rank") == near(K.pagerank(rows, CLASS_RULES, 6), "rank")
    assert near(G.connected_components(rows, edges), "component") == near(K.components(rows, CLASS_RULES), "component")


def test_band_limits_follow_the_rounded_sum(spark):
    """Thousandths whose sum with a partner rounds to the wrong side of a limit, and scores next to each other."""
    import math
    import random

    from layerweave.operators.score_line import OUT, ScoreLine, merged

    draw = random.Random(4)
    scores = {round(draw.uniform(-4, 4), 3) for _ in range(400)}
    scores |= {2.0 * m - z for z in scores for m in (1.0, -1.0, 0.1)} | {3.3, -1.3, 0.0, 1e-17, -1e-17, 2.0}
    scores |= {math.nextafter(z, d) for z in list(scores)[:200] for d in (-9.0, 9.0)}
    scores = sorted(scores)
    bands = (L.Band(1.0, 3.0), L.Band(-3.0, -1.0, low_closed=False, high_closed=True), L.Band(0.1, 0.1, high_closed=True), L.Band(None, -3.5))
    rules = {d: L.LayerRule(bands, d) for d in (L.UP, L.DOWN, L.BOTH)}
    rows = [(d, z) for d in rules for z in scores]
    line = ScoreLine(spark.createDataFrame(rows, "layer string, z double"), rules, (OUT,))
    found = line.partner_sums(line.classes, {"n": F.lit(1)}, (OUT,)).collect()
    got = {(r["layer"], r["z"]): r["n_out"] - r["own"] for r in found}
    pairs = {d: brute(scores, rule) for d, rule in rules.items()}
    want = {(d, z): 0 for d in rules for z in scores}
    for d, edges in pairs.items():
        for i, _ in edges:
            want[d, scores[i]] += 1
    assert got == want
    assert merged([L.Band(1.0, 3.0), L.Band(2.0, 4.0), L.Band(4.0, 5.0), L.Band(6.0, 7.0, low_closed=False)]) == [L.Band(1.0, 5.0), L.Band(6.0, 7.0, low_closed=False)]


@pytest.mark.parametrize("task_rows", [1_000_000, 0])
def test_intervals_in_many_partitions(spark, monkeypatch, task_rows):
    """The same with a line that is read in pieces; components that fall apart, and layers without edges."""
    from layerweave.operators import skew

    monkeypatch.setattr(skew, "TASK_ROWS", task_rows)
    rules = {"NARROW": L.LayerRule((L.Band(0.9, 1.0), L.Band(-1.0, -0.95)), L.BOTH), "UP": L.LayerRule((L.Band(0.9, 1.0),)), "NONE": L.LayerRule((L.Band(50.0),)), **CLASS_RULES}
    scores = [round(0.37 * n - 9.7, 3) for n in range(50)] + [1.9, 1.9, 0.95, 0.95, -0.96, -0.96, 7.0]
    rows = people(spark, scores, "NARROW")
    for layer in list(rules)[1:]:
        rows = rows.unionByName(people(spark, scores, layer))
    rows = rows.persist()
    edges = L.fit_edges(rows, rules).persist()
    near = lambda df, c: {(r["layer"], r["id"]): round(r[c], 6) for r in df.collect()}
    assert near(G.node_strength(edges), "strength") == near(K.degrees(rows, rules), "strength")
    assert near(G.pagerank(rows, edges, 3), "rank") == near(K.pagerank(rows, rules, 3), "rank")
    listed = near(G.connected_components(rows, edges), "component")
    assert listed == near(K.components(rows, rules), "component")
    assert len({c for (layer, _), c in listed.items() if layer == "NARROW"}) > 3
    want = {r["layer"]: (r["n"], r["a"], r["b"]) for r in edges.groupBy("layer").agg(F.count("fit").alias("n"), F.min("fit").alias("a"), F.max("fit").alias("b")).collect()}
    assert want == {r["layer"]: (r["edges"], r["lowest"], r["highest"]) for r in K.edge_extent(rows, rules).collect()}


def test_a_round_joins_no_scores(spark):
    """Sums over partners take one window and one aggregate: no join beside the tables of a few rows."""
    from layerweave.operators.score_line import IN, ScoreLine

    line = ScoreLine(K.score_classes(people(spark, SCORES, "OPN")), {"OPN": L.RULES["OPN"]})
    plan = line.partner_sums(line.classes, {"n": F.col("n")}, (IN,))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Window" in plan


def test_settled_and_personal_ranks_equal_listed_edges(spark, monkeypatch):
    """Without listing an edge, also with people who have no score or no id, and sources that reach nobody."""
    from layerweave.operators import skew

    scores = [1.2] * 9 + [2.0, 2.0] + [round(0.1 * n - 3.3, 3) for n in range(40)]
    rows = people(spark, scores, "OPN")
    for layer in ("AGR", "NEU", "BOTH"):
        rows = rows.unionByName(people(spark, scores, layer))
    odd = [("OPN", 900, None), ("NEU", None, 0.5), ("OPN", None, None), ("LONE", 5, 1.5)]
    rows = rows.unionByName(spark.createDataFrame(odd, "layer string, id long, z double")).persist()
    edges = L.fit_edges(rows, CLASS_RULES).persist()
    sources = spark.createDataFrame([(layer, n) for layer in ("OPN", "AGR", "NEU", "BOTH") for n in (3, 30)] + [("OPN", 900)], "layer string, id long")
    near = lambda df, *keys: {tuple(r[k] for k in keys): round(r["rank"], 6) for r in df.collect()}
    settled = near(G.pagerank_until(rows, edges, 0.02), "layer", "id")
    listed = {n: near(G.personalized_pagerank(edges, sources, n), "layer", "source", "id") for n in (1, 3)}
    monkeypatch.setattr(skew, "TASK_ROWS", 0)  # the line is read in pieces
    monkeypatch.setattr(L, "block_join", None)  # no pair is listed
    assert settled == near(K.pagerank_until(rows, 0.02, CLASS_RULES), "layer", "id")
    for rounds, want in listed.items():
        assert want == near(K.personalized_pagerank(rows, sources, rounds, CLASS_RULES), "layer", "source", "id")
    with pytest.raises(RuntimeError):
        K.pagerank_until(rows, 0.0, CLASS_RULES, most_rounds=2)


def test_rank_queries_list_no_edges(spark, folder, monkeypatch):
    """Pairs of people grow with their square, ranks do not."""
    from layerweave.plans.queries import QUERIES

    monkeypatch.setattr(L, "block_join", None)
    for name in ("pagerank_tolerance", "personalized_pagerank"):
        assert QUERIES[name](spark, folder).count() > 0


def test_layer_of_one_name_is_searched_in_its_own_tasks(spark, monkeypatch):
    """A constant layer column dropped out of the join's keys, and the search ran in as many tasks as the session sets."""
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(L, "PAIRS_PER_TASK", 100)
    rows = spark.range(80).select(F.lit("OPN").alias("layer"), "id", (F.col("id") * 0.07 - 2).alias("z"))
    edges = L.layer_edges(rows, block_rows=7)
    assert {(r["src"], r["dst"]) for r in edges.collect()} == brute([r["z"] for r in rows.orderBy("id").collect()], L.RULES["OPN"])
    joined = edges._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")[1]
    assert "REPARTITION_BY_NUM" in joined and "_lb" in joined and "ENSURE_REQUIREMENTS" not in joined


@pytest.mark.parametrize("tasks", [None, 12])
def test_rows_without_a_key_meet_nothing_in_blocks(spark, monkeypatch, tasks):
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    from layerweave.operators import skew

    left = spark.createDataFrame([("a", 1, 10), (None, 1, 11), ("a", None, 12), ("b", 2, 13)], "k string, n int, x int")
    right = spark.createDataFrame([("a", 1, 20), (None, 1, 21), ("a", None, 22), ("a", 1, 23)], "k string, n int, y int")
    blocks = spark.createDataFrame([("a", 1, 2, 2)], "k string, n int, _left_blocks int, _right_blocks int")
    for cut in (None, blocks):
        met = skew.block_join(left, right, ["k", "n"], [F.col("x")], [F.col("y")], cut, tasks=tasks)
        assert {(r["k"], r["n"], r["x"], r["y"]) for r in met.collect()} == {("a", 1, 10, 20), ("a", 1, 10, 23)}
        assert met.count() == 2
