import pytest
from pyspark.sql import functions as F

from layerweave.operators import layers as L
from layerweave.operators import scores as S
from layerweave.plans import jobs
from layerweave.sources import fixed_width as W
from layerweave.sources.tables import export_as_one, read_export


def test_answers_to_names(spark, tmp_path):
    head = [f"{n:06d}{n % 2 + 1}30" + "0102030405101" + "Iceland  " + "3" * 120 for n in range(1, 9)]
    (tmp_path / "raw").write_text("\n".join(head) + "\n")
    names = spark.createDataFrame([("Ann", "F", "1971"), ("Bob", "M", "1971")], "name string, sex string, year string")
    countries = spark.createDataFrame([("Iceland", "ISL")], "name string, code string")
    out = str(tmp_path / "named")
    named = jobs.name_people(spark, str(tmp_path / "raw"), W.questionnaire_layout(), names, countries, out, single_file=True)
    rows = {r["case"]: (r["name"], r["country"], r["i7"]) for r in named.collect()}
    assert rows == {n: ("Ann" if n % 2 else "Bob", "ISL", 3.0) for n in range(1, 9)}
    assert [r["case"] for r in spark.read.csv(out, header=True, inferSchema=True).collect()] == list(range(1, 9))


def test_scores_to_communities_listed_or_not(spark, tmp_path):
    draw = [F.xxhash64("uuid", F.lit(n)) % 97 / 40.0 for n, _ in enumerate(S.FACTORS)]
    base = spark.range(30).select((F.col("id") * 3).alias("uuid"))
    scored = base.select("uuid", *[F.bround(d, 1).alias(f"{f}_Z") for d, f in zip(draw, S.FACTORS)])
    one = jobs.find_communities(scored, max_sweeps=2, out=str(tmp_path / "out"))
    two = jobs.find_communities(scored, max_sweeps=2, listed=True)
    table = lambda c: {r["id"]: pytest.approx([r[x] for x in c.columns if x != "id"], abs=1e-6) for r in c.collect()}
    assert table(one.community) == {r["id"]: [r[x] for x in two.community.columns if x != "id"] for r in two.community.collect()}
    assert one.component == two.component
    assert [r["place"] for r in one.members["A"].collect()] == [1, 2, 3, 4, 5]
    assert one.members["A"].columns == ["id", *[f"{f}_Z" for f in S.FACTORS], "place"]
    kept = read_export(spark, str(tmp_path / "out"), "results")
    assert list(kept) == ["adjacency", "community", "personality", "lambda", "input"]
    assert kept["input"].count() == 30 and kept["community"].count() == 30 and kept["personality"].count() == 5
    assert table(one.community) == {r["id"]: [r[x] for x in one.community.columns if x != "id"] for r in kept["community"].collect()}
    spans = {(r["layer"], r["pos"]): r for r in kept["adjacency"].collect()}
    edges = L.fit_edges(L.layer_vertices(scored.withColumnRenamed("uuid", "id"), S.FACTORS), L.RULES)
    linked = sum(r["n"] * sum(spans[layer, p]["n"] for s in r["spans"] for p in range(s["p"], s["q"])) for (layer, _), r in spans.items())
    assert linked == edges.count()


def test_an_export_is_seen_whole_or_not_at_all(spark, tmp_path):
    path = str(tmp_path / "export")
    good, bad = spark.range(5), spark.range(5).select(F.assert_true(F.col("id") < 3).alias("x"), "id")
    with pytest.raises(Exception):
        export_as_one(spark, {"one": good, "two": bad, "three": good}, path, "v1")
    with pytest.raises(FileNotFoundError):
        read_export(spark, path, "v1")
    first = (tmp_path / "export" / "v1" / "one" / "_SUCCESS").stat().st_mtime_ns
    assert export_as_one(spark, {"one": good, "two": spark.range(7), "three": good}, path, "v1") == ["two", "three"]
    assert (tmp_path / "export" / "v1" / "one" / "_SUCCESS").stat().st_mtime_ns == first
    assert {n: df.count() for n, df in read_export(spark, path, "v1").items()} == {"one": 5, "two": 7, "three": 5}
    assert export_as_one(spark, {"one": spark.range(9)}, path, "v1") == []
    with pytest.raises(FileNotFoundError):
        read_export(spark, path, "v2")


def test_answers_to_scores(spark, tmp_path):
    answers = spark.range(40).select(
        F.col("id").alias("CASE"), (F.col("id") % 10 != 0).cast("int").alias("IPC"),
        *[(F.xxhash64("id", F.lit(n)) % 5).cast("double").alias(f"I{n}") for n in range(1, 11)],
    )
    card = spark.createDataFrame([(f"I{n}", f"{S.FACTORS[n % 5]}1") for n in range(1, 11)], "id string, key string")
    goals = spark.createDataFrame([("health", "run"), ("career", "rise"), ("social", "meet"), ("knowledge", "read"), ("personal", "rest")], "topic string, goal string")
    scored = jobs.score_answers(answers, card, goals, first=20, out=str(tmp_path / "scored"))
    back = spark.read.parquet(str(tmp_path / "scored"))
    assert back.count() == 20 and [r["uuid"] for r in back.orderBy("uuid").limit(3).collect()] == [1, 2, 3]
    assert scored.columns == ["uuid", "IPC", *S.FACTORS, *[f"{f}_Z" for f in S.FACTORS], *[f"{f}_Q" for f in S.FACTORS], "goals"]
    assert jobs.input_table(back).schema["goals"].dataType.simpleString() == "string"
