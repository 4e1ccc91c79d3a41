import math

from layerweave.operators import scores as S
from layerweave.operators.ordering import dense_index, exact_quantiles, running_total
from pyspark.sql import functions as F


def test_null_item_gives_null_sum(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 3.0, None)], "id int, I1 double, I2 double")
    out = S.factor_sums(df, {"OPN": ["I1", "I2"]})
    assert out.columns == ["id", "OPN"]
    assert {r["id"]: r["OPN"] for r in out.collect()} == {1: 3.0, 2: None}
    assert S.factor_sums(df, {"OPN": ["I1", "I2"]}, keep_items=True).columns == ["id", "I1", "I2", "OPN"]


def test_zero_spread_gives_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0)], "id int, OPN double")
    assert [r["OPN_Z"] for r in S.with_z_scores(df, ["OPN"]).collect()] == [None, None]
    one = spark.createDataFrame([(1, 5.0)], "id int, OPN double")
    assert S.with_z_scores(one, ["OPN"]).first()["OPN_Z"] is None


def test_half_even_rounding(spark):
    df = spark.createDataFrame([(0.0005,), (0.0015,), (-0.0005,)], "x double")
    assert [r[0] for r in df.select(S.z_score(F.col("x"), 0.0, 1.0)).collect()] == [0.0, 0.002, 0.0]


def test_value_on_a_cut_goes_up_and_fraction_is_dropped(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.9,), (3.0,), (-0.5,), (None,)], "x double")
    ranks = [r[0] for r in df.select(S.rank_by_cuts(F.col("x"), [0.0, 2.0, 3.0, 9.0])).collect()]
    assert ranks == [2, 3, 3, 4, 2, None]


def test_exact_quantiles_equal_the_builtin(spark):
    df = spark.range(1000).select(F.pmod(F.xxhash64("id"), F.lit(97)).cast("double").alias("x"), (F.col("id") % 2).alias("g"))
    got = {(r["g"], r["probability"]): r["cut"] for r in exact_quantiles(df, "x", [0.2, 0.4, 0.6, 0.8], ["g"]).collect()}
    for p in (0.2, 0.4, 0.6, 0.8):
        for r in df.groupBy("g").agg(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY x)").alias("q")).collect():
            assert got[(r["g"], p)] == r["q"]
    alone = exact_quantiles(df, "x", [0.5], []).first()["cut"]
    assert alone == df.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY x)")).first()[0]


def test_dense_index_does_not_depend_on_partitions(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("id"))
    for parts in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        rows = dense_index(df.repartition(5), [F.col("id")]).collect()
        assert all(r["id"] == r["idx"] for r in rows) and len(rows) == 5000
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_dense_index_with_ties_numbers_every_row(spark):
    df = spark.range(999).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"))
    rows = dense_index(df, [F.col("x")], ties=True).orderBy("idx").collect()
    assert [r["idx"] for r in rows] == list(range(999))
    assert [r["x"] for r in rows] == sorted(r["x"] for r in rows)


def test_running_total(spark):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), "id", F.lit(2).alias("w"))
    for r in running_total(df, [F.col("id")], F.col("w"), ["g"]).collect():
        assert r["total_before"] == 2 * (r["id"] // 3)


def test_approximate_cuts_are_close(spark):
    df = spark.range(10000).select(F.col("id").cast("double").alias("x"))
    for exact, near in zip(S.quantile_cuts(df, ["x"])["x"], S.quantile_cuts(df, ["x"], accuracy=1000)["x"]):
        assert math.isclose(exact, near, rel_tol=0.01)


def test_score_people(spark):
    rows = [(n, float(n % 5), float(n % 7), float(n)) for n in range(50)]
    answers = spark.createDataFrame(rows, "id int, I1 double, I2 double, noise double")
    card = spark.createDataFrame([("I1", "OPN1"), ("I2", "CSN1")], "id string, key string")
    out = S.score_people(answers, card, drop=["noise"], factors=["OPN", "CSN"])
    assert out.columns == ["id", "OPN", "CSN", "OPN_Z", "CSN_Z", "OPN_Q", "CSN_Q"]
    assert S.columns_like(out, suffix="_Z") == ["OPN_Z", "CSN_Z"]
    assert S.columns_like(out, prefix="OPN", drop=["OPN"]) == ["OPN_Z", "OPN_Q"]
