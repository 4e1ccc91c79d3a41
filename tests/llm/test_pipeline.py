import importlib

from pyspark.sql import functions as F

from tests.llm import cases
from tests.llm.test_duplicates import brute_groups

pipeline = importlib.import_module("corpus_pipeline")


def test_every_stage_acts_on_what_the_last_one_kept(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before, after = seen["quality_classifier"]
    kept = after.join(labels, "doc_id").agg(F.avg("quality")).first()[0]
    assert after.count() < before.count() and kept > 0.95
    before, after = seen["line_dedup"]
    assert before.count() == after.count()
    before, after = seen["jaccard_join"]
    rows = [(r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect()]
    groups = brute_groups(rows, 5, 80)
    assert after.count() == len({g for _, n, g in groups if n}) + sum(1 for _, n, _ in groups if not n)
    left = [(r["doc_id"], r["text"]) for r in after.select("doc_id", "text").collect()]
    assert len({g for _, n, g in brute_groups(left, 5, 80) if n}) == sum(1 for _, n, _ in brute_groups(left, 5, 80) if n)
    before, after = seen["mix_sources"]
    total = sum(len(cases.words(r["text"])) for r in before.select("text").collect())
    assert abs(sum(len(cases.words(r["text"])) for r in after.select("text").collect()) - total) <= 20  # a word per source
    before, after = seen["byte_bpe"]
    assert after.count() == before.count()
    run = pipeline.run(spark, folder).drop("ids").collect()
    assert sorted(map(str, run)) == sorted(map(str, after.drop("ids").collect()))


def test_stages_take_odd_documents(spark, tmp_path):
    cases.empty(spark).select("doc_id").withColumns({"quality": F.lit(1), "toxic": F.lit(0)}).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (cases.odd(spark), cases.empty(spark)):
        for _, stage in pipeline.STAGES:
            assert stage(spark, docs, str(tmp_path)).count() <= 4 * len(cases.rows())
