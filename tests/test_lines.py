"""Answer lines are made by as many tasks as there are people for."""

from layerweave.plans import people_queries as Q


def test_lines_are_spread_over_tasks(spark, folder, monkeypatch):
    people = spark.read.parquet(f"{folder}/customer.parquet").count()
    monkeypatch.setattr(Q, "LINES_PER_TASK", -(-people // 3))
    lines = Q.answer_lines(spark, folder)
    assert lines.rdd.getNumPartitions() == 3 and lines.count() == people
