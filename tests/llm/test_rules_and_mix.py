from collections import Counter

import pytest
from pyspark.sql import functions as F

from layerweave.llm import mixing, quality_rules
from tests.llm import cases


def repeated_words(text):
    words = cases.words(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    return len({i + k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(8)})


def test_rules_of_odd_documents(spark):
    got = sorted(map(str, quality_rules.judge(cases.odd(spark)).select("doc_id", "n_words", "word_chars", "n_repeat_words", "base_failed").collect()))
    from pyspark.sql import Row

    expected = []
    for row in cases.rows():
        words = cases.words(row[1])
        n, again = len(words), repeated_words(row[1])
        expected.append(str(Row(doc_id=row[0], n_words=n, word_chars=sum(map(len, words)), n_repeat_words=again, base_failed=n < 20 or 100 * again > 30 * n)))
    assert got == sorted(expected)
    assert quality_rules.judge(cases.empty(spark)).count() == 0


def test_rules_drop_symbols_and_keep_prose(spark):
    docs = spark.createDataFrame([
        (1, " ".join(["the cat sat on this mat and looked at a bird"] + [f"word{i}" for i in range(20)])),
        (2, " ".join(f"w{i}### the" for i in range(30))), (3, " ".join(f"word{i}" for i in range(40))),
    ], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in quality_rules.judge(docs).collect()} == {1: True, 2: False, 3: False}


def test_mix_meets_its_targets(spark):
    docs = cases.odd(spark)
    rows = mixing.mixed_rows(docs).collect()
    assert len(rows) == docs.count()
    taken, target, size = Counter(), {}, {}
    for row in mixing.mix(docs).collect():
        taken[row["_source"]] += row["taken"] * row["copies"]
        target[row["_source"]], size[row["_source"]] = row["target"], row["source_size"]
        assert 0 <= row["taken"] <= 3 * row["size"]
    assert sum(size.values()) == sum(len(cases.words(r[1])) for r in cases.rows())
    for source in target:
        assert target[source] <= 3 * size[source] and abs(taken[source] - target[source]) <= 2  # copies of a row share evenly
    again = mixing.mixed_rows(docs.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mixed_rows(cases.empty(spark)).count() == 0


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1000, "c": 5, None: 70, "d": 0}, {"a": 100, "b": 100, "c": 100, None: 100, "d": 100}, {"a": 900, "b": 9, "c": 1, None: 1, "d": 5}, {"a": 1, "b": 2, "c": 3, None: 4, "d": 500},
])
def test_targets_by_repeated_resharing(spark, sizes):
    frame = spark.createDataFrame([(f"={s}" if s else "-", s, n) for s, n in sizes.items()], "_source string, source string, source_size long")
    got = {r["_source"]: r["target"] for r in mixing.source_targets(frame).collect()}
    order = ["a", "b", "c", "d", None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    target |= share
    assert all(abs(got[f"={s}" if s else "-"] - target[s]) < 1e-9 * (1 + target[s]) for s in order)


def test_mixed_documents_hold_the_words_taken(spark):
    docs = cases.odd(spark)
    made = mixing.mixed_documents(docs)
    assert made.columns == docs.columns
    dotted = docs.withColumn("a.b", F.lit("kept"))
    assert {r["a.b"] for r in mixing.mixed_documents(dotted).collect()} == {"kept"}
    assert sum(len(cases.words(r["text"])) for r in made.select("text").collect()) == mixing.mix(docs).agg(F.sum(F.col("taken") * F.col("copies"))).first()[0]
    part = spark.createDataFrame([(1, " one\ttwo\n three", "a"), (2, " ".join("w" * 9), "b")], "doc_id long, text string, source string")
    texts = {r["text"] for r in mixing.mixed_documents(part, weights=(1, 8)).filter("doc_id = 1").collect()}
    assert texts == {" one\t"}  # an eighth of twelve words, in whole words
    assert mixing.mixed_documents(cases.empty(spark)).count() == 0
