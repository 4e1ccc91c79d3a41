import numpy as np
from pyspark.sql import functions as F

from layerweave.llm import common, maxent_lm, rule_ensemble, toxicity, trees, url_filter
from tests.llm import cases


def held_out(spark, folder, classify, train, label):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, train(docs, labels)).join(labels, "doc_id").select("held_out", "score", "predicted", F.col(label).alias("label")).toPandas()


def test_quality_on_held_out_labels(spark):
    found = held_out(spark, "/root/testdata/sf0.01", rule_ensemble.classify, rule_ensemble.train, "quality")
    unseen = found[found.held_out]
    assert len(unseen) > 50 and (unseen.predicted == unseen.label).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    found = held_out(spark, "/root/testdata/sf0.1", toxicity.classify, toxicity.train, "toxic")
    unseen = found[found.held_out]
    assert unseen[unseen.label == 0].predicted.mean() < 0.01
    assert unseen[unseen.label == 1].predicted.mean() > 0.75


def test_classifiers_take_odd_documents(spark):
    docs = cases.odd(spark)
    labels = spark.createDataFrame([(4, 0, 1), (5, 1, 0), (8, 1, 0), (9, 1, 0), (None, 1, 1), (11, None, None), (13, 0, 1)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (rule_ensemble, toxicity):
        for known in (labels, none):
            model = module.train(docs, known)
            rows = module.classify(docs, model).collect()
            assert len(rows) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in rows)
            assert module.classify(cases.empty(spark), model).count() == 0
    model = rule_ensemble.train(docs, none)
    kept = rule_ensemble.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(cases.rows())  # nothing learned: even odds keep


def test_held_out_labels_are_not_learned(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    outside = docs.filter(common.fold("doc_id", 3) == 1).select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic"))
    assert rule_ensemble.train(docs, outside).rules == () and len(toxicity.train(docs, outside).terms) == 0


def test_machine_learns_a_pair_of_terms():
    draw = np.random.default_rng(1)
    x = (draw.random((3000, 6)) < 0.4).astype(float)
    y = x[:, 0] * x[:, 1]  # toxic only together
    machine = toxicity.fit_machine(x, y, np.arange(6, dtype=np.uint32), rounds=400)
    margins = [machine.margin(np.array(found, int)) for found in ([0], [1], [0, 1], [0, 2], [])]
    assert margins[2] > 0 and max(margins[i] for i in (0, 1, 3, 4)) < 0


def test_tree_column_and_rules_equal_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    model = trees.fit_boosted(x, y, trees=8)
    frame = spark.createDataFrame([tuple(map(float, row)) for row in x], "a double, b double, c double")
    got = np.array([r[0] for r in frame.select(trees.boosted_column(model, [F.col(c) for c in "abc"])).collect()])
    own = trees.sigmoid(model.base + sum(trees.predict(t, x) for t in model.trees))
    assert np.allclose(got, own) and ((own > 0.5) == (y == 1)).mean() > 0.98
    fitted = rule_ensemble.fit_rules(x, y)
    assert 0 < len(fitted.rules) < len({r for t in trees.fit_boosted(x, y, trees=20).trees for r in trees.paths(t)})


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"))


def test_urls(spark):
    urls = [
        ("http://a.example.com/en/1?x=1", "a.example.com", "/en/1", "example.com/en/", "block"), ("https://WWW.Example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        ("x://b.com/", "b.com", "/", "com/", "allow"), ("x://b.com", "b.com", "", None, None), ("x://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"),
        ("x://n.net/es/#a/b", "n.net", "/es/", "net/es/", "block"), ("x://n.net?/es/", "n.net", "", None, None), (None, "", "", None, None), ("", "", "", None, None),
        ("no scheme/com/", "", "", None, None), ("a://b://c.net/es/", "b:", "//c.net/es/", None, None), ("x://É.COM/" + "p" * 50_000, "É.com", "/" + "p" * 50_000, "com/", "allow"),
    ]
    pages = spark.createDataFrame([(i, u[0], "h", "c", "s") for i, u in enumerate(urls)] + [(0, urls[0][0], "h", "c", "s")], "page_id long, url string, html string, host string, suffix_share string")
    rows = url_filter.judge(pages, RULES).collect()
    assert len(rows) == len(urls) + 1
    for row in rows:
        _, host, path, rule, verdict = urls[row["page_id"]]
        assert (row["host"], row["path"], row["rule"]) == (host, path, rule)
        assert row["verdict"] == verdict if verdict else row["verdict"] in ("allow", "block")
    assert url_filter.judge(pages.limit(0), RULES).count() == 0
    assert {r["verdict"] for r in url_filter.judge(pages, ()).collect()} == {"allow"}


def test_trees_follow_the_labels_of_a_suffix(spark):
    hosts = [(f"http://h{i}.{'bad.zz' if i % 2 else 'good.zz'}/{'x' if i < 400 else 'new'}/{i}",) for i in range(500)]
    pages = spark.createDataFrame([(i, h[0]) for i, h in enumerate(hosts)], "page_id long, url string")
    rows = url_filter.judge(pages, (("block", "bad.zz/x/"), ("allow", "good.zz/x/"))).filter("rule is null").collect()
    assert len(rows) == 100 and np.mean([(r["verdict"] == "block") == (r["page_id"] % 2 == 1) for r in rows]) > 0.95


def test_a_url_of_very_many_rows_is_learned_once(spark, monkeypatch):
    hosts = [f"http://h{i}.{'bad.zz' if i % 2 else 'good.zz'}/x/{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(hosts + hosts[:1] * 400)), "page_id long, url string")
    seen, fit = [], url_filter.fit_boosted
    monkeypatch.setattr(url_filter, "fit_boosted", lambda x, y: seen.append(len(y)) or fit(x, y))
    url_filter.judge(pages, (("block", "bad.zz/x/"), ("allow", "good.zz/x/")), sample_rows=500).count()
    assert seen == [400]


def test_model_distribution_adds_up():
    draw = np.random.default_rng(4)
    model = maxent_lm.Model(draw.random(maxent_lm.GROUPS) * 100 + 1)
    stream = maxent_lm.Stream([[b"a", b"bc", b"def"] * 50, [], [b"x"]])
    model.learn(stream)
    whole = np.zeros(len(stream.groups))
    for group in range(maxent_lm.GROUPS):
        whole += np.exp(model.predict(stream.rows, stream.member_rows, np.full(len(whole), group)))
    assert np.allclose(whole, 1, atol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    model = maxent_lm.Model(np.ones(maxent_lm.GROUPS))
    stream = maxent_lm.Stream([[b"the", b"cat", b"sat"] * 4])
    model.weights[:] = np.random.default_rng(5).normal(0, 0.3, len(model.weights))
    _, gradient = model.predict(stream.rows, stream.member_rows, stream.groups, learn=True)
    places = np.argsort(-np.abs(gradient))[:5]
    for place in places:
        losses = []
        for move in (-0.01, 0.01):
            model.weights[place] += move
            losses.append(-model.predict(stream.rows, stream.member_rows, stream.groups).sum())
            model.weights[place] -= move
        assert abs((losses[1] - losses[0]) / 0.02 - gradient[place]) < 0.02 * (1 + abs(gradient[place]))


def test_language_model_gains_on_held_out_texts(spark, folder):
    got = maxent_lm.score(spark.read.parquet(f"{folder}/documents.parquet")).toPandas()
    assert got[got.held_out].score.sum() > got[got.held_out].base_score.sum() and got.held_out.any()


def test_language_model_counts(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(cases.odd(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 10**6))
    got = maxent_lm.score(docs).toPandas()
    texts = docs.withColumn("fold", common.fold("doc_id", 7)).toPandas()
    counts: dict = {}
    listed = [[w.lower() for w in (t or "").encode().split()] + [None] for t in texts.text]
    for fold, tokens in zip(texts.fold, listed):
        if fold != 2:
            for token in tokens:
                counts[token] = counts.get(token, 0) + 1
    total, types = sum(counts.values()), len(counts)
    expected = sorted((len(t), sum(1 for w in t if w in counts), float(sum(np.log10((counts.get(w, 0) + 1) / (total + types + 1)) for w in t))) for t in listed)
    rows = sorted(zip(got.n_tokens, got.n_known, got.base_score))
    assert len(rows) == len(expected) and set(got.train_tokens) == {total}
    for own, known in zip(rows, expected):
        assert own[:2] == known[:2] and abs(own[2] - known[2]) < 1e-6 * (1 + abs(known[2]))
    assert maxent_lm.score(cases.empty(spark)).count() == 0


def test_every_feature_of_the_language_model_has_rows_of_its_own():
    """The slopes are added up feature by feature, each over its own rows only."""
    draw = np.random.default_rng(2)
    model = maxent_lm.Model(np.ones(maxent_lm.GROUPS))
    stream = maxent_lm.Stream([[bytes([97 + c]) * int(n) for c, n in zip(draw.integers(0, 26, 90), draw.integers(1, 4, 90))] for _ in range(5)])
    for places, height in ((stream.rows, maxent_lm.CLASS_ROWS), (stream.member_rows, maxent_lm.MEMBER_ROWS)):
        assert all((row // height == n).all() for n, row in enumerate(places))
    before = model.weights.copy()
    _, gradient = model.predict(stream.rows, stream.member_rows, stream.groups, learn=True)
    assert np.array_equal(model.weights, before)
    by_class, by_member = np.split(gradient, np.cumsum(model.SIZES)[:-1])[:2]
    # The slopes of one token add up to nothing over the classes, and so do those of every row.
    assert np.allclose(by_class.reshape(-1, maxent_lm.CLASSES).sum(axis=1), 0, atol=1e-4)
    assert np.allclose(by_member.reshape(-1, maxent_lm.MEMBERS).sum(axis=1), 0, atol=1e-4)
    touched = np.unique(np.concatenate(stream.rows))
    assert set(np.flatnonzero(np.abs(by_class.reshape(-1, maxent_lm.CLASSES)).sum(axis=1) > 1e-6)) <= set(touched)
