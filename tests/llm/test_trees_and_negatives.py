import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layerweave.llm import dataset_manifest, hard_negatives, text_trees
from tests.llm import cases


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- op11 ----------------------------------------------------------------------------------------


def plain_leaves(text):
    """The leaves letter by letter: up to 32 code points inside a sentence, its closing marks, its line breaks."""
    out, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and text[end] not in ".!?\n" and end - at < 32:
            end += 1
        while end < len(text) and text[end] in ".!?":
            end += 1
        while end < len(text) and text[end] == "\n":
            end += 1
        out.append(text[at:end])
        at = end
    return out


def plain_likeness(a, b):
    x, y = (Counter(sha("0" + leaf)[:6] for leaf in plain_leaves(t)) for t in (a, b))
    if a == b:
        return 1.0
    return 2.0 * sum((x & y).values()) / (x.total() + y.total()) if x and y else 0.0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!?\né日", max_size=300), st.text(alphabet="ab .!?\né日", max_size=300))
def test_tree_of_a_text(a, b):
    one, two = text_trees.TextTree(a), text_trees.TextTree(b)
    assert one.leaves == plain_leaves(a)
    assert (one.root == two.root) == (a == b) == (one.fingerprint() == two.fingerprint())
    assert text_trees.likeness(one.fingerprint(), two.fingerprint()) == pytest.approx(plain_likeness(a, b))
    again = a
    for old_start, old_end, new_start, new_end in reversed(text_trees.edited_spans(one, two)):
        again = again[:old_start] + b[new_start:new_end] + again[old_end:]
    assert again == b


def test_edits_are_located():
    text = cases.prose(900, 11)
    at = text.index(" ", 2000)
    changed = text[:at] + " inserted" + text[at:]
    spans = text_trees.edited_spans(text_trees.TextTree(text), text_trees.TextTree(changed))
    # One paragraph holds the edit; the others are equal branches.
    assert len(spans) == 1 and spans[0][0] <= at <= spans[0][1]
    line_start, line_end = text.rfind("\n", 0, at) + 1, text.find("\n", at) + 1
    assert line_start <= spans[0][0] and spans[0][1] <= line_end
    near = text_trees.likeness(text_trees.TextTree(text).fingerprint(), text_trees.TextTree(changed).fingerprint())
    assert 0.9 < near < 1.0


def plain_comparison(rows):
    """Brute force over all rows in order of id; rows of one id may follow each other either way, so ids are unique here."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    out = []
    for n, (doc_id, text) in enumerate(ordered):
        text, after = text or "", ordered[(n + 1) % len(ordered)][1] or ""
        edited = text[:len(text) - len(text) // 2] + after[:len(text) // 2]
        out.append((doc_id, len(text), sha(edited), round(plain_likeness(text, edited), 9), round(plain_likeness(text, after), 9)))
    return out


@pytest.mark.parametrize("partitions", [1, 7])
def test_comparison_with_the_next_document(spark, partitions):
    draw = random.Random(7)
    rows = [(i, cases.prose(draw.randint(1, 120), i)) for i in range(0, 90, 3)] + [(91, None), (92, ""), (-5, "first.\né日本"), (None, "no id")]
    rows += [(93, cases.LONG), (94, cases.LONG)]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        docs = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, part string, place string").repartition(3)
        made = text_trees.compare_with_edits(docs)
        got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in made.collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == plain_comparison(rows)


def test_comparison_of_odd_documents(spark):
    made = text_trees.compare_with_edits(cases.odd(spark)).collect()
    texts = Counter((r[0], len(r[1] or "")) for r in cases.rows())
    assert Counter((r["doc_id"], r["n_chars"]) for r in made) == texts
    known = {text_trees.TextTree(r[1] or "").fingerprint() for r in cases.rows()}
    assert {r["fingerprint"] for r in made} == known and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in made)
    assert text_trees.compare_with_edits(cases.empty(spark)).count() == 0
    many = spark.createDataFrame([(1, "one two")] * 500 + [(None, "x")] * 300 + [(2, "b"), (0, "a")], "doc_id long, text string")
    made = Counter((r["doc_id"], r["edited_sha256"], r["near_next"]) for r in text_trees.compare_with_edits(many).collect())
    assert made == Counter({(0, sha("a"), 0.0): 1, (1, sha("one one"), 1.0): 499, (1, sha("one b"), 0.0): 1, (2, sha("b"), 0.0): 1, (None, sha("x"), 1.0): 299, (None, sha("x"), 0.0): 1})
    one = text_trees.compare_with_edits(cases.odd(spark).filter("doc_id = 11")).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in one] == [(1.0, sha("a ba "))]
    listed = text_trees.fingerprints(cases.odd(spark)).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in listed) == Counter((r[0], text_trees.TextTree(r[1] or "").fingerprint()) for r in cases.rows())


def test_edits_of_pairs(spark):
    pairs = [(1, "a.\nb.\n", "a.\nc.\n", 0), (2, None, "", 0), (3, "same", "same", 0), (None, "x", None, 0)]
    made = {r["key"]: r for r in text_trees.located_edits(spark.createDataFrame(pairs, "key long, old string, new string, likeness int")).collect()}
    assert [tuple(e) for e in made[1]["edits"]] == [(3, 6, 3, 6)] and made[1]["likeness"] == 0.5
    assert made[2]["edits"] == made[3]["edits"] == [] and made[2]["likeness"] == 1.0
    assert [tuple(e) for e in made[None]["edits"]] == [(0, 1, 0, 0)]


# --- op12 ----------------------------------------------------------------------------------------


def plain_root(digests):
    while len(digests) > 1:
        digests = [sha("".join(digests[i:i + 3])) for i in range(0, len(digests), 3)]
    return digests[0]


def plain_path(digests, at):
    path = []
    while len(digests) > 1:
        run = at // 3 * 3
        path.append(("".join(digests[run:at]), "".join(digests[at + 1:run + 3])))
        digests = [sha("".join(digests[i:i + 3])) for i in range(0, len(digests), 3)]
        at //= 3
    return path


def plain_leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_manifest(rows):
    """Rows ``doc_id, source, lang, n_chars, text`` → the contract's rows by the definition."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for name in names:
        sources[name].sort(key=lambda x: x[:3])
    subroots = [plain_root([x[2] for x in sources[n]]) for n in names]
    root, out = plain_root(subroots), []
    for place, name in enumerate(names):
        leaves = [x[2] for x in sources[name]]
        for at, (_, _, leaf, r) in enumerate(sources[name]):
            path = plain_path(leaves, at) + plain_path(subroots, place)
            text = r[4]
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded = plain_leaf(*r[:4], text)
            for left, right in path:
                folded = sha(left + folded + right)
            out.append((r[0], leaf, subroots[place], root, sha("".join(a + b for a, b in path)), folded, folded == root))
    return out


def proofs(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (3, 4, 1), (81, 82, 250, 5)])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(n * 1000 + i if i % 7 else -i, name, "en" if i % 2 else None, i, f"line {i}\nnext" if i % 5 else "") for n, name in enumerate(("é", None, "a", "Z")[:len(sizes)]) for i in range(sizes[n])]
    docs = spark.createDataFrame([(*r, "t", "s", "l") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, tree string, size string, leaf string")
    assert proofs(dataset_manifest.verify_documents(docs.repartition(3))) == Counter(plain_manifest(rows))


def test_manifest_of_odd_documents(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in cases.rows()]
    assert proofs(dataset_manifest.verify_documents(cases.odd(spark))) == Counter(plain_manifest(rows))
    assert dataset_manifest.verify_documents(cases.empty(spark)).count() == 0
    gone = cases.odd(spark).filter(F.col("doc_id") == 4).withColumns({c: F.lit(None).cast(t) for c, t in (("text", "string"), ("source", "string"), ("n_chars", "long"))})
    assert proofs(dataset_manifest.verify_documents(gone)) == Counter(plain_manifest([(4, None, "en", None, None)] * 2))


def test_manifest_nodes_and_a_source_that_holds_most_rows(spark, monkeypatch):
    from layerweave import session
    from layerweave.operators import skew

    monkeypatch.setattr(skew, "TASK_ROWS", 50)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = [(i, "big" if i < 300 else f"s{i}", "en", 1, f"t{i}") for i in range(340)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert proofs(dataset_manifest.verify_documents(docs)) == Counter(plain_manifest(rows))
    leaves = docs.select(F.col("source").alias("group"), F.col("doc_id").alias("key"), dataset_manifest.row_digest([F.col(c) for c in dataset_manifest.DOCUMENT]).alias("digest"))
    made = dataset_manifest.Manifest(leaves)
    nodes = made.nodes().filter("group = 'big'").collect()
    # 300 leaves, then 100, 34, 12, 4, 2 and the root; the intervals of a level are next to each other.
    for level, count in enumerate((300, 100, 34, 12, 4, 2, 1)):
        spans = sorted((r["lo"], r["hi"]) for r in nodes if r["level"] == level)
        assert len(spans) == count and spans[0][0] == 0 and spans[-1][1] == 300
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert len(nodes) == 453


# --- op13 ----------------------------------------------------------------------------------------


def plain_negatives(rows, is_anchor, positives=5, negatives=5):
    """All products; rows ``id, label, vector`` of integers."""
    out = set()
    for a, label, v in rows:
        if not is_anchor(a):
            continue
        scored = [(-int(np.dot(v, w)), b, other) for b, other, w in rows if b != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            fits = sorted((t, n) for t, n, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s)
            out |= {(a, p, rank, n, -s, -t) for rank, (t, n) in enumerate(fits[:negatives], 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, label int, rank int, score string").repartition(3)


def whole(rows):
    return [(i, label, np.floor(256 * np.array(np.array(v, np.float32), float)).astype(int)) for i, v, label in rows]


@pytest.mark.parametrize("width", [1, 7, 40])
def test_negatives_equal_brute_force(spark, width):
    draw = np.random.default_rng(width)
    centres = draw.normal(0, 0.3, (4, width))
    rows = [(i, [float(x) for x in centres[i % 4] + draw.normal(0, 0.15, width)], int(draw.integers(0, 3))) for i in range(240)]
    rows += [(i, [0.25] * width, i % 3) for i in range(240, 290)] + [(i, [0.0] * width, 1) for i in range(290, 300)]
    got = hard_negatives.mine(vectors(spark, rows), F.col("vec_id") % 20 == 0, candidate_rows=64, anchor_rows=5).collect()
    expected = plain_negatives(whole(rows), lambda i: i % 20 == 0)
    assert len(expected) > 20 and len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_negatives_of_odd_rows(spark):
    rows = [(20, [0.5, 0.5], 1), (1, [0.5, 0.25], 1), (2, [0.5, 0.2], 2), (3, [0.1, 0.1], 2), (4, [0.5, 0.6], 2), (5, [-0.5, -0.5], 1)]
    odd = [(40, None, 1), (6, [float("nan"), 0.5], 2), (7, [None, 0.5], 2), (8, [float("inf"), 0.5], 2), (9, [], 2), (None, [0.5, 0.2], 2), (10, [0.5, 0.2], None),
           (2, [0.5, 0.2], 2), (20, [0.5, 0.5], 1), (11, [0.5, 0.2, 0.1], 2), (60, [0.5, 0.5, 0.5], 7)]
    got = hard_negatives.mine(vectors(spark, rows + odd), F.col("vec_id") % 20 == 0).collect()
    assert {tuple(r) for r in got} == plain_negatives(whole(rows), lambda i: i % 20 == 0) and len(got) == 1
    assert hard_negatives.mine(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    # Two rows of one id are two anchors, and never meet each other.
    twice = hard_negatives.mine(vectors(spark, rows + [(20, [0.5, 0.4], 1)]), F.col("vec_id") % 20 == 0).collect()
    assert {(r["anchor_id"], r["positive_id"]) for r in twice} == {(20, 1)} and len(twice) == 2


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 70), st.integers(0, 10_000))
def test_bounds_hold_the_product(width, seed):
    draw = np.random.default_rng(seed)
    a, b = draw.integers(-300, 300, (5, width)), draw.integers(-300, 300, (6, width))
    one, two = hard_negatives.Summaries(a), hard_negatives.Summaries(b)
    exact, last = a @ b.T, None
    for level in range(len(one.levels)):
        low, high = one.bounds(level, two, slice(None), slice(None))
        assert (low <= exact).all() and (exact <= high).all()
        if last is not None and width % 32 == 0:
            assert (high - low <= last + 1e-3).all()  # finer segments are never looser
        last = high - low
