import random
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from layerweave.llm import jaccard_join, line_dedup
from tests.llm import cases


def brute_groups(rows, words, percent):
    """Smallest id per group, by comparing all pairs."""
    sets = []
    for _, text in rows:
        tokens = [w for w in (text or "").encode().lower().split()]
        sets.append({tuple(tokens[i:i + words]) for i in range(len(tokens) - words + 1)} if len(tokens) >= words else {tuple(tokens)} if tokens else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and group[i] != group[j]:
                group = [group[i] if g == group[j] else g for g in group]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i] and rows[j][0] is not None]
        out.append((str(doc_id), len(sets[i]), str(min(ids) if ids else None)))
    return sorted(out)


def grouped(docs, words, percent):
    rows = jaccard_join.components(docs, words, percent).collect()
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows)


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in cases.rows()]
    assert grouped(cases.odd(spark), 4, 85) == brute_groups(rows, 4, 85)
    assert grouped(cases.empty(spark), 4, 85) == []
    kept = jaccard_join.one_of_each(cases.odd(spark), 4, 85)
    assert kept.columns == cases.odd(spark).columns
    texts = sorted(str((r["doc_id"], (r["text"] or "")[:9])) for r in kept.collect())
    assert len(texts) == len({g for _, n, g in brute_groups(rows, 4, 85) if n and g != "None"}) + sum(1 for _, n, _ in brute_groups(rows, 4, 85) if not n) + 1


def test_chains_copies_and_shared_passages(spark, monkeypatch):
    draw = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocabulary, k=40)
    rows = []
    for base in range(12):
        text = draw.choices(vocabulary, k=draw.choice([5, 30, 120])) + (passage if base % 2 else [])
        for _ in range(8):  # a chain of small changes, each close to the one before
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((len(rows), rows[-1][1].upper()))
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 5)  # groups become grids of cells
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for words, percent in ((4, 85), (2, 60)):
        assert grouped(docs, words, percent) == brute_groups(rows, words, percent)


def test_links_inside_a_component_are_listed_and_counted(spark, monkeypatch):
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(100, ""), (101, None)]
    for _ in range(4):
        text = draw.choices(vocabulary, k=90)
        for _ in range(9):  # a dense group and its ends, which are not all linked with each other
            rows.append((len(rows), " ".join(text)))
            text = list(text)
            text[draw.randrange(len(text))] = draw.choice(vocabulary)
        rows.append((len(rows), rows[-1][1].upper()))
    rows.append(rows[-1])
    sets = {i: {tuple(w[k:k + 4]) for k in range(len(w) - 3)} for i, t in rows if (w := (t or "").lower().split()) or True}
    near = {(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])}
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["n_links"]) for r in jaccard_join.link_counts(docs, 4, 85).collect())
    assert got == sorted((i, sum(i in pair for pair in near)) for i, _ in rows)
    member, links = jaccard_join.all_links(docs, 4, 85)
    nodes = {r["node"]: r["doc_id"] for r in member.filter("node is not null").orderBy(F.col("doc_id").desc()).collect()}
    listed = [tuple(sorted((nodes[r["src"]], nodes[r["dst"]]))) for r in links.collect()]
    kept = set(nodes.values())
    assert len(listed) == len(set(listed)) and set(listed) == {(i, j) for i, j in near if {i, j} <= kept}


def test_trees_lose_no_pair():
    draw = np.random.default_rng(8)
    percent, sets = 80, []
    for _ in range(60):
        own = draw.integers(0, 2**63, draw.integers(20, 300)).astype(np.uint64)
        sets.append(np.unique(own))
        for _ in range(4):
            sets.append(np.unique(np.concatenate([own[draw.random(len(own)) > 0.08], draw.integers(0, 2**63, len(own) // 14).astype(np.uint64)])))
    sets.sort(key=len)
    n = np.array([len(s) for s in sets])
    bits = np.frombuffer(b"".join(jaccard_join.bitmap(s[:jaccard_join.prefix_size(len(s), percent)]) for s in sets), np.uint64).reshape(len(sets), -1)
    tree = jaccard_join.SignatureTree(bits, n, np.arange(len(sets)), percent)
    found = set(zip(*(p.tolist() for p in tree.pairs(percent))))
    true = {(i, j) for j in range(len(sets)) for i in range(j) if 100 * (c := len(np.intersect1d(sets[i], sets[j]))) >= percent * (n[i] + n[j] - c)}
    sketches = [jaccard_join.sketch(s) for s in sets]
    assert len({len(s) for s in sketches}) > 1  # some are folded
    near = {(i, j) for i, j in found if jaccard_join.may_be_similar(sketches[i], sketches[j], len(sets[i]), len(sets[j]), percent)}
    assert true and true <= near <= found and len(near) < len(found) and len(found) < len(sets) * (len(sets) - 1) // 8


def test_tokens_of_one_head_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKET_ROWS", 500)
    told = spark.createDataFrame([(t, n, 20, 0, n) for t in range(300) for n in range(20)], "token long, node long, holders long, head long, component long")
    facts = spark.createDataFrame([(n, 100, bytearray(128)) for n in range(20)], "node long, n long, bits binary")
    rows = jaccard_join.meetings(told, facts).toPandas()
    assert len(rows) == 6000 and rows.groupby("cell").size().eq(20).all() and rows.groupby("cell").task.nunique().eq(1).all()
    assert rows.groupby("task").size().max() <= 1000


def test_a_pair_that_meets_in_many_cells_is_held_once(monkeypatch):
    nodes, cells = 200, 100
    table = pa.table({
        "cell": np.repeat(np.arange(cells), nodes), "block": np.full(nodes * cells, -1), "node": np.tile(np.arange(nodes), cells),
        "n": np.full(nodes * cells, 100), "component": np.tile(np.arange(nodes), cells), "bits": pa.array([b"\xff" * 128] * (nodes * cells), pa.binary()),
    })
    tracemalloc.start()
    found = [np.stack(pairs, axis=1) for pairs in jaccard_join.candidates(table, 80)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1 and len(found[0]) == nodes * (nodes - 1) // 2
    assert peak < 16 * cells * len(found[0])  # less than the pairs of all cells take, two numbers of 8 bytes each
    monkeypatch.setattr(jaccard_join, "HELD_PAIRS", 1000)
    pieces = [pair for a, b in jaccard_join.candidates(table, 80) for pair in zip(a.tolist(), b.tolist())]
    assert set(pieces) == set(map(tuple, found[0].tolist()))


def test_the_nearest_pairs_come_first_and_none_is_lost():
    """Of a dense group only pairs near a record are named; the mark tells that others were left out."""
    draw = np.random.default_rng(3)
    base = draw.random(1024) < 0.2
    bits = [np.packbits(base ^ (draw.random(1024) < 0.02)).tobytes() for _ in range(60)]
    table = pa.table({"cell": np.zeros(60, np.int64), "block": np.full(60, -1), "node": np.arange(60), "n": np.full(60, 1000), "component": np.arange(60), "bits": pa.array(bits, pa.binary())})

    def named(best):
        return {pair for a, b in jaccard_join.candidates(table, 80, best) for pair in zip(a.tolist(), b.tolist())}

    every, few = named(None), named(3)
    assert len(every) == 60 * 59 // 2 and named(60) == every
    assert (-1, -1) in few and few - {(-1, -1)} < every and len(few) <= 60 * 3 + 1
    assert {n for pair in few for n in pair} >= set(range(60))


def test_a_dense_group_is_joined_by_few_pairs(spark, monkeypatch):
    """Versions of versions of one text: the pairs compared follow the texts, the groups are those of all pairs."""
    draw = random.Random(8)
    texts = [[f"w{n}" for n in range(150)]]
    for n in range(150):
        text = list(draw.choice(texts))
        for k in range(3):
            text[draw.randrange(150)] = f"e{n}x{k}"
        texts.append(text)
    rows = [(n, " ".join(text)) for n, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    looked_at, plain = [], jaccard_join.by_sketch
    monkeypatch.setattr(jaccard_join, "by_sketch", lambda pairs, *a: looked_at.append(pairs.count()) or plain(pairs, *a))
    assert grouped(docs, 4, 85) == brute_groups(rows, 4, 85)
    assert sum(looked_at) < 12 * len(rows)


def test_the_search_tests_whole_sets_before_it_names_a_pair():
    """Prefixes of the same bits and whole sets that differ: the trees cannot exclude a pair, the sketches do, at any width."""
    draw, percent = np.random.default_rng(5), 85
    sets = [np.unique(draw.integers(0, 2**63, size).astype(np.uint64)) for size in [600] * 30 + [640] * 30]
    sets += [np.concatenate([own[:-20], draw.integers(0, 2**63, 20).astype(np.uint64)]) for own in sets]
    n, sketches = np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets]
    sketches[::2] = [jaccard_join.fold(wide, 256).tobytes() for wide in sketches[::2]]
    table = pa.table({
        "cell": np.zeros(len(sets), np.int64), "block": np.full(len(sets), -1), "node": np.arange(len(sets)) * 3, "n": n, "component": np.arange(len(sets)),
        "bits": pa.array([b"\xff" * 128] * len(sets), pa.binary()),
    })

    def named(*options):
        return {pair for a, b in jaccard_join.candidates(table, percent, *options) for pair in zip(a.tolist(), b.tolist())}

    assert len(named()) == len(sets) * (len(sets) - 1) // 2
    assert named(None, sketches) == {(3 * i, 3 * (i + 60)) for i in range(60)}


def test_bands_are_those_of_the_set():
    draw = np.random.default_rng(6)
    one, other = draw.integers(0, 2**63, 300).astype(np.uint64), draw.integers(0, 2**63, 300).astype(np.uint64)
    flat = np.concatenate([one, other, np.concatenate([one[::-1], one[:9]]), one[:290]])
    keys = jaccard_join.bands(flat, np.array([300, 0, 300, 309, 290, 0]))
    assert keys.shape == (6, jaccard_join.BANDS) and not keys[[1, 5]].any()
    assert (keys[0] == keys[3]).all() and not (keys[0] == keys[2]).any() and (keys[0] == keys[4]).sum() >= 3
    assert not jaccard_join.bands(np.empty(0, np.uint64), np.zeros(2, np.int64)).any()


def passage(seed, lines, words=12):
    return [cases.prose(words, seed * 100 + i).replace("\n", " ") for i in range(lines)]


def deduped(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}


def test_every_repeated_passage_goes_and_clean_text_stays(spark):
    shared, single = passage(1, 6), cases.prose(51, 77).replace("\n", " ")
    own = [passage(10 + i, 5) for i in range(6)]
    texts = ["\n".join(own[0] + shared), "\n".join(own[1][:2] + shared + own[1][2:]), "\n".join(shared[1:] + own[2]), single + "\n" + "\n".join(own[3]), "\n".join(own[4] + [single]), "\n".join(own[5])]
    got = deduped(spark, texts)
    assert got[0] == texts[0] and got[3] == texts[3] and got[5] == texts[5]
    assert got[1] == "\n".join(own[1]) and got[2] == "\n".join(own[2]) and got[4] == "\n".join(own[4])


def test_short_repeats_stay(spark):
    line = "a line that very many documents share"
    texts = [f"{line}\n" + "\n".join(passage(i, 3)) for i in range(5)]
    assert deduped(spark, texts) == dict(enumerate(texts))


def test_lines_of_odd_documents(spark):
    docs = cases.odd(spark)
    made = line_dedup.dedup_lines(docs)
    assert made.columns == docs.columns and made.count() == docs.count()
    got = {(str(r["doc_id"]), r["text"] if r["text"] is None else r["text"][:20]) for r in made.collect()}
    for row in cases.rows():
        if row[0] in (1, 2, 3, 4, 5, 7, 10, 11, 12):
            assert (str(row[0]), row[1] if row[1] is None else row[1][:20]) in got
    left = {r["doc_id"]: r["text"] for r in made.filter(F.col("doc_id").isin(6, 13)).collect()}
    assert left[6] == "" and left[13].count("\n") == 0 and left[13] == cases.rows()[-1][1].split("\n")[0]
    assert line_dedup.dedup_lines(cases.empty(spark)).count() == 0
