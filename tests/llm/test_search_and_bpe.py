import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from layerweave.llm import byte_bpe, impact_search
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BPE = byte_bpe.ByteBPE(byte_bpe.read_ranks(PATH), public_tokenizers.PATTERN)
RANKS = {base64.b64decode(token): number for token, number in zip(*[iter(byte_bpe.read_ranks(PATH).split())] * 2)}
KNOWN = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks={k: int(v) for k, v in RANKS.items()}, special_tokens={})


def ids(text):
    return np.frombuffer(BPE.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_bpe_equals_the_public_tokenizer(text):
    assert ids(text) == KNOWN.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode()


def test_bpe_of_long_pieces_and_odd_space():
    draw = random.Random(5)
    for text in ("ab" * 4000, "a" * 5000, "thntionble" * 900, " \x1c\x85\u3000 \u2028x", "".join(draw.choices("etaoin \n'st", k=9000))):
        assert ids(text) == KNOWN.encode_ordinary(text)


def test_bpe_of_odd_documents(spark):
    made = byte_bpe.encode_documents(cases.odd(spark), PATH, public_tokenizers.PATTERN, ids=True)
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in made.collect())
    expected = []
    for row in cases.rows():
        known = np.array(KNOWN.encode_ordinary(row[1] or ""), "<u4")
        expected.append((str(row[0]), len(known), hashlib.sha256(known.tobytes()).hexdigest(), hashlib.sha256((row[1] or "").encode()).hexdigest()))
    assert got == sorted(expected)
    back = byte_bpe.decode_documents(made, PATH, public_tokenizers.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(r[0]), r[1] or "") for r in cases.rows())
    assert byte_bpe.encode_documents(cases.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rank string, score string, width string")


def test_search_equals_brute_force_with_ties(spark):
    draw = np.random.default_rng(3)
    made = [(i, [float(x) for x in draw.normal(0, 0.1, 12)]) for i in range(300)]
    made += [(i, [0.25] * 12) for i in range(300, 380)]  # equal vectors
    made += [(i, [0.0] * 12) for i in range(380, 390)]
    rows = [(i, v, 0, "r", "s", "w") for i, v in made]
    extra = [(400, None, 0, "r", "s", "w"), (401, [float("nan")] * 12, 0, "r", "s", "w"), (402, [None] * 12, 0, "r", "s", "w"), (500, [], 0, "r", "s", "w"),
             (None, [0.9] * 12, 0, "r", "s", "w"), (600, [0.5, 0.5], 0, "r", "s", "w"), (601, [0.5, 0.1], 0, "r", "s", "w"), (100, made[100][1], 1, "r", "s", "w")]
    got = impact_search.top_k(vectors(spark, rows + extra), F.col("vec_id") % 20 == 0, block_rows=64, query_rows=7).collect()
    whole = {i: np.floor(1024 * np.array(np.array(v, np.float32), float)).astype(int) for i, v in made}
    expected = set()
    for i in whole:
        if i % 20 == 0:
            best = sorted((-int(whole[i] @ v), j) for j, v in whole.items() if j != i)[:10]
            expected |= {(i, k + 1, j, -s) for k, (s, j) in enumerate(best)}
    expected.add((600, 1, 601, 512 * 512 + 512 * 102))
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == expected and len(got) == len(expected)
    assert impact_search.top_k(vectors(spark, []), F.col("vec_id") % 20 == 0).count() == 0
