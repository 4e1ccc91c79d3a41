"""Hashed maximum-entropy language model with class-factored softmax.

A token's class and its member group within the class come from hashes of its last and first bytes.  The class, and the
group within the class, are predicted by two softmax layers over hashed features of the context: the word before, the
pair of groups before, and the words two and three places back (skip features).  Within a group a token has its
smoothed share of the training counts.  The layers are trained by adaptive gradient steps inside the tasks, on disjoint
shares of all training texts, and the tasks' weights are averaged after each share.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import fold, largest_counts, map_arrow, texts_of
from layerweave.session import keep_table

FOLDS, HELD_OUT = 7, 2
CLASSES, MEMBERS = 16, 8
GROUPS = CLASSES * MEMBERS
#: Hashed rows per feature of the class layer and of the member layer.
CLASS_ROWS, MEMBER_ROWS = 2048, 1024
CLASS_FEATURES, MEMBER_FEATURES = 4, 2
ROUNDS, BATCH, RATE = 2, 8192, 0.3
#: Squared slopes with which every weight starts; holds back features that were seen a few times only.
CAUTION = 30.0
#: Tokens whose counts travel with the tasks; all others get theirs by a join.
COMMON_TOKENS = 200_000
# Tokens scored at a time; bounds the memory of a task whatever the length of its texts.
SPAN, STEP = 250_000, 32_768
BLOCKS = 64
# The end of a text, and what stands before its first word: no UTF-8 text holds these bytes.
END, START = b"\xff", b"\xfe"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def group_of(word: bytes) -> int:
    """Class times MEMBERS plus member."""
    return (crc32(word[-2:]) % CLASSES) * MEMBERS + crc32(word[:1], 1) % MEMBERS


@dataclass
class Model:
    """Weights of the two layers; ``shares`` holds count + types + 1 per group of tokens."""

    shares: np.ndarray
    weights: np.ndarray = field(default=None)

    SIZES = (CLASS_FEATURES * CLASS_ROWS * CLASSES, MEMBER_FEATURES * MEMBER_ROWS * GROUPS, CLASSES, GROUPS)

    def __post_init__(self):
        if self.weights is None:  # starts as the counts have it, whatever the context
            grid = self.shares.reshape(CLASSES, MEMBERS)
            start = np.log(grid.sum(axis=1)), np.log(grid / grid.sum(axis=1, keepdims=True)).ravel()
            self.weights = np.concatenate([np.zeros(sum(self.SIZES[:2])), *start]).astype(np.float32)
        self.layers = self._views(self.weights)

    def _views(self, flat: np.ndarray) -> tuple[np.ndarray, ...]:
        parts = np.split(flat, np.cumsum(self.SIZES)[:-1])
        return parts[0].reshape(-1, CLASSES), parts[1].reshape(-1, MEMBERS), parts[2], parts[3].reshape(CLASSES, MEMBERS)

    def predict(self, rows: np.ndarray, member_rows: np.ndarray, groups: np.ndarray, learn: bool = False):
        """Natural log probability of every token's group; with ``learn`` also the gradient of the loss."""
        by_class, by_member, class_bias, member_bias = self.layers
        classes, members = np.divmod(groups, MEMBERS)
        every = np.arange(len(groups))
        margins = class_bias + by_class.take(rows[0], axis=0)
        for row in rows[1:]:
            margins += by_class.take(row, axis=0)
        places = [row * CLASSES + classes for row in member_rows]
        inner = member_bias[classes]
        for place in places:
            inner += by_member.take(place, axis=0)
        logs = np.zeros(len(groups))
        slopes = []
        for margin, actual in ((margins, classes), (inner, members)):
            margin -= margin.max(axis=1, keepdims=True)
            taken = every * margin.shape[1] + actual
            reached = margin.take(taken)
            odds = np.exp(margin, out=margin)
            total = odds.sum(axis=1)
            logs += reached - np.log(total)
            if learn:
                odds /= total[:, None]
                odds.ravel()[taken] -= 1
                slopes.append(odds.astype(np.float64))
        if not learn:
            return logs
        outer, inside = slopes
        gradient = np.concatenate([  # every feature has rows of its own
            *[self._spread(row - n * CLASS_ROWS, outer, CLASS_ROWS) for n, row in enumerate(rows)],
            *[self._spread(place - n * MEMBER_ROWS * CLASSES, inside, MEMBER_ROWS * CLASSES) for n, place in enumerate(places)],
            outer.sum(axis=0), self._spread(classes, inside, CLASSES),
        ])
        return logs, gradient.astype(np.float32)

    @staticmethod
    def _spread(rows: np.ndarray, slopes: np.ndarray, height: int) -> np.ndarray:
        """Sums of the slopes per weight: one weighted count over flat places."""
        width = slopes.shape[1]
        flat = rows[:, None] * width + np.arange(width)
        return np.bincount(flat.ravel(), slopes.ravel(), height * width)

    def learn(self, stream: Stream) -> None:
        """Adaptive gradient steps over the stream, in order."""
        if not hasattr(self, "squares"):
            self.squares = np.full(len(self.weights), CAUTION, np.float32)
        for begin in range(0, len(stream.groups), BATCH):
            part = slice(begin, begin + BATCH)
            _, gradient = self.predict([r[part] for r in stream.rows], [r[part] for r in stream.member_rows], stream.groups[part], learn=True)
            self.squares += gradient * gradient
            gradient *= RATE
            gradient /= np.sqrt(self.squares)
            self.weights -= gradient


class Stream:
    """The tokens of some texts with the hashed features of their contexts, as arrays."""

    def __init__(self, texts: list[list[bytes]]):
        known: dict[bytes, int] = _Numbers()
        numbers = [known[START], known[END]]
        flat: list[int] = []
        for words in texts:
            flat += (0, 0, 0)
            flat += map(known.__getitem__, words)
            flat.append(1)
        self.vocabulary = list(known)
        line = np.array(flat, np.int64)
        self.lengths = np.array([len(words) + 1 for words in texts], np.int64)
        ends = np.cumsum(self.lengths + 3)
        at = np.arange(int(self.lengths.sum())) + np.repeat(3 * np.arange(1, len(texts) + 1), self.lengths)
        del ends, numbers
        self.tokens = line[at]
        hashes = np.fromiter(map(crc32, self.vocabulary), np.int64, len(self.vocabulary))
        group = np.fromiter(map(group_of, self.vocabulary), np.int64, len(self.vocabulary))
        self.token_groups = group
        self.groups = group[self.tokens]
        one, two, three = (line[at - back] for back in (1, 2, 3))
        pair = (group[one] * GROUPS + group[two]) * 40503 % 65521 % CLASS_ROWS
        self.rows = [
            (hashes % CLASS_ROWS)[one], pair + CLASS_ROWS, (hashes // 7 % CLASS_ROWS + 2 * CLASS_ROWS)[two], (hashes // 11 % CLASS_ROWS + 3 * CLASS_ROWS)[three],
        ]
        self.member_rows = [(hashes // 13 % MEMBER_ROWS)[one], (hashes // 17 % MEMBER_ROWS + MEMBER_ROWS)[two]]


class _Numbers(dict):
    """Numbers tokens in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def spans(texts: list[bytes]):
    """Slices of the texts, tokenized, of about SPAN tokens each."""
    begin, held, size = 0, [], 0
    for at, text in enumerate(texts):
        held.append(words_of(text))
        size += len(held[-1])
        if size >= SPAN or at == len(texts) - 1:
            yield begin, held
            begin, held, size = at + 1, [], 0


def token_counts(docs: DataFrame) -> DataFrame:
    """``token, members, n``: how often every token, the end of a text included, stands in the texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[bytes] = Counter()
        texts = texts_of(batch)
        for text in texts:
            counts.update(words_of(text))
        counts[END] = len(texts)
        tokens = list(counts)
        return pa.RecordBatch.from_pydict({
            "token": pa.array(tokens, pa.binary()), "members": pa.array([group_of(t) for t in tokens], pa.int32()), "n": pa.array(list(counts.values()), pa.int64()),
        })

    parts = map_arrow(docs.select("text"), run, "token binary, members int, n long")
    return parts.groupBy("token").agg(F.first("members").alias("members"), F.sum("n").alias("n"))


def train_round(docs: DataFrame, model: Model) -> Model:
    """The average of the weights that the tasks reach from ``model``, each on its own texts, weighted by tokens."""
    start = docs.sparkSession.sparkContext.broadcast((model.shares, model.weights))

    def run(batches):
        shares, weights = start.value
        own, seen = Model(shares, weights.copy()), 0
        for batch in batches:
            for _, texts in spans(texts_of(batch)):
                stream = Stream(texts)
                own.learn(stream)
                seen += len(stream.groups)
        if seen:
            blocks = [part.astype(np.float64) * seen for part in np.array_split(own.weights, BLOCKS)]
            mix = crc32(own.weights[:4096].tobytes()) % 512
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(range(BLOCKS), pa.int32()), "part": pa.array([mix] * BLOCKS, pa.int32()),
                "seen": pa.array([seen] * BLOCKS, pa.int64()), "sums": pa.array([b.tobytes() for b in blocks], pa.binary()),
            })

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(s, np.float64) for s in table.column("sums").to_pylist()], axis=0)
        return pa.table({
            "block": table.column("block")[:1], "part": table.column("part")[:1],
            "seen": pa.array([sum(table.column("seen").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary()),
        })

    kind = "block int, part int, seen long, sums binary"
    # The tasks' sums are added up in two steps, so that no group holds the weights of very many tasks.
    sums = docs.select("text").mapInArrow(run, kind).groupBy("block", "part").applyInArrow(add, kind)
    rows = sorted(sums.groupBy("block").applyInArrow(add, kind).collect(), key=lambda row: row["block"])
    if not rows:
        return model
    return Model(model.shares, np.concatenate([np.frombuffer(row["sums"]) / row["seen"] for row in rows]).astype(np.float32))


@lru_cache(maxsize=2)
def _common(tokens: bytes, counts: bytes) -> dict[bytes, int]:
    return dict(zip(tokens.split(b" "), np.frombuffer(counts, np.int64).tolist()))


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, one row per row of ``docs``.

    Learns from the texts outside the held-out fold and scores all.  A null or empty text is its end token alone;
    repeated rows count and are scored like any other; a null id counts as the empty text in the fold; without training
    texts every token is unknown; an empty table gives an empty table; other columns than doc_id and text are not read.
    """
    spark = docs.sparkSession
    held = fold("doc_id", FOLDS) == HELD_OUT
    training = docs.filter(~held)
    counts = keep_table(token_counts(training))
    totals = {r["members"]: (r["n"], r["types"]) for r in counts.groupBy("members").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    n, types = (sum(t[i] for t in totals.values()) for i in (0, 1))
    model = Model(np.array([sum(totals.get(g, (0, 0))) + 1.0 for g in range(GROUPS)]))
    share = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(ROUNDS))
    for turn in range(ROUNDS):  # the shares are disjoint and together hold every training text
        model = train_round(training.filter(share == turn), model)
    common = largest_counts(counts, "token", "n", COMMON_TOKENS)
    shared = spark.sparkContext.broadcast((
        model.shares, model.weights, b" ".join(common.column("token").cast(pa.binary()).to_pylist()), common.column("n").to_numpy().astype(np.int64).tobytes(),
    ))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        shares, weights, tokens, numbers = shared.value
        own, known = Model(shares, weights), _common(tokens, numbers)
        out: dict[str, list] = {"n_tokens": [], "known": [], "gains": [], "fit": []}
        rare: list[list[bytes]] = []
        for _, texts in spans(texts_of(batch)):
            stream = Stream(texts)
            logs = np.concatenate([
                own.predict([r[p:p + STEP] for r in stream.rows], [r[p:p + STEP] for r in stream.member_rows], stream.groups[p:p + STEP])
                for p in range(0, len(stream.groups), STEP)
            ])
            logs = logs / np.log(10) - np.log10(shares)[stream.groups]
            counts = np.fromiter((known.get(token, 0) for token in stream.vocabulary), np.int64, len(stream.vocabulary))
            count = counts[stream.tokens]
            starts = np.cumsum(stream.lengths) - stream.lengths
            out["n_tokens"].append(stream.lengths)
            out["known"].append(np.add.reduceat((count > 0).astype(np.int64), starts))
            out["gains"].append(np.add.reduceat(np.log10(counts + 1.0)[stream.tokens], starts))
            out["fit"].append(np.add.reduceat(logs, starts))
            missing = np.flatnonzero(count == 0)
            for part in np.split(stream.tokens[missing], np.searchsorted(missing, starts[1:])):
                rare.append([stream.vocabulary[token] for token in part])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"), "uid": batch.column("uid"), **{k: np.concatenate(v) for k, v in out.items()}, "rare": pa.array(rare, pa.list_(pa.binary())),
        })

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("uid"), "text")
    scored = keep_table(map_arrow(numbered, run, f"doc_id {kind}, uid long, n_tokens long, known long, gains double, fit double, rare array<binary>"))
    seldom = scored.select("uid", F.explode("rare").alias("token")).join(counts.select("token", "n").hint("merge"), "token")
    found = seldom.groupBy("uid").agg(F.count(F.lit(1)).alias("more_known"), F.sum(F.log10(F.col("n") + F.lit(1.0))).alias("more_gains"))
    joined = scored.drop("rare").join(found.hint("merge"), "uid", "left")
    gains = F.col("gains") + F.coalesce("more_gains", F.lit(0.0))
    return joined.select(
        "doc_id", held.alias("held_out"), "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (gains - F.col("n_tokens") * F.log10(F.lit(float(n + types + 1)))).alias("base_score"),
        (F.col("fit") + gains).alias("score"),
    )
