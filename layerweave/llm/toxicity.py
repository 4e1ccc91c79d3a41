"""Toxicity: a factorization machine over hashed terms.

A text is the set of its hashed terms.  Beside a weight per term, every term has a short factor vector, and the inner
product of two factors is the weight of the pair, so that two terms together can mean more than their sum.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from layerweave.llm.common import bounded_sample, fold, map_arrow, texts_of
from layerweave.llm.trees import sigmoid

#: The fit sees at most so many labelled rows, chosen by a hash of their id.
SAMPLE_ROWS = 12_000
TERMS, FACTORS, LEAST_DOCUMENTS = 512, 8, 3
FOLDS, HELD_OUT, CUT = 3, 1, 0.7
#: Weight of a toxic row beside a clean one in the fit, since toxic rows are rare.
RARE_CLASS = 3.0
#: Bytes of a word's beginning that count as a term, so that inflected and compound forms share one.
BEGINNINGS = (5, 6, 7)
_TERM = re.compile(rb"[a-z\x80-\xff]+")


def hashed_terms(text: bytes) -> np.ndarray:
    """The different terms of one whole text as 32-bit hashes: runs of letters (A-Z lower-cased) and their beginnings."""
    words = set(_TERM.findall(text.lower()))
    hashes = set(map(crc32, words))
    for length in BEGINNINGS:
        hashes.update([crc32(start, length) for start in {word[:length] for word in words if len(word) > length}])
    return np.fromiter(hashes, np.uint32, len(hashes))


@dataclass(frozen=True)
class FactorizationMachine:
    terms: np.ndarray  # sorted hashes
    base: float
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, found: np.ndarray) -> float:
        """Linear part plus all pairs of the terms at ``found``, by the square of the sum less the sum of squares."""
        v = self.factors[found]
        return self.base + self.weights[found].sum() + 0.5 * float((v.sum(axis=0) ** 2).sum() - (v * v).sum())

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.empty(0, int)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return at[self.terms[at] == hashes]

    def score(self, text: bytes) -> float:
        return float(sigmoid(np.array(self.margin(self.places(hashed_terms(text))))))


def fit_machine(x: np.ndarray, y: np.ndarray, terms: np.ndarray, factors: int = FACTORS, rounds: int = 250, ridge: float = 1e-4, rate: float = 0.1) -> FactorizationMachine:
    """Full-batch adaptive gradient descent of the logistic loss; ``x`` is rows x terms of 0 and 1."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    weights, v = np.zeros(len(terms)), np.random.default_rng(7).normal(0, 0.05, (len(terms), factors))
    if len(y) and len(terms) and y.min() != y.max():
        x = x.astype(np.float32)
        memory = [np.zeros(1), np.zeros_like(weights), np.zeros_like(v)]
        shift = np.array([base])
        for _ in range(rounds):
            sums = x @ v
            margin = shift[0] + x @ weights + 0.5 * ((sums**2).sum(axis=1) - x @ (v * v).sum(axis=1))
            error = (sigmoid(margin) - y) * np.where(y == 1, RARE_CLASS, 1.0) / len(y)
            pull = x.T @ error
            slopes = [np.array([error.sum()]), pull + ridge * weights, x.T @ (error[:, None] * sums) - pull[:, None] * v + ridge * v]
            for value, slope, squares in zip((shift, weights, v), slopes, memory):
                squares += slope * slope
                value -= rate * slope / (np.sqrt(squares) + 1e-8)
        base = float(shift[0])
    return FactorizationMachine(terms, base, weights, v)


def choose_terms(found: list[np.ndarray], y: np.ndarray, terms: int = TERMS, least: int = LEAST_DOCUMENTS) -> np.ndarray:
    """The hashes that tell the classes apart best by their document counts, sorted."""
    if not len(y) or y.min() == y.max():
        return np.empty(0, np.uint32)
    hashes, place = np.unique(np.concatenate(found), return_inverse=True)
    n = np.bincount(place, minlength=len(hashes))
    ones = np.bincount(place, np.repeat(y, [len(f) for f in found]), len(hashes))
    share = y.mean()
    surprise = np.where(n >= least, np.abs(ones - n * share) / np.sqrt(n * share * (1 - share)), -1)
    best = np.lexsort((hashes, -surprise))[:terms]
    return np.sort(hashes[best[surprise[best] >= 0]])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fits on labelled rows outside the held-out fold, at most ``sample_rows`` ids by hash order."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max(label).alias("_label")), ["doc_id"], sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows small rows

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.sort(hashed_terms(text)).tobytes() for text in texts_of(batch)]
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "_label": batch.column("_label"), "terms": pa.array(found, pa.binary())})

    kinds = {f.name: f.dataType.simpleString() for f in texts.schema}
    hashed = map_arrow(texts, run, f"doc_id {kinds['doc_id']}, _label {kinds['_label']}, terms binary")
    rows = hashed.groupBy("doc_id", "_label").agg(F.min("terms").alias("terms")).orderBy("doc_id").collect()
    y = np.array([float(row["_label"]) for row in rows])
    found = [np.frombuffer(row["terms"], np.uint32) for row in rows]
    terms = choose_terms(found, y)
    machine = FactorizationMachine(terms, 0.0, np.zeros(len(terms)), np.zeros((len(terms), 1)))
    x = np.zeros((len(rows), len(terms)), np.float32)
    for at, hashes in enumerate(found):
        x[at, machine.places(hashes)] = 1
    return fit_machine(x, y, terms)


def classify(docs: DataFrame, model: FactorizationMachine) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.

    A null text counts as empty (the base score); repeated rows score alike; a null id counts as the empty text in the
    fold; an empty table gives an empty table; other columns are not read.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array([model.score(text) for text in texts_of(batch)], pa.float64())})

    scored = map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
