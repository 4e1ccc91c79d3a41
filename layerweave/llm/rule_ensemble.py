"""Quality classifier: a sparse ensemble of rules over text statistics.

Paths of small boosted trees become conjunctive rules, a lasso logistic fit keeps few of them, and the kept rules with
their weights become one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from layerweave.llm.common import bounded_sample, fold, map_arrow, texts_of
from layerweave.llm.trees import Condition, fit_boosted, paths, probability, sigmoid

#: The fit sees at most so many labelled rows, chosen by a hash of their id.
SAMPLE_ROWS = 20_000
FOLDS, HELD_OUT = 3, 1

STATISTICS = (
    "log_words", "word_length", "long_words", "unique_words", "upper_share", "digit_share", "symbol_rate", "bar_rate", "shout_rate", "stop_rate",
    "comma_rate", "accent_share", "lines_per_word", "repeated_lines", "control_share",
)
_CLASS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>~^=_\\@{}[]", "bar": b"|", "shout": b"!?", "stop": b".", "comma": b",;:",
    "high": range(128, 256), "control": [*range(9), *range(14, 32), 127],
}
_BYTES = np.zeros((256, len(_CLASS)))
for _place, _members in enumerate(_CLASS.values()):
    _BYTES[list(_members), _place] = 1


def statistics(text: bytes) -> list[float]:
    """The statistics of one whole text, all finite; those of an empty text are 0."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = dict(zip(_CLASS, np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BYTES))
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = counts["upper"] + counts["lower"] + counts["high"]
    characters = sum(map(len, words))
    return [
        float(np.log1p(n)), characters / n, sum(1 for w in words if len(w) > 24) / n, len(set(words)) / n, counts["upper"] / max(letters, 1), counts["digit"] / size, counts["symbol"] / n,
        counts["bar"] / n, counts["shout"] / n, counts["stop"] / n, counts["comma"] / n, counts["high"] / size, len(lines) / n,
        1 - len(set(lines)) / len(lines), counts["control"] / size,
    ]


def with_statistics(docs: DataFrame, name: str = "_statistics") -> DataFrame:
    """``docs`` with the statistics of ``text`` as one struct column."""
    fields = pa.struct([(s, pa.float64()) for s in STATISTICS])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = np.array([statistics(text) for text in texts_of(batch)])
        made = pa.StructArray.from_arrays([pa.array(column) for column in values.T], fields=list(fields))
        return pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS]))])
    return map_arrow(docs, run, schema)


@dataclass(frozen=True)
class RuleEnsemble:
    base: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...]

    def column(self, name: str = "_statistics") -> Column:
        """The probability of label 1 as an expression over the statistics."""
        margin = F.lit(self.base)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for feature, above, threshold in conditions:
                value = F.col(f"{name}.{STATISTICS[feature]}")
                holds = holds & (value > F.lit(threshold) if above else value <= F.lit(threshold))
            margin = margin + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return probability(margin)


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in rule])


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of the L1-penalised logistic loss by accelerated proximal gradient."""
    rows = len(y)
    step = 4 * rows / (np.linalg.norm(z, 2) ** 2 + rows)
    base, weight = float(np.log((y.sum() + 1) / (rows - y.sum() + 1))), np.zeros(z.shape[1])
    ahead_base, ahead, t = base, weight.copy(), 1.0
    for _ in range(rounds):
        error = sigmoid(ahead_base + z @ ahead) - y
        new_base = ahead_base - step * error.mean()
        moved = ahead - step * (z.T @ error) / rows
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pull = (t - 1) / t_next
        ahead_base, ahead = new_base + pull * (new_base - base), new + pull * (new - weight)
        base, weight, t = new_base, new, t_next
    return base, weight


def fit_rules(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, penalty: float = 1e-3) -> RuleEnsemble:
    """Rules from tree paths, weighted by lasso; one class only (or no rows) gives the smoothed share of label 1."""
    model = fit_boosted(x, y, trees=trees, depth=depth)
    rules = sorted({rule for tree in model.trees for rule in paths(tree)})
    if not rules:
        return RuleEnsemble(model.base, ())
    z = np.stack([holds(rule, x) for rule in rules], axis=1).astype(float)
    base, weights = lasso_logistic(z, y, penalty)
    return RuleEnsemble(base, tuple((rule, float(w)) for rule, w in zip(rules, weights) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleEnsemble:
    """Fits on labelled rows outside the held-out fold, at most ``sample_rows`` ids by hash order."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", FOLDS) != HELD_OUT))
    chosen = bounded_sample(known.groupBy("doc_id").agg(F.max(label).alias("_label")), ["doc_id"], sample_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most sample_rows small rows
    stats = with_statistics(texts).groupBy("doc_id", "_label").agg(F.min("_statistics").alias("_statistics"))
    rows = stats.orderBy("doc_id").collect()
    x = np.array([[float(v) for v in row["_statistics"]] for row in rows]).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([float(row["_label"]) for row in rows]))


def classify(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """``doc_id, held_out, score, predicted`` per row.

    A null text counts as empty and is scored like one; repeated rows score alike; a null id counts as the empty text in
    the fold; an empty table gives an empty table; other columns are not read.
    """
    scored = with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows of ``docs`` that the model takes for label 1, with their columns."""
    name = "_statistics"
    while name in docs.columns:
        name = f"_{name}"
    return with_statistics(docs, name).filter(model.column(name) >= 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])
