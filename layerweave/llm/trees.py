"""Small boosted trees over numeric columns, fitted on a bounded sample and compiled into column expressions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A leaf when ``feature`` is None; else rows with feature <= threshold go left."""

    value: float
    feature: int | None = None
    threshold: float = 0.0
    left: Node | None = None
    right: Node | None = None


@dataclass(frozen=True)
class BoostedTrees:
    base: float
    trees: tuple[Node, ...]


def _bins(x: np.ndarray, most: int) -> tuple[np.ndarray, list[np.ndarray]]:
    edges = [np.unique(np.quantile(column, np.linspace(0, 1, most + 1)[1:-1])) for column in x.T]
    return np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T)], axis=1), edges


def _grow(binned: np.ndarray, edges: list[np.ndarray], slope: np.ndarray, curve: np.ndarray, rows: np.ndarray, depth: int, least: int, ridge: float, rate: float) -> Node:
    total_slope, total_curve = slope[rows].sum(), curve[rows].sum()
    leaf = Node(float(-rate * total_slope / (total_curve + ridge)))
    if not depth or len(rows) < 2 * least:
        return leaf
    best = (1e-6, None, 0)
    for feature, cuts in enumerate(edges):
        if not len(cuts):
            continue
        where = binned[rows, feature]
        count = np.cumsum(np.bincount(where, minlength=len(cuts) + 1))[:-1]
        s = np.cumsum(np.bincount(where, slope[rows], len(cuts) + 1))[:-1]
        c = np.cumsum(np.bincount(where, curve[rows], len(cuts) + 1))[:-1]
        gain = s**2 / (c + ridge) + (total_slope - s) ** 2 / (total_curve - c + ridge) - total_slope**2 / (total_curve + ridge)
        gain[(count < least) | (len(rows) - count < least)] = 0
        at = int(gain.argmax())
        if gain[at] > best[0]:
            best = (float(gain[at]), feature, at)
    _, feature, at = best
    if feature is None:
        return leaf
    low = binned[rows, feature] <= at
    grow = [_grow(binned, edges, slope, curve, part, depth - 1, least, ridge, rate) for part in (rows[low], rows[~low])]
    return Node(leaf.value, feature, float(edges[feature][at]), *grow)


def predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature is None:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.threshold, predict(node.left, x), predict(node.right, x))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 10, ridge: float = 1.0, bins: int = 64) -> BoostedTrees:
    """Gradient boosting of the logistic loss with second-order leaves; without rows the odds are even."""
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    if not len(y) or y.min() == y.max():
        return BoostedTrees(base, ())
    binned, edges = _bins(x, bins)
    margin, grown = np.full(len(y), base), []
    for _ in range(trees):
        p = sigmoid(margin)
        tree = _grow(binned, edges, p - y, p * (1 - p), np.arange(len(y)), depth, least, ridge, rate)
        margin += predict(tree, x)
        grown.append(tree)
    return BoostedTrees(base, tuple(grown))


def tree_column(node: Node, features: Sequence[Column]) -> Column:
    if node.feature is None:
        return F.lit(node.value)
    low, high = tree_column(node.left, features), tree_column(node.right, features)
    return F.when(features[node.feature] <= F.lit(node.threshold), low).otherwise(high)


def probability(margin: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def boosted_column(model: BoostedTrees, features: Sequence[Column]) -> Column:
    """The model's probability as one expression."""
    margin = F.lit(model.base)
    for tree in model.trees:
        margin = margin + tree_column(tree, features)
    return probability(margin)


# A condition: feature, whether the value lies above the threshold, threshold.
Condition = tuple[int, bool, float]


def paths(node: Node, so_far: tuple[Condition, ...] = ()) -> Iterator[tuple[Condition, ...]]:
    """The conjunction of conditions that leads to every node below the root."""
    if so_far:
        yield so_far
    if node.feature is not None:
        yield from paths(node.left, (*so_far, (node.feature, False, node.threshold)))
        yield from paths(node.right, (*so_far, (node.feature, True, node.threshold)))
