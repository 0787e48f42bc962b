"""Histogram gradient-boosted trees in numpy, flattened into arrays for traversal."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class FlatTrees:
    """All trees as complete binary trees of one depth: node k has children 2k+1 and 2k+2.

    A node that isn't split sends everything left (its threshold is infinite).
    """

    depth: int
    base: float
    feature: np.ndarray  # (trees, 2^depth - 1)
    threshold: np.ndarray  # (trees, 2^depth - 1)
    value: np.ndarray  # (trees, 2^depth)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        first_leaf = (1 << self.depth) - 1
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - first_leaf]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -40, 40)))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Inner bin edges: midpoints where there are few distinct values, else quantiles."""
    values = np.unique(column)
    if len(values) <= bins:
        return (values[:-1] + values[1:]) / 2
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1, bins: int = 64, ridge: float = 1.0, least_rows: int = 10) -> FlatTrees:
    """Logistic loss, level by level; of equal gains the first feature and bin win."""
    n, width = x.shape
    positive = (y.sum() + 1) / (n + 2)
    base = float(np.log(positive / (1 - positive)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        return FlatTrees(depth, base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [_cuts(x[:, f], bins) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], axis=1)
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        gradient, weight = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            k = 1 << level
            best_gain, best_f, best_bin = np.zeros(k), np.full(k, -1), np.zeros(k, np.int64)
            for f in range(width):
                if not len(cuts[f]):
                    continue
                cell, size = node * bins + binned[:, f], k * bins
                g, h, c = (np.bincount(cell, w, size).reshape(k, bins).cumsum(1) for w in (gradient, weight, None))
                gl, hl, cl = g[:, : len(cuts[f])], h[:, : len(cuts[f])], c[:, : len(cuts[f])]
                gt, ht, ct = g[:, -1:], h[:, -1:], c[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least_rows) | (ct - cl < least_rows)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(k), at]
                better = top > best_gain + 1e-9
                best_gain[better], best_f[better], best_bin[better] = top[better], f, at[better]
            first = k - 1
            split = best_f >= 0
            for j in np.flatnonzero(split):
                feature[first + j], threshold[first + j] = best_f[j], cuts[best_f[j]][best_bin[j]]
            right = split[node] & (binned[np.arange(n), np.maximum(best_f, 0)[node]] > best_bin[node])
            node = 2 * node + right
        g, h = np.bincount(node, gradient, leaves), np.bincount(node, weight, leaves)
        value = -rate * g / (h + ridge)
        raw += value[node]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return FlatTrees(depth, base, np.array(features), np.array(thresholds), np.array(values))
