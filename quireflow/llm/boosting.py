"""Gradient-boosted trees of fixed depth for yes/no labels, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Boosted:
    """Complete trees: ``feature`` and ``cut`` by (tree, inner node), ``leaf`` by (tree, leaf)."""

    start: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def quantiles(column: np.ndarray, weight: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Distinct quantiles, the lower one between two, of values that stand for ``weight`` equal ones each."""
    order = np.argsort(column, kind="stable")
    upto = np.cumsum(weight[order])
    return np.unique(column[order][np.searchsorted(upto, np.floor(shares * (upto[-1] - 1)), side="right")])


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss; splits by exact gain over quantile bins, ties to the first feature and cut.

    A row stands for ``weight`` equal ones, a whole number; by default for itself.
    """
    weight = np.ones(len(y)) if weight is None else np.asarray(weight, dtype=np.float64)
    edges = [quantiles(column, weight, np.linspace(0, 1, bins + 1)[1:-1]) for column in x.T]
    binned = np.stack([np.searchsorted(e, column, side="left") for e, column in zip(edges, x.T, strict=True)])
    n_features, inner, leaves = x.shape[1], 2**depth - 1, 2**depth
    share = np.clip(np.average(y, weights=weight), 1e-6, 1 - 1e-6)
    start = float(np.log(share / (1 - share)))
    total = np.full(len(y), start)
    feature, cut, leaf = np.zeros((trees, inner), dtype=np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    width = bins + 1
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        node = np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best, chosen, at = np.full(count, 1e-6), np.zeros(count, dtype=np.int64), np.full(count, -1)
            place = (node - first) * width
            for f in range(n_features):
                g = np.bincount(place + binned[f], slope, count * width).reshape(count, width).cumsum(1)
                h = np.bincount(place + binned[f], curve, count * width).reshape(count, width).cumsum(1)
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain = gain[:, : len(edges[f])]
                if gain.shape[1]:
                    k = gain.argmax(1)
                    value = gain[np.arange(count), k]
                    better = value > best + 1e-9
                    best[better], chosen[better], at[better] = value[better], f, k[better]
            for k in np.flatnonzero(at >= 0):
                feature[t, first + k], cut[t, first + k] = chosen[k], edges[chosen[k]][at[k]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[t, node]] > cut[t, node])
        g = np.bincount(node - inner, slope, leaves)
        h = np.bincount(node - inner, curve, leaves)
        leaf[t] = rate * g / (h + ridge)
        total += leaf[t][node - inner]
    return Boosted(start, feature, cut, leaf)
