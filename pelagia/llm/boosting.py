"""Gradient-boosted trees for two classes on binned numeric features (logistic loss, second order)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Boosted:
    """Complete trees of one depth: per inner node a feature and a threshold, per leaf a value."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        at_row = np.arange(len(rows))
        depth = int(np.log2(self.value.shape[1])) if len(self.value) else 0
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[at_row, f[node]] > t[node])
            total += v[node - (v.shape[0] - 1)]
        return total


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Boosted:
    """Fit to ``rows`` (n x features) and 0/1 ``labels``. One class only gives a constant."""
    n, width = rows.shape if rows.ndim == 2 else (0, 0)
    share = (labels.sum() + 1.0) / (n + 2.0)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if not n or labels.min() == labels.max():
        return Boosted(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, rows[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    score = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - labels, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, dtype=np.int64)
        feature, threshold = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, size = 2 ** level - 1, 2 ** level
            local = node - first
            best = np.full(size, 1e-9)
            for f, c in enumerate(cuts):
                if not len(c):
                    continue
                key = local * BINS + binned[:, f]
                gs = np.bincount(key, weights=g, minlength=size * BINS).reshape(size, BINS).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=size * BINS).reshape(size, BINS).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs ** 2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt ** 2 / (ht + ridge)
                gain = gain[:, :len(c)]
                at = gain.argmax(axis=1)
                top = gain[np.arange(size), at]
                better = top > best
                best[better] = top[better]
                feature[first:first + size][better] = f
                threshold[first:first + size][better] = c[at[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=leaves) / (np.bincount(leaf, weights=h, minlength=leaves) + ridge)
        score += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Boosted(base, np.array(features), np.array(thresholds), np.array(values))
