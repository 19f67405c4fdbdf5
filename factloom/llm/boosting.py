"""Gradient-boosted regression trees for two classes, in numpy: binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """``feature``, ``cut`` (go right if above) and ``value`` of complete trees of one depth, node k's children at 2k+1, 2k+2."""

    depth: int
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def decision(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class for each row."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, least: int = 20, ridge: float = 1.0) -> Trees:
    """Fit on at most as many rows as fit in memory; deterministic for given rows."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    odds = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-odds))
        gradient, weight = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        at = np.zeros(n, dtype=np.int64)
        for k in range(inner):
            rows = np.flatnonzero(at == k)
            best = 1e-6
            if len(rows) >= 2 * least:
                g, h = gradient[rows], weight[rows]
                whole = g.sum() ** 2 / (h.sum() + ridge)
                for f in range(width):
                    if not len(edges[f]):
                        continue
                    b = binned[rows, f]
                    size = len(edges[f]) + 1
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, size))[:-1] for w in (g, h, np.ones(len(rows))))
                    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - whole
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best:
                        best, feature[k], cut[k] = gain[j], f, edges[f][j]
            at[rows] = 2 * k + 1 + (x[rows, feature[k]] > cut[k])
        leaf = at - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value = rate * g / (h + ridge)
        odds += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(depth, base, np.array(features), np.array(cuts), np.array(values))
