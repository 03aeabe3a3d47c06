"""Gradient-boosted trees for a yes/no label, in numpy: histogram splits, logistic loss, second-order leaves."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Fixed-depth trees kept as arrays: node n has children 2n + 1 and 2n + 2."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least_weight: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge, self.least_weight = trees, depth, rate, bins, ridge, least_weight
        self.feature: list[np.ndarray] = []
        self.cut: list[np.ndarray] = []
        self.leaf: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        coded = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score, inner = np.full(len(y), self.start), 2**self.depth - 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for n in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == n)
                    best = self._split(coded[rows], g[rows], h[rows]) if len(rows) > 1 else None
                    if best:
                        feature[n], cut[n] = best[0], cuts[best[0]][best[1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > cut[node])
            leaf = np.zeros(2**self.depth)
            at = node - inner
            gs, hs = np.bincount(at, g, len(leaf)), np.bincount(at, h, len(leaf))
            leaf = self.rate * gs / (hs + self.ridge)
            score += leaf[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def _split(self, coded: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        best, found = 1e-6, None
        gt, ht = g.sum(), h.sum()
        base = gt * gt / (ht + self.ridge)
        for f in range(coded.shape[1]):
            gl = np.cumsum(np.bincount(coded[:, f], g, self.bins + 1))[:-1]
            hl = np.cumsum(np.bincount(coded[:, f], h, self.bins + 1))[:-1]
            gain = gl**2 / (hl + self.ridge) + (gt - gl) ** 2 / (ht - hl + self.ridge) - base
            gain[(hl < self.least_weight) | (ht - hl < self.least_weight)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, found = gain[k], (f, k)
        return found

    def logits(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        score, rows, inner = np.full(len(x), self.start), np.arange(len(x)), 2**self.depth - 1
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            score += leaf[node - inner]
        return score
