"""Gradient-boosted trees for several classes, on small integer features."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Softmax boosting with Newton leaves; features are integers from 0 to ``bins`` - 1.

    Trees are complete binary trees of ``depth``, kept as arrays, so that a forest is applied by array lookups. Boosting starts from the
    shares of the classes; where the first ``hot`` features are the indicators of a group, from those within the group, smoothed.
    """

    def __init__(self, classes: int, rounds: int = 16, depth: int = 3, rate: float = 0.4, bins: int = 16, ridge: float = 1.0, hot: int = 0) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.ridge, self.hot = classes, rounds, depth, rate, bins, ridge, hot
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.prior = np.zeros((hot + 1, classes))

    def _start(self, x: np.ndarray) -> np.ndarray:
        shown = x[:, : self.hot].any(1)
        return self.prior[np.where(shown, x[:, : self.hot].argmax(1), self.hot)] if self.hot else np.tile(self.prior[0], (len(x), 1))

    def _tree(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, weight: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, dtype=np.int32), np.full(inner, self.bins, dtype=np.int32)
        at = np.zeros(len(x), dtype=np.int64)
        n, f = x.shape
        for level in range(self.depth):
            first = (1 << level) - 1
            for node in range(first, 2 * first + 1):
                rows = np.nonzero(at == node)[0]
                if weight[rows].sum() < 8:
                    continue
                xs, gs, hs = x[rows], g[rows], h[rows]
                slot = xs.astype(np.int64) + np.arange(f) * self.bins
                gh = np.bincount(slot.ravel(), np.repeat(gs, f), f * self.bins).reshape(f, self.bins).cumsum(1)
                hh = np.bincount(slot.ravel(), np.repeat(hs, f), f * self.bins).reshape(f, self.bins).cumsum(1)
                gt, ht = gs.sum(), hs.sum()
                gain = gh**2 / (hh + self.ridge) + (gt - gh) ** 2 / (ht - hh + self.ridge) - gt**2 / (ht + self.ridge)
                gain[:, -1] = -1
                best = int(gain.argmax())
                if gain.flat[best] > 1e-6:
                    feature[node], cut[node] = best // self.bins, best % self.bins
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        leaves = at - inner
        size = 1 << self.depth
        value = -self.rate * np.bincount(leaves, g, size) / (np.bincount(leaves, h, size) + self.ridge)
        return (feature, cut, value), value[leaves]

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Fit to rows ``x`` of classes ``y``; equal rows are counted once, with their number as weight."""
        rows, weight = np.unique(np.column_stack([x, y.astype(np.uint8)]), axis=0, return_counts=True)
        x, y, n = rows[:, :-1], rows[:, -1].astype(np.int64), len(rows)
        share = np.bincount(y, weight, self.classes) + 1.0
        share /= share.sum()
        for g in range(self.hot):
            rows = x[:, g] > 0
            count = np.bincount(y[rows], weight[rows], self.classes) + share
            self.prior[g] = np.log(count / count.sum())
        self.prior[self.hot] = np.log(share)
        score = self._start(x).copy()
        hot = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            row = []
            for c in range(self.classes):
                tree, step = self._tree(x, weight * (p[:, c] - hot[:, c]), weight * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6), weight)
                row.append(tree)
                score[:, c] += step
            self.trees.append(row)
        return self

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        score = self._start(x).copy()
        rows = np.arange(len(x))
        for row in self.trees:
            for c, (feature, cut, value) in enumerate(row):
                at = np.zeros(len(x), dtype=np.int64)
                for _ in range(self.depth):
                    at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
                score[:, c] += value[at - len(feature)]
        score -= score.max(1, keepdims=True)
        return score - np.log(np.exp(score).sum(1, keepdims=True))
