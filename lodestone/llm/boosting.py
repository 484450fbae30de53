"""Gradient-boosted trees on binned features with logistic loss, and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 64


class BoostedTrees:
    """Depth-wise trees over quantile bins. Fitting is deterministic; ties go to the lower feature and bin."""

    def __init__(self, trees: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 1.0, least: float = 3.0) -> None:
        self.trees, self.depth, self.rate, self.l2, self.least = trees, depth, rate, l2, least

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros(x.shape, np.int64)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
        bins, width = self._binned(x), BINS + 1
        prior = (y.sum() + 0.5) / (len(y) + 1)
        self.base = float(np.log(prior / (1 - prior)))
        self.splits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        margin = np.full(len(y), self.base)
        flat = bins + np.arange(x.shape[1]) * width
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(2**level):
                    own = np.flatnonzero(node == first + k)
                    if len(own) < 2:
                        continue
                    size = x.shape[1] * width
                    at = flat[own].ravel()
                    gs = np.bincount(at, np.repeat(g[own], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                    hs = np.bincount(at, np.repeat(h[own], x.shape[1]), size).reshape(-1, width).cumsum(axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.l2) + (gt - gs) ** 2 / (ht - hs + self.l2) - gt**2 / (ht + self.l2)
                    gain[(hs < self.least / 4) | (ht - hs < self.least / 4)] = 0
                    best = int(np.argmax(gain))
                    if gain.flat[best] > 1e-9:
                        feature[first + k], cut[first + k] = divmod(best, width)
                node = 2 * node + 1 + (bins[np.arange(len(y)), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = -self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.l2)
            self.splits.append((feature, cut, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins = self._binned(x)
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.splits:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (bins[rows, feature[node]] > cut[node])
            total += value[node - (2**self.depth - 1)]
        return total


class Isotonic:
    """Monotone step means of the labels by pooled adjacent violators, interpolated between the pools' centres."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        pools: list[list[float]] = []  # sum of labels, of scores, count
        for s, t in zip(score[order], y[order], strict=True):
            pools.append([float(t), float(s), 1.0])
            while len(pools) > 1 and pools[-2][0] * pools[-1][2] >= pools[-1][0] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = np.array([s / n for _, s, n in pools])
        self.value = np.array([t / n for t, _, n in pools])
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.value)
