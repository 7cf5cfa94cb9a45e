"""Gradient-boosted trees in numpy: softmax or logistic loss, histogram splits. Trained on the driver over a bounded sample, applied in batches."""

from __future__ import annotations

import numpy as np


class Boosted:
    """classes 1: one margin per row (logistic); else one margin per class (softmax). All arrays are plain numpy, so a model travels in a closure."""

    def __init__(self, classes: int, rounds: int = 25, depth: int = 4, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = classes, rounds, depth, rate, bins, l2, least
        self.edges: list[np.ndarray] = []
        self.trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = []
        self.base = np.zeros(max(classes, 1))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(self.edges) else np.zeros((len(x), 0), np.int16)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Boosted":
        x = np.asarray(x, float)
        w = np.ones(len(x)) if weight is None else weight
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b, k = self._binned(x), max(self.classes, 1)
        # Most features of a row are in their first bin; histograms count the others and give the rest to it.
        at_row, at_col = np.nonzero(b)
        self._ptr = np.concatenate([[0], np.cumsum(np.bincount(at_row, minlength=len(b)))])
        self._flat = at_col.astype(np.int64) * (self.bins + 1) + b[at_row, at_col]
        target = y[:, None].astype(float) if self.classes == 1 else np.eye(k)[y]
        prior = np.clip((target * w[:, None]).sum(0) / w.sum(), 1e-4, 1 - 1e-4)
        self.base = np.log(prior / (1 - prior)) if self.classes == 1 else np.log(prior)
        f = np.tile(self.base, (len(x), 1))
        for _ in range(self.rounds):
            p = self._prob(f)
            g, h = (p - target) * w[:, None], np.maximum(p * (1 - p), 1e-6) * w[:, None]
            level = []
            for c in range(k):
                tree = self._grow(b, g[:, c], h[:, c])
                level.append(tree)
                f[:, c] += self._walk(tree, b)
            self.trees.append(level)
        del self._ptr, self._flat
        return self

    def _hist(self, at: np.ndarray, v: np.ndarray, features: int) -> np.ndarray:
        """Cumulative sums of v over the bins of each feature, for rows at."""
        lens = self._ptr[at + 1] - self._ptr[at]
        entries = np.repeat(self._ptr[at] - np.concatenate([[0], np.cumsum(lens)[:-1]]), lens) + np.arange(lens.sum())
        h = np.bincount(self._flat[entries], np.repeat(v[at], lens), (self.bins + 1) * features).reshape(features, self.bins + 1)
        h[:, 0] += v[at].sum() - h.sum(1)
        return h.cumsum(1)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1, np.int32), np.zeros(size, np.int16), np.zeros(size)
        rows = {0: np.arange(len(b))}
        for node in range(size):
            if (at := rows.pop(node, None)) is None:
                continue
            gs, hs = g[at].sum(), h[at].sum()
            value[node] = -self.rate * gs / (hs + self.l2)
            if node >= size // 2 or len(at) < 2:
                continue
            gh, hh = self._hist(at, g, b.shape[1]), self._hist(at, h, b.shape[1])
            gain = gh**2 / (hh + self.l2) + (gs - gh) ** 2 / (hs - hh + self.l2) - gs**2 / (hs + self.l2)
            gain[(hh < self.least * 0.05) | (hs - hh < self.least * 0.05)] = -1
            j, t = np.unravel_index(gain.argmax(), gain.shape)
            if gain[j, t] <= 1e-6:
                continue
            feature[node], cut[node] = j, t
            left = b[at, j] <= t
            rows[2 * node + 1], rows[2 * node + 2] = at[left], at[~left]
        return feature, cut, value

    @staticmethod
    def _walk(tree: tuple[np.ndarray, np.ndarray, np.ndarray], b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), np.int64)
        while True:
            j = feature[at]
            live = np.flatnonzero(j >= 0)
            if not len(live):
                return value[at]
            at[live] = 2 * at[live] + 1 + (b[live, j[live]] > cut[at[live]])

    def _prob(self, f: np.ndarray) -> np.ndarray:
        if self.classes == 1:
            return 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        e = np.exp(f - f.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def prob(self, x: np.ndarray) -> np.ndarray:
        """Probabilities, one column a class (one column in all if classes is 1)."""
        x = np.asarray(x, float)
        b, f = self._binned(x), np.tile(self.base, (len(x), 1))
        for level in self.trees:
            for c, tree in enumerate(level):
                f[:, c] += self._walk(tree, b)
        return self._prob(f)
