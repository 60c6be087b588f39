"""Gradient boosting of shallow regression trees for a yes or no, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic loss; splits at quantiles of the features; Newton steps at the leaves."""

    def __init__(self, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 32, smooth: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.smooth = rounds, depth, rate, bins, smooth
        self.cuts: list[np.ndarray] = []
        self.trees: list[list[tuple[int, int]]] = []
        self.leaves: list[np.ndarray] = []
        self.base = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="right") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(x.shape[1])]
        b, width = self.binned(x), self.bins + 1
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        out = np.full(len(y), self.base)
        flat = b + np.arange(b.shape[1]) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-out))
            g, h = y - p, p * (1 - p)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(self.depth):
                for n in range(1 << level):
                    rows = np.flatnonzero(node == n)
                    splits.append(self.split(flat[rows], g[rows], h[rows], b.shape[1], width))
                first = (1 << level) - 1
                feature, cut = np.array(splits[first:]).T
                node = node * 2 + (b[np.arange(len(y)), feature[node]] > cut[node])
            size = 1 << self.depth
            leaf = np.bincount(node, g, size) / (np.bincount(node, h, size) + self.smooth) * self.rate
            out += leaf[node]
            self.trees.append(splits)
            self.leaves.append(leaf)
        return self

    def split(self, flat: np.ndarray, g: np.ndarray, h: np.ndarray, features: int, width: int) -> tuple[int, int]:
        """The feature and bin to split a node after."""
        if len(g) < 8:
            return 0, width
        total = lambda w: np.bincount(flat.ravel(), np.repeat(w, features), features * width).reshape(features, width).cumsum(axis=1)
        left, weight = total(g), total(h)
        right, rest = left[:, -1:] - left, weight[:, -1:] - weight
        gain = left**2 / (weight + self.smooth) + right**2 / (rest + self.smooth)
        best = int(gain.argmax())
        return best // width, best % width

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for splits, leaf in zip(self.trees, self.leaves, strict=True):
            node = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                feature, cut = np.array(splits[(1 << level) - 1 : (2 << level) - 1]).T
                node = node * 2 + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return 1 / (1 + np.exp(-out))
