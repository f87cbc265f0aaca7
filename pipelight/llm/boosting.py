"""Gradient-boosted regression trees for binary labels, in numpy; small and deterministic."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic loss, depth-limited trees with second-order leaf values and quantile cuts."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, least: int = 8, ridge: float = 1.0, cuts: int = 24) -> None:
        self.trees, self.depth, self.rate, self.least, self.ridge, self.cuts = trees, depth, rate, least, ridge, cuts
        self.base = 0.0
        #: Of each tree: feature, cut and leaf value of its nodes in heap order; feature -1 is a leaf.
        self.nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.cuts + 1)[1:-1])) for j in range(x.shape[1])]
        score = np.full(len(y), self.base)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(x, y - p, p * (1 - p) + 1e-9, edges)
            self.nodes.append(tree)
            score += self._apply(tree, x)
        return self

    def _grow(self, x, gradient, weight, edges):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        rows = {0: np.arange(len(x))}
        for node in range(size):
            own = rows.pop(node, None)
            if own is None:
                continue
            g, h = gradient[own].sum(), weight[own].sum()
            value[node] = self.rate * g / (h + self.ridge)
            if 2 * node + 2 >= size or own.size < 2 * self.least:
                continue
            best = (1e-6, -1, 0.0)
            for j, points in enumerate(edges):
                if not points.size:
                    continue
                at = np.searchsorted(points, x[own, j], side="left")  # x <= points[k] goes left of cut k
                gs = np.cumsum(np.bincount(at, weights=gradient[own], minlength=points.size + 1))[:-1]
                hs = np.cumsum(np.bincount(at, weights=weight[own], minlength=points.size + 1))[:-1]
                ns = np.cumsum(np.bincount(at, minlength=points.size + 1))[:-1]
                gain = gs**2 / (hs + self.ridge) + (g - gs) ** 2 / (h - hs + self.ridge) - g**2 / (h + self.ridge)
                gain[(ns < self.least) | (own.size - ns < self.least)] = -1
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), j, float(points[k]))
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                left = x[own, best[1]] <= best[2]
                rows[2 * node + 1], rows[2 * node + 2] = own[left], own[~left]
        return feature, cut, value

    @staticmethod
    def _apply(tree, x):
        feature, cut, value = tree
        node = np.zeros(len(x), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not inner.size:
                return value[node]
            at = node[inner]
            node[inner] = 2 * at + 1 + (x[inner, feature[at]] > cut[at])

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.nodes:
            out += self._apply(tree, x)
        return out


def platt(raw: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) so that 1 / (1 + exp(-(a raw + b))) is calibrated on held-out scores."""
    z = np.stack([raw, np.ones(len(raw))], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (y - p) - 1e-3 * (w - [1, 0]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])
