"""Gradient-boosted trees for log loss and isotonic calibration, on numpy arrays of a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Boosted trees of one depth: per tree and inner node a feature and a cut, per leaf a value."""

    base: float
    features: np.ndarray      # (trees, 2**depth - 1)
    cuts: np.ndarray          # (trees, 2**depth - 1); a value above the cut goes right
    leaves: np.ndarray        # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for f, c, v in zip(self.features, self.cuts, self.leaves):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += v[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32,
              ridge: float = 1.0) -> Trees:
    """Second-order boosting on quantile bins; ``y`` holds 0 and 1 and both occur."""
    n, k = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
    # a value is in bin b when it is above b edges
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(k)], axis=1)
    inner = 2 ** depth - 1
    mean = y.mean()
    model = Trees(float(np.log(mean / (1 - mean))), np.zeros((trees, inner), np.int64),
                  np.full((trees, inner), np.inf), np.zeros((trees, inner + 1)))
    margin = np.full(n, model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2 ** level - 1
            best = np.zeros(2 ** level)
            for j in range(k):
                if not len(edges[j]):
                    continue
                width = len(edges[j]) + 1
                cell = (node - first) * width + binned[:, j]
                g = np.bincount(cell, grad, 2 ** level * width).reshape(-1, width)
                h = np.bincount(cell, hess, 2 ** level * width).reshape(-1, width)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1, keepdims=True), h.sum(1, keepdims=True)
                gain = gl ** 2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt ** 2 / (ht + ridge)
                at = gain.argmax(1)
                value = gain[np.arange(len(at)), at]
                for s in np.flatnonzero(value > best + 1e-9):
                    best[s] = value[s]
                    model.features[t, first + s], model.cuts[t, first + s] = j, edges[j][at[s]]
            f, c = model.features[t][node], model.cuts[t][node]
            node = 2 * node + 1 + (x[np.arange(n), f] > c)
        g = np.bincount(node - inner, grad, inner + 1)
        h = np.bincount(node - inner, hess, inner + 1)
        model.leaves[t] = rate * g / (h + ridge)
        margin += model.leaves[t][node - inner]
    return model


@dataclass
class Isotonic:
    """A non-decreasing, piecewise linear map."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.interp(x, self.at, self.value)


def fit_isotonic(x: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; every pool stands at the mean of its members."""
    order = np.lexsort((y, x))
    pools: list[list[float]] = []          # sum of x, sum of y, size
    for a, b in zip(x[order], y[order]):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], last)]
    at, value, size = (np.array(c, float) for c in zip(*pools))
    return Isotonic(at / size, value / size)
