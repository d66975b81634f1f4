"""Gradient-boosted trees for a yes/no label, with monotonic constraints, kept as flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees' nodes in a row: ``feature`` is -1 at a leaf; rows with ``x <= cut`` go left; children follow as ``left`` and ``left + 1``."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """The chance of the label for each row of ``x``: every tree takes one step for all rows at a time."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[at]
                down = self.left[at] + (x[rows, np.maximum(f, 0)] > self.cut[at])
                at = np.where(f < 0, at, down)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: int = 10, ridge: float = 1.0) -> Forest:
    """Newton boosting on the log loss. ``monotone``: for each feature 1 (never falling), -1 (never rising) or 0.

    A split on a constrained feature must order its children's values, and the children keep to either side of the
    middle between them, so that no split below can break the order.
    """
    edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    prior = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(prior / (1 - prior)))
    feature, cut, left, value, roots = [], [], [], [], []
    total = np.full(len(y), base)

    def new() -> int:
        feature.append(-1), cut.append(0.0), left.append(0), value.append(0.0)
        return len(feature) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, p * (1 - p)
        roots.append(new())
        open_nodes = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while open_nodes:
            node, rows, level, low, high = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value[node] = float(np.clip(-g / (h + ridge), low, high)) * rate
            best = (1e-6, -1, 0, 0.0, 0.0)
            for j in range(x.shape[1] if level < depth else 0):
                k = len(edges[j]) + 1
                gl, hl, nl = (np.cumsum(np.bincount(binned[rows, j], w, k))[:-1] for w in (grad[rows], hess[rows], None))
                a, b = np.clip(-gl / (hl + ridge), low, high), np.clip(-(g - gl) / (h - hl + ridge), low, high)
                gain = gl * gl / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
                gain[(nl < least) | (len(rows) - nl < least) | (monotone[j] * (b - a) < 0)] = -1
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), j, i, float(a[i]), float(b[i]))
            _, j, i, a, b = best
            if j < 0:
                total[rows] += value[node]
                continue
            feature[node], cut[node], left[node] = j, float(edges[j][i]), new()
            new()
            middle = (a + b) / 2
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[j]]
            goes_left = binned[rows, j] <= i
            open_nodes.append((left[node], rows[goes_left], level + 1, *bounds[0]))
            open_nodes.append((left[node] + 1, rows[~goes_left], level + 1, *bounds[1]))
    return Forest(np.array(feature), np.array(cut), np.array(left), np.array(value), np.array(roots), depth, base)
