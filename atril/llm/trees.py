"""Gradient-boosted trees with monotonic constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """All trees' nodes in one run of arrays; a leaf has feature -1 and points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``; all trees of all rows go down one level at a time."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            lower = x[row, np.maximum(f, 0)] <= self.threshold[node]
            node = np.where(f < 0, node, np.where(lower, self.left[node], self.right[node]))
        return self.base + self.value[node].sum(1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, *, monotone: tuple[int, ...] = (), trees: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: float = 2.0) -> Forest:
    """Boost ``trees`` trees of logistic loss on histogram splits.

    monotone: for each feature 1, -1 or 0; a split that would go against it is not taken, and the two
    sides' values are held apart at their mean below it. Ties of gain go to the lower feature and bin.
    """
    n, width = x.shape
    signs = np.array(list(monotone) + [0] * (width - len(monotone)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
    rate_y = min(max(y.mean(), 1e-3), 1 - 1e-3)
    margin = np.full(n, base := float(np.log(rate_y / (1 - rate_y))))
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([-1, 0.0, len(nodes), len(nodes), 0.0])
        todo = [(len(nodes) - 1, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            at, rows, low, high, level = todo.pop()
            total_g, total_h = g[rows].sum(), h[rows].sum()
            nodes[at][4] = rate * float(np.clip(-total_g / (total_h + l2), low, high))
            best = None
            for j in range(width) if level < depth else ():
                size = len(edges[j]) + 1
                left_g = np.bincount(binned[rows, j], g[rows], size).cumsum()[:-1]
                left_h = np.bincount(binned[rows, j], h[rows], size).cumsum()[:-1]
                right_g, right_h = total_g - left_g, total_h - left_h
                left_v = np.clip(-left_g / (left_h + l2), low, high)
                right_v = np.clip(-right_g / (right_h + l2), low, high)
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - total_g**2 / (total_h + l2)
                gain[(left_h < least) | (right_h < least) | (signs[j] * (right_v - left_v) < 0)] = 0
                if len(gain) and gain.max() > (best[0] if best else 1e-6):
                    k = int(gain.argmax())
                    best = (gain[k], j, k, left_v[k], right_v[k])
            if best is None:
                margin[rows] += nodes[at][4]
                continue
            _, j, k, left_v, right_v = best
            middle = (left_v + right_v) / 2
            lower = binned[rows, j] <= k
            nodes[at][:4] = [j, float(edges[j][k]), len(nodes), len(nodes) + 1]
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[int(signs[j])]
            for side, (a, b) in zip((rows[lower], rows[~lower]), bounds, strict=True):
                todo.append((len(nodes), side, a, b, level + 1))
                nodes.append([-1, 0.0, len(nodes), len(nodes), 0.0])
    f, t, left, right, v = (np.array(c) for c in zip(*nodes, strict=True)) if nodes else (np.zeros(0),) * 5
    return Forest(f.astype(np.int32), t, left.astype(np.int32), right.astype(np.int32), np.where(f < 0, v, 0.0), np.array(roots, np.int32), depth, base)
