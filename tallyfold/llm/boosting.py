"""Gradient-boosted trees on histograms, for driver-sized samples, with monotonic constraints.

A fitted model is a set of numpy node arrays (feature, threshold, child, value): all
trees of all rows are walked together, one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in flat arrays. A leaf's feature is -1 and its child is itself; else children are child and child + 1."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        """Sum of the trees' values, before the logistic function."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            right = x[rows, np.maximum(f, 0)] > self.threshold[at]
            at = np.where(f < 0, at, self.child[at] + right)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


@dataclass(frozen=True)
class Settings:
    trees: int = 60
    depth: int = 4
    rate: float = 0.15
    bins: int = 64
    l2: float = 2.0
    least_rows: int = 10
    least_gain: float = 1e-3


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, s: Settings = Settings()) -> Forest:
    """Newton boosting of the logistic loss. `monotone` maps a feature to 1 (score may only rise with it) or -1.

    A split on such a feature is taken only if its leaves' values have the asked order,
    and the middle of the two values bounds all that lies below on either side, so the
    whole model is monotonic in it. No rows or one class only: a constant.
    """
    monotone = monotone or {}
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-4), 1 - 1e-4)
    base = float(np.log(mean / (1 - mean)))
    feature, threshold, child, value, roots = [], [], [], [], []
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, s.bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]) if len(x) else np.zeros(x.shape, int)
    raw = np.full(len(y), base)

    def new_node() -> int:
        feature.append(-1)
        threshold.append(0.0)
        child.append(len(child))
        value.append(0.0)
        return len(feature) - 1

    for _ in range(s.trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(new_node())
        todo = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = s.rate * float(np.clip(-gs / (hs + s.l2), low, high))
            best = (s.least_gain, -1, 0, 0.0, 0.0)
            if level < s.depth and len(rows) >= 2 * s.least_rows:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k, c = len(e) + 1, codes[rows, j]
                    gl, hl, nl = (np.bincount(c, w, k).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    vl, vr = -gl / (hl + s.l2), -(gs - gl) / (hs - hl + s.l2)
                    gain = gl**2 / (hl + s.l2) + (gs - gl) ** 2 / (hs - hl + s.l2) - gs**2 / (hs + s.l2)
                    ok = (nl >= s.least_rows) & (len(rows) - nl >= s.least_rows)
                    if way := monotone.get(j, 0):
                        ok &= way * (np.clip(vr, low, high) - np.clip(vl, low, high)) >= 0
                    gain = np.where(ok, gain, -np.inf)
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), j, b, float(vl[b]), float(vr[b]))
            _, j, b, vl, vr = best
            if j < 0:
                raw[rows] += value[node]
                continue
            left, right = new_node(), new_node()
            feature[node], threshold[node], child[node] = j, float(edges[j][b]), left
            goes = codes[rows, j] <= b
            middle = (np.clip(vl, low, high) + np.clip(vr, low, high)) / 2
            way = monotone.get(j, 0)
            todo.append((left, rows[goes], level + 1, middle if way < 0 else low, middle if way > 0 else high))
            todo.append((right, rows[~goes], level + 1, middle if way > 0 else low, middle if way < 0 else high))
    return Forest(np.array(feature, np.int64), np.array(threshold), np.array(child, np.int64), np.array(value), np.array(roots, np.int64), s.depth, base)
