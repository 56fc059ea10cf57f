"""Gradient-boosted trees for a yes/no label, trained in numpy on a bounded sample, with calibrated probabilities.

Trees have a fixed depth and are stored level by level, so that a prediction is `depth` comparisons, in numpy for
batches of rows or as SQL for columns.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    depth: int
    feature: np.ndarray  # trees x (2^depth - 1)
    cut: np.ndarray
    leaf: np.ndarray  # trees x 2^depth
    start: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Calibrated log-odds of each row."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            total += v[at - (2**self.depth - 1)]
        return self.slope * total + self.shift

    def sql(self, feature: Callable[[int], str]) -> str:
        """The same log-odds as SQL, where feature(k) is the k-th feature's."""

        def node(t: int, at: int) -> str:
            if at >= 2**self.depth - 1:
                return f"{float(self.leaf[t][at - (2**self.depth - 1)])!r}D"
            low, high = node(t, 2 * at + 1), node(t, 2 * at + 2)
            cut = float(self.cut[t][at])
            return low if cut == np.inf else f"IF({feature(self.feature[t][at])} > {cut!r}D, {high}, {low})"

        total = " + ".join([f"{float(self.start)!r}D", *(node(t, 0) for t in range(len(self.leaf)))])
        return f"({total}) * {float(self.slope)!r}D + {float(self.shift)!r}D"


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    out = []
    for k in range(x.shape[1]):
        values = np.unique(x[:, k])
        if len(values) > most:
            values = np.unique(np.quantile(x[:, k], np.linspace(0, 1, most + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def train(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, bins: int = 24, ridge: float = 2.0) -> Trees:
    """Newton steps on the log loss; every fourth row is kept for the calibration of slope and shift (Platt)."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    held = np.arange(len(y)) % 4 == 3
    xs, ys = x[~held], y[~held]
    edges = _bins(xs, bins)
    coded = np.stack([np.searchsorted(e, xs[:, k], "left") for k, e in enumerate(edges)], 1)  # x > edge counts the edges below
    width = bins + 1
    flat = coded + np.arange(x.shape[1]) * width
    share = min(max(ys.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    f, feature, cut, leaf = np.full(len(ys), start), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = ys - p, np.maximum(p * (1 - p), 1e-6)
        tf, tc, at = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(len(ys), np.int64)
        for node in range(2**depth - 1):
            rows = np.flatnonzero(at == node)
            if len(rows):
                cells = flat[rows].ravel()
                size = width * x.shape[1]
                gs = np.bincount(cells, np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                hs = np.bincount(cells, np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < 1e-3) | (ht - hs < 1e-3)] = 0
                for k, e in enumerate(edges):
                    gain[k, len(e) :] = 0
                if gain.max() > 1e-9:
                    k, b = np.unravel_index(int(gain.argmax()), gain.shape)
                    tf[node], tc[node] = k, edges[k][b]
            on = at == node
            at[on] = 2 * node + 1 + (xs[on, tf[node]] > tc[node])
        place = at - (2**depth - 1)
        value = rate * np.bincount(place, g, 2**depth) / (np.bincount(place, h, 2**depth) + ridge)
        f += value[place]
        feature.append(tf)
        cut.append(tc)
        leaf.append(value)
    trees = Trees(depth, np.array(feature), np.array(cut), np.array(leaf), start)
    return Trees(depth, trees.feature, trees.cut, trees.leaf, start, *_platt(trees.margin(x[held]), y[held]))


def _platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton's method, with smoothed targets; 1 and 0 where there is only one label."""
    if len(y) < 8 or y.min() == y.max():
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.array([1.0, 0.0])
    m = np.stack([z, np.ones_like(z)], 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(m @ a, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        move = np.linalg.solve(m.T @ (m * w[:, None]) + 1e-3 * np.eye(2), m.T @ (target - p))
        a = a + np.clip(move, -1, 1)
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)
