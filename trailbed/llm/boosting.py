"""Gradient-boosted trees on a bounded sample of labelled rows: fitted in one task per model, applied as arrays in any.

Logistic loss, depth-wise trees over binned features, Newton leaf values. A fit sees a sample whose size is a parameter of
its caller, so it is a few seconds of one task however large the data the trees are then applied to.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class Trees(NamedTuple):
    """One row per tree, a node's children at 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    shift: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log odds of each row."""
        total, row = np.full(len(x), self.shift), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                at = f[node]
                inner = at >= 0
                if not inner.any():
                    break
                right = x[row, np.maximum(at, 0)] > c[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += v[node]
        return total


def _bins(x: np.ndarray, most: int) -> list[np.ndarray]:
    """For each column the cuts between its bins: midpoints of neighbouring values or, where there are many, of quantiles."""
    cuts = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > most:
            values = np.unique(np.quantile(column, np.linspace(0, 1, most)))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


def fit(x: np.ndarray, y: np.ndarray, trees: int, depth: int, rate: float = 0.15, most_bins: int = 48, ridge: float = 2.0, rows: float = 0.5, columns: float = 0.35, seed: int = 1) -> Trees:
    """Boosted trees for labels 0 and 1; each tree draws a share of the rows and columns."""
    rng = np.random.default_rng(seed)
    cuts = _bins(x, most_bins)
    used = np.array([k for k, c in enumerate(cuts) if len(c)], dtype=np.int64)
    size = 2 ** (depth + 1) - 1
    feature, cut, leaf = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    share = (y.sum() + 0.5) / (len(y) + 1)
    shift = float(np.log(share / (1 - share)))
    if not len(used) or y.min() == y.max():
        return Trees(feature, cut, leaf, shift)
    binned = np.stack([np.searchsorted(cuts[k], x[:, k]) for k in used], axis=1).astype(np.int64)
    width = int(max(len(cuts[k]) for k in used)) + 1
    margin = np.full(len(y), shift)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        drawn = np.flatnonzero(rng.random(len(y)) < rows)
        some = np.sort(rng.choice(len(used), max(1, int(len(used) * columns)), replace=False))
        g, h = (p - y)[drawn], (p * (1 - p))[drawn]
        b, node = binned[np.ix_(drawn, some)], np.zeros(len(drawn), dtype=np.int64)
        offset = np.arange(len(some)) * width
        for level in range(depth + 1):
            first, n = 2**level - 1, 2**level
            here = node - first
            gs, hs = np.bincount(here, g, n), np.bincount(here, h, n)
            leaf[t, first : first + n] = -rate * gs / (hs + ridge)
            if level == depth:
                break
            live = here >= 0
            key = ((here[:, None] * len(some) + np.arange(len(some))) * width + b).ravel()
            shape = (n, len(some), width)
            left_g = np.bincount(key, np.repeat(g, len(some)), n * len(some) * width).reshape(shape).cumsum(axis=2)
            left_h = np.bincount(key, np.repeat(h, len(some)), n * len(some) * width).reshape(shape).cumsum(axis=2)
            right_g, right_h = gs[:, None, None] - left_g, hs[:, None, None] - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (gs**2 / (hs + ridge))[:, None, None]
            gain[(left_h < 1e-3) | (right_h < 1e-3)] = -1
            flat = gain.reshape(n, -1)
            best = flat.argmax(axis=1)
            split = flat[np.arange(n), best] > 1e-6
            if not split.any():
                break
            which, where = best // width, best % width
            for i in np.flatnonzero(split):
                k = used[some[which[i]]]
                feature[t, first + i], cut[t, first + i] = k, cuts[k][where[i]] if where[i] < len(cuts[k]) else np.inf
            moves = split[here] & live
            right = b[np.arange(len(b)), which[here]] > where[here]
            node = np.where(moves, 2 * node + 1 + right, node)
            # Rows that stay in a leaf leave the histograms of later levels.
            g, h, b, node = g[moves], h[moves], b[moves], node[moves]
        one = Trees(feature[t : t + 1], cut[t : t + 1], leaf[t : t + 1], 0.0)
        margin += one.margin(x)
    return Trees(feature, cut, leaf, shift)


def platt(m: np.ndarray, y: np.ndarray, hold: float = 4.0) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y on m, by bounded Newton steps; ``hold`` keeps the slope near 1, also where the labels are separable."""
    a, b = 1.0, 0.0
    if len(m) < 10 or y.min() == y.max():
        return a, b
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - y) * m).sum() + hold * (a - 1), (p - y).sum() + 0.1 * b])
        w = p * (1 - p)
        h = np.array([[(w * m * m).sum() + hold, (w * m).sum()], [(w * m).sum(), w.sum() + 0.1]])
        step = np.clip(np.linalg.solve(h, g), -0.5, 0.5)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(a), float(b)


def best_cut(p: np.ndarray, y: np.ndarray, beta: float = 2.0) -> float:
    """The threshold of highest F-beta, in the middle of the gap below it, but at most 1 / (1 + beta^2).

    beta is 2: a missed item weighs four times a needless mask, and at that price a calibrated chance of a fifth is enough.
    """
    if not y.sum():
        return 1 / (1 + beta**2)
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f = (1 + beta**2) * hit / (np.arange(1, len(p) + 1) + beta**2 * y.sum())
    k = int(f.argmax())
    low = p[order[k + 1]] if k + 1 < len(p) else 0.0
    return float(np.clip((p[order[k]] + low) / 2, 0.1, 1 / (1 + beta**2)))
