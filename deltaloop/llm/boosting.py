"""Gradient-boosted trees with monotonic constraints, in numpy.

Trees are grown level by level on quantile bins and kept as flat node arrays (feature, threshold,
left, right, value) of all trees together, so that scoring moves all rows of a batch one level down
at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # -1 in leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                f = self.feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                goes = x[rows, np.maximum(f, 0)] <= self.threshold[node]
                node = np.where(inner, np.where(goes, self.left[node], self.right[node]), node)
            out += self.value[node]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 5.0, least: int = 10) -> Forest:
    """monotone: for each feature 1 (score must not fall as it grows), -1 (must not rise) or 0."""
    n, m = x.shape
    prior = np.clip(y.mean() if n else 0.5, 0.01, 0.99)
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
    codes = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(m)], axis=1) if n else np.zeros((0, m), int)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    value: list[float] = []
    roots: list[int] = []

    def node(v: float) -> int:
        feature.append(-1)
        threshold.append(0.0)
        left.append(-1)
        right.append(-1)
        value.append(v)
        return len(value) - 1

    raw = np.full(n, base)
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        root = node(0.0)
        roots.append(root)
        level = [(root, np.arange(n), -np.inf, np.inf)]
        for step in range(depth + 1):
            below = []
            for at, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = float(np.clip(gs / (hs + ridge), low, high)) * rate
                if step == depth or len(rows) < 2 * least:
                    continue
                best = None
                for j in range(m):
                    size = len(edges[j]) + 1
                    if size < 2:
                        continue
                    c = codes[rows, j]
                    gl = np.bincount(c, g[rows], size).cumsum()[:-1]
                    hl = np.bincount(c, h[rows], size).cumsum()[:-1]
                    nl = np.bincount(c, minlength=size).cumsum()[:-1]
                    vl, vr = gl / (hl + ridge), (gs - gl) / (hs - hl + ridge)
                    gain = gl * vl + (gs - gl) * vr - gs * gs / (hs + ridge)
                    bad = (nl < least) | (len(rows) - nl < least)
                    if monotone[j] > 0:
                        bad |= vl > vr
                    elif monotone[j] < 0:
                        bad |= vl < vr
                    gain = np.where(bad, -np.inf, gain)
                    k = int(gain.argmax())
                    if gain[k] > 1e-3 and (best is None or gain[k] > best[0]):
                        best = (gain[k], j, k, float(np.clip(vl[k], low, high)), float(np.clip(vr[k], low, high)))
                if best is None:
                    continue
                _, j, k, vl, vr = best
                middle = (vl + vr) / 2
                sides = [(low, high), (low, high)]
                if monotone[j] > 0:
                    sides = [(low, middle), (middle, high)]
                elif monotone[j] < 0:
                    sides = [(middle, high), (low, middle)]
                goes = codes[rows, j] <= k
                feature[at], threshold[at] = j, float(edges[j][k])
                left[at], right[at] = node(0.0), node(0.0)
                below += [(left[at], rows[goes], *sides[0]), (right[at], rows[~goes], *sides[1])]
            level = below
        forest = Forest(*map(np.array, (feature, threshold, left, right, value)), np.array([root]), 0.0, depth + 1)
        raw += forest.raw(x)
    return Forest(np.array(feature, int), np.array(threshold, float), np.array(left, int), np.array(right, int), np.array(value, float), np.array(roots, int), base, depth + 1)
