"""Histogram gradient-boosted trees for a binary label, in numpy.

Features are binned by quantiles of the training rows; every level of a tree is grown at once from one histogram.
Trees are complete binary trees of one depth, flattened into arrays (feature, threshold, leaf value), so scoring is
``depth`` vectorised steps for all rows and trees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray  # trees x (2**depth - 1)
    threshold: np.ndarray
    value: np.ndarray  # trees x 2**depth
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1, from 0 to 1."""
        trees, depth = len(self.feature), int(np.log2(self.value.shape[1]))
        rows, tree = np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[tree, node]] > self.threshold[tree, node])
        total = self.base + self.value[tree, node - (self.value.shape[1] - 1)].sum(1)
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.3, least: float = 1.0, ridge: float = 1.0) -> Trees:
    """Boost the logistic loss.  Without rows every score is 0.5; with one class the scores lean to it.

    least: smallest sum of second derivatives in a leaf.  The same rows in the same order give the same trees.
    """
    features = x.shape[1]
    nodes, leaves = (1 << depth) - 1, 1 << depth
    empty = Trees(np.zeros((0, nodes), np.int64), np.zeros((0, nodes)), np.zeros((0, leaves)), 0.0)
    if not len(x):
        return empty
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(features)]
    code = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], 1)
    width = max(map(len, cuts)) + 1
    share = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(nodes, np.int64), np.full(nodes, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            key = (((node - first)[:, None] * features + np.arange(features)) * width + code).ravel()
            shape = (count, features, width)
            gs = np.bincount(key, np.repeat(g, features), count * features * width).reshape(shape).cumsum(2)
            hs = np.bincount(key, np.repeat(h, features), count * features * width).reshape(shape).cumsum(2)
            ga, ha = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + ridge) + (ga - gs) ** 2 / (ha - hs + ridge) - ga**2 / (ha + ridge)
            gain[(hs < least) | (ha - hs < least)] = 0
            best = gain.reshape(count, -1).argmax(1)
            split = gain.reshape(count, -1)[np.arange(count), best] > 1e-9
            f, b = best // width, best % width
            for k in np.flatnonzero(split):
                feature[first + k], threshold[first + k] = f[k], cuts[f[k]][min(b[k], len(cuts[f[k]]) - 1)]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - nodes
        value = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        total += value[leaf]
        out.append((feature, threshold, value))
    return Trees(*(np.stack(c) for c in zip(*out)), base)
