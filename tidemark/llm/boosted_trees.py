"""Histogram gradient-boosted trees for 0/1 labels, as flat numpy arrays.

Features are binned by quantiles; each level of a tree takes one histogram of gradients over
(node, feature, bin). Trees are complete: node i has children 2i+1 and 2i+2, and a node without
a useful split sends every row left. All rows walk all trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # trees x inner nodes; larger values go right
    leaf: np.ndarray  # trees x leaves
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of ``x``."""
        total = np.full(len(x), self.start)
        if len(self.feature) and len(x):
            inner = self.feature.shape[1]
            tree = np.arange(len(self.feature))[None, :]
            row = np.arange(len(x))[:, None]
            node = np.zeros((len(x), len(self.feature)), np.int64)
            while node[0, 0] < inner:
                node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
            total = total + self.leaf[tree, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
    l2: float = 1.0, least_rows: int = 10,
) -> Forest:
    """Fit to rows ``x`` and labels ``y``; without both labels the score is a constant."""
    inner = 2**depth - 1
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        empty = np.zeros((0, inner))
        value = min(max(share, 1e-3), 1 - 1e-3)
        return Forest(empty.astype(np.int64), empty, np.zeros((0, inner + 1)), float(np.log(value / (1 - value))))
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1)
    slots = bins + 1
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    leaf = np.zeros((trees, inner + 1))
    offsets = np.arange(width)[None, :] * slots
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            where = ((node - first)[:, None] * (width * slots) + offsets + binned).ravel()
            size = count * width * slots
            sums = [
                np.bincount(where, np.repeat(v, width), size).reshape(count, width, slots)
                for v in (g, h, np.ones(n))
            ]
            left = [s.cumsum(axis=2) for s in sums]
            right = [c[:, :, -1:] - c for c in left]
            gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2)
            gain -= (left[0] + right[0]) ** 2 / (left[1] + right[1] + l2)
            gain[(left[2] < least_rows) | (right[2] < least_rows)] = 0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, b = divmod(int(best[k]), slots)
                if gain[k, f, b] > 1e-6 and b < len(cuts[f]):
                    feature[t, first + k], threshold[t, first + k] = f, cuts[f][b]
            right_way = x[np.arange(n), feature[t, node]] > threshold[t, node]
            node = 2 * node + 1 + right_way
        last = node - inner
        leaf[t] = rate * np.bincount(last, g, inner + 1) / (np.bincount(last, h, inner + 1) + l2)
        margin += leaf[t, last]
    return Forest(feature, threshold, leaf, start)
