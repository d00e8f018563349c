"""Gradient-boosted regression trees for a yes or no, on histograms, for bounded samples."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Complete binary trees: feature, border and value of each inner node and leaf, in level order."""

    def __init__(self, base: float, depth: int):
        self.base, self.depth = base, depth
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def logits(self, x: np.ndarray) -> np.ndarray:
        result = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, border, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > border[at])
            result += value[at - len(feature)]
        return result


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, count: int = 40, depth: int = 4, rate: float = 0.3,
        ridge: float = 2.0) -> Trees:
    """Newton boosting of the logistic loss; every split is the best border of any feature."""
    borders = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(b, c, side="left") for b, c in zip(borders, x.T)], axis=1)
    share = float((y * weight).sum() / weight.sum())
    model = Trees(float(np.log(share / (1 - share))), depth)
    logit = np.full(len(x), model.base)
    inner = 2 ** depth - 1
    for _ in range(count):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = weight * (y - p), weight * p * (1 - p)
        feature, border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            own = at - first
            best = np.full(width, 1e-6)
            for f in range(x.shape[1]):
                key = own * BINS + bins[:, f]
                g = np.bincount(key, slope, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(key, curve, width * BINS).reshape(width, BINS).cumsum(axis=1)
                total_g, total_h = g[:, -1:], h[:, -1:]
                gain = (g ** 2 / (h + ridge) + (total_g - g) ** 2 / (total_h - h + ridge) - total_g ** 2 / (total_h + ridge))[:, :len(borders[f])]
                if not gain.shape[1]:
                    continue
                k = gain.argmax(axis=1)
                value = gain[np.arange(width), k]
                better = value > best
                best = np.where(better, value, best)
                feature[first:first + width][better] = f
                border[first:first + width][better] = borders[f][k[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > border[at])
        leaf = at - inner
        g, h = np.bincount(leaf, slope, inner + 1), np.bincount(leaf, curve, inner + 1)
        value = rate * g / (h + ridge)
        model.trees.append((feature, border, value))
        logit += value[leaf]
    return model
