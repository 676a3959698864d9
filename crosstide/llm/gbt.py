"""Gradient-boosted trees for two classes: small, deterministic, in arrays."""

from __future__ import annotations

import numpy as np

BINS = 32


class Trees:
    """Perfect trees of equal depth: feature and threshold by inner node, values by leaf."""

    def __init__(self, depth: int, start: float):
        self.depth, self.start = depth, start
        self.features: list[np.ndarray] = []
        self.thresholds: list[np.ndarray] = []
        self.values: list[np.ndarray] = []

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of class 1 by row."""
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in zip(self.features, self.thresholds, self.values):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.25, ridge: float = 2.0) -> Trees:
    """Newton boosting of logistic loss over histograms."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])
    mean = np.average(y, weights=weight)
    model = Trees(depth, float(np.log(mean / (1 - mean))))
    score = np.full(len(y), model.start)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = weight * (y - p), weight * p * (1 - p)
        feature, threshold, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            cut = np.full(width, BINS)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = (node - first) * BINS + binned[:, j]
                g = np.bincount(cell, gradient, width * BINS).reshape(width, BINS).cumsum(axis=1)
                h = np.bincount(cell, hessian, width * BINS).reshape(width, BINS).cumsum(axis=1)
                all_g, all_h = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
                gain = np.where((h > 1) & (all_h - h > 1), gain, 0)[:, : len(e)]
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
                cut = np.where(better, at, cut)
                threshold[first : first + width] = np.where(better, e[at], threshold[first : first + width])
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, inner + 1), np.bincount(leaf, hessian, inner + 1)
        value = rate * g / (h + ridge)
        score += value[leaf]
        model.features.append(feature)
        model.thresholds.append(threshold)
        model.values.append(value)
    return model
