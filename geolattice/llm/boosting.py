"""Gradient-boosted trees for a yes or no target, over binned features."""
from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees as flat arrays: node i of a tree of depth d goes on to 2i+1 (feature at or under the cut) or 2i+2."""
    depth: int
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += value[at - len(feature)]
        return total


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0) -> Boosted:
    """Each round fits a tree to the gradient of the logistic loss with Newton leaf values; splits go by the gain in second order. Without rows all log-odds are 0."""
    if not len(x):
        return Boosted(depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Boosted(depth, float(np.log(share / (1 - share))))
    score = np.full(len(x), model.base)
    inner = 2 ** depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        grad, curve = p - y, p * (1 - p)
        feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = at - first
            g_all, h_all = np.bincount(local, grad, width), np.bincount(local, curve, width)
            best = np.full(width, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                slot = local * (len(c) + 1) + binned[:, j]
                g = np.cumsum(np.bincount(slot, grad, width * (len(c) + 1)).reshape(width, -1), 1)[:, :-1]
                h = np.cumsum(np.bincount(slot, curve, width * (len(c) + 1)).reshape(width, -1), 1)[:, :-1]
                gain = g ** 2 / (h + 1) + (g_all[:, None] - g) ** 2 / (h_all[:, None] - h + 1) - (g_all ** 2 / (h_all + 1))[:, None]
                gain[(h < least / 4) | (h_all[:, None] - h < least / 4)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(width), top] > best
                best[better] = gain[np.arange(width), top][better]
                feature[first:first + width][better] = j
                cut[first:first + width][better] = c[top[better]]
            at = 2 * at + 1 + (x[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, curve, inner + 1) + 1)
        model.trees.append((feature, cut, value))
        score += value[leaf]
    return model
