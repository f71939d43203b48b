"""A small gradient-boosted classifier over binned features (numpy).

It is fitted on a bounded sample and its trees are applied inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    cuts: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float
    depth: int

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(self.cuts)], 1) if len(x) else np.zeros(x.shape, np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        b, total = self.binned(x), np.full(len(x), self.start)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            total += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Boosted:
    """Newton boosting of the logistic loss with trees of full ``depth``."""
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(cuts, [], float(np.log(base / (1 - base))), depth)
    b = model.binned(x)
    total = np.full(len(x), model.start)
    inner = 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins + 1, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-9)
            for f in range(x.shape[1]):
                slot = (node - first) * (bins + 1) + b[:, f]
                g = np.bincount(slot, grad, width * (bins + 1)).reshape(width, -1).cumsum(1)
                h = np.bincount(slot, hess, width * (bins + 1)).reshape(width, -1).cumsum(1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                feature[first + np.flatnonzero(better)] = f
                cut[first + np.flatnonzero(better)] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
        slot = node - inner
        g, h = np.bincount(slot, grad, inner + 1), np.bincount(slot, hess, inner + 1)
        leaf = -rate * g / (h + ridge)
        total += leaf[slot]
        model.trees.append((feature, cut, leaf))
    return model
