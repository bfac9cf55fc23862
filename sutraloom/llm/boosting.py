"""Gradient-boosted trees for yes/no questions on small training sets, trained and evaluated with numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Logistic loss, trees of a fixed depth over binned features, Platt-calibrated on held-out rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature, cut and value by node
        self.base, self.slope, self.shift, self.threshold = 0.0, 1.0, 0.0, 0.5

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p) + 1e-6
            nodes = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), dtype=int)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                if not len(mine):
                    continue
                g, h = grad[mine], hess[mine]
                value[node] = g.sum() / (h.sum() + self.penalty)
                if node >= 2**self.depth - 1 or len(mine) < 8:
                    continue
                best = (1e-6, -1, 0)
                whole = g.sum() ** 2 / (h.sum() + self.penalty)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    b = binned[mine, f]
                    gs = np.cumsum(np.bincount(b, g, len(c) + 1))[:-1]
                    hs = np.cumsum(np.bincount(b, h, len(c) + 1))[:-1]
                    gain = gs**2 / (hs + self.penalty) + (g.sum() - gs) ** 2 / (h.sum() - hs + self.penalty) - whole
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] < 0:
                    continue
                feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                left = x[mine, best[1]] <= cut[node]
                at[mine] = np.where(left, 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, cut, value))
            score += self.rate * self._leaf(self.trees[-1], x)
        return self

    def _leaf(self, tree: tuple, x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at, rows = np.zeros(len(x), dtype=int), np.arange(len(x))
        for _ in range(self.depth):
            f = feature[at]
            go = f >= 0
            step = np.where(x[rows, np.maximum(f, 0)] <= cut[at], 2 * at + 1, 2 * at + 2)
            at = np.where(go, step, at)
        return value[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        for tree in self.trees:
            score += self.rate * self._leaf(tree, x)
        return score

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Platt's slope and shift on held-out rows, and the threshold with the best F1 there."""
        s = self.raw(x)
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-9
            ga, gb = ((y - p) * s).sum() - 0.1 * (a - 1), (y - p).sum()
            haa, hab, hbb = (w * s * s).sum() + 0.1, (w * s).sum(), w.sum() + 1e-3
            det = haa * hbb - hab * hab
            a, b = a + (hbb * ga - hab * gb) / det, b + (haa * gb - hab * ga) / det
        self.slope, self.shift = float(np.clip(a, 0.2, 5)), float(np.clip(b, -5, 5))
        p = self.probability(x)
        best = (-1.0, 0.5)
        for t in np.linspace(0.1, 0.9, 33):
            hit = ((p >= t) & (y == 1)).sum()
            f1 = 2 * hit / max(1, (p >= t).sum() + (y == 1).sum())
            if f1 > best[0] + 1e-9 or abs(f1 - best[0]) <= 1e-9 and abs(t - 0.5) < abs(best[1] - 0.5):
                best = (f1, float(t))
        self.threshold = best[1]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))
