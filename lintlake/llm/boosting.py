"""Boosted shallow trees on binned features, in numpy."""

from __future__ import annotations

import numpy as np

# Added to curvatures, so that bins with few rows get small values.
RIDGE = 1.0


def cut_points(values: np.ndarray, bins: int) -> np.ndarray:
    """Inner quantiles of one feature, at most ``bins - 1``, strictly growing."""
    known = values[np.isfinite(values)]
    return np.unique(np.quantile(known, np.linspace(0, 1, bins + 1)[1:-1])) if len(known) else np.zeros(0)


def binned(features: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, one column for each feature."""
    return np.stack([np.searchsorted(c, features[:, i], side="right") for i, c in enumerate(cuts)], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + RIDGE)


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best (gain, number of bins on the left) of ordered bins."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    best = int(np.argmax(gains))
    return float(gains[best]), best + 1


def line_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a tree on one feature."""
    gain, at = _split(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([line_tree(g[:at], h[:at], depth - 1), line_tree(g[at:], h[at:], depth - 1)])


def grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """(gain, values per cell) of a tree on two features: one split of the first, then one of the second on each side."""
    best = (0.0, np.full(g.shape, g.sum() / (h.sum() + RIDGE)))
    for at in range(1, g.shape[0]):
        sides, gain = [], 0.0
        for part in (slice(0, at), slice(at, None)):
            gain_here, cut = _split(g[part].sum(0), h[part].sum(0))
            gain += gain_here
            row = np.zeros(g.shape[1])
            for cells in ((slice(0, cut), slice(cut, None)) if cut else (slice(None),)):
                row[cells] = g[part][:, cells].sum() / (h[part][:, cells].sum() + RIDGE)
            sides.append(np.tile(row, (g[part].shape[0], 1)))
        gain += _gain(g[:at].sum(), h[:at].sum()) + _gain(g[at:].sum(), h[at:].sum()) - _gain(g.sum(), h.sum())
        if gain > best[0]:
            best = (float(gain), np.concatenate(sides))
    return best


class Trees:
    """Gradient boosting with trees of up to four leaves over all features."""

    def __init__(self, bins: int = 32, rounds: int = 60, rate: float = 0.2):
        self.bins, self.rounds, self.rate = bins, rounds, rate

    def fit(self, features: np.ndarray, labels: np.ndarray) -> Trees:
        self.cuts = [cut_points(features[:, i], self.bins) for i in range(features.shape[1])]
        b = binned(features, self.cuts)
        mean = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(labels), self.start)
        self.trees = []
        for _ in range(self.rounds):
            p = sigmoid(score)
            tree = self._grow(b, labels - p, p * (1 - p), np.arange(len(labels)), 2)
            self.trees.append(tree)
            score += self.rate * self._value(tree, b)
        return self

    def _grow(self, b, g, h, rows, depth):
        best = (1e-6, None, None)
        if depth and len(rows) > 1:
            for f in range(b.shape[1]):
                size = len(self.cuts[f]) + 1
                sums = [np.bincount(b[rows, f], weights=x[rows], minlength=size) for x in (g, h)]
                gain, at = _split(*sums)
                best = max(best, (gain, f, at), key=lambda x: x[0])
        if best[1] is None:
            return float(g[rows].sum() / (h[rows].sum() + RIDGE))
        left = b[rows, best[1]] < best[2]
        return best[1], best[2], self._grow(b, g, h, rows[left], depth - 1), self._grow(b, g, h, rows[~left], depth - 1)

    def _value(self, tree, b):
        if isinstance(tree, float):
            return np.full(len(b), tree)
        return np.where(b[:, tree[0]] < tree[1], self._value(tree[2], b), self._value(tree[3], b))

    def margin(self, features: np.ndarray) -> np.ndarray:
        b = binned(features, self.cuts)
        return self.start + self.rate * sum(self._value(t, b) for t in self.trees)
