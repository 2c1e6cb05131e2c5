"""Logistic regression over sparse 0/1 rows, small enough for the driver: rows and features are bounded by parameters."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Rows:
    """Active feature numbers of each row, end to end."""

    def __init__(self, active: list):
        self.count = np.fromiter(map(len, active), np.int64, len(active))
        self.index = np.concatenate([np.asarray(a, np.int64) for a in active]) if active else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(active)), self.count)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.index], minlength=len(self.count))

    def back(self, r: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(self.index, weights=r[self.row], minlength=n)


def fit(rows: Rows, y: np.ndarray, n: int, ridge: float = 1e-3, weight: np.ndarray | None = None, swapped: tuple[Rows, Rows] | None = None,
        penalty: float = 0.0, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam. ``swapped`` holds pairs of texts that differ in group terms alone;
    ``penalty`` times the mean squared difference of their scores is added to the loss."""
    w, b = np.zeros(n + 1), 0.0
    v = np.ones(len(y)) if weight is None else weight
    total = max(v.sum(), 1e-9)
    pairs = len(swapped[0].count) if swapped else 0
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        r = v * (sigmoid(rows.times(w[:n]) + w[n]) - y) / total
        g = np.append(rows.back(r, n) + ridge * w[:n], r.sum())
        if pairs:
            d = 2 * penalty / pairs * (swapped[0].times(w[:n]) - swapped[1].times(w[:n]))
            g[:n] += swapped[0].back(d, n) - swapped[1].back(d, n)
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-9)
    return w[:n], float(w[n])
