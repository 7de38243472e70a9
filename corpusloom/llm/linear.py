"""Logistic regression over sparse rows in one process, for samples of bounded size."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (column, value) lists, as flat arrays."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray] | None = None):
        sizes = np.array([len(c) for c in columns], np.int64)
        self.n, self.row = len(columns), np.repeat(np.arange(len(columns)), sizes)
        self.col = np.concatenate(columns).astype(np.int64) if columns else np.zeros(0, np.int64)
        self.val = np.concatenate(values).astype(np.float32) if values else np.ones(len(self.col), np.float32)

    def take(self, keep: np.ndarray) -> "Sparse":
        """The rows where keep is true."""
        out = Sparse([])
        at = keep[self.row]
        out.n, out.row = int(keep.sum()), (np.cumsum(keep) - 1)[self.row[at]]
        out.col, out.val = self.col[at], self.val[at]
        return out

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.val * w[self.col], minlength=self.n)

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.col, weights=self.val * g[self.row], minlength=width)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(x: Sparse, dense: np.ndarray, y: np.ndarray, width: int, l2: float = 1e-3, steps: int = 120, rate: float = 0.15) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse columns and the dense ones, and the bias, by full-batch Adam. y: 0 or 1. Deterministic."""
    d = dense.shape[1]
    w = np.zeros(width + d + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    n = max(1, x.n)
    for t in range(1, steps + 1):
        z = x.dot(w[:width]) + dense @ w[width : width + d] + w[-1]
        g = (sigmoid(z) - y) / n
        grad = np.concatenate([x.back(g, width), dense.T @ g, [g.sum()]]) + l2 * np.append(w[:-1], 0) / 10
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:width], w[width : width + d], float(w[-1])
