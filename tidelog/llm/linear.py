"""Sparse logistic regression in numpy, for models fitted on bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, target: np.ndarray, width: int, l2: float = 1e-3, steps: int = 200, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weights and bias for targets in [0, 1] over coordinates (row, column, value), by full-batch Adam."""
    w, n = np.zeros(width + 1), len(target)
    mean = float(np.clip(target.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    w[width] = np.log(mean / (1 - mean))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        margin = np.bincount(rows, weights=w[cols] * vals, minlength=n)[:n] + w[width]
        gap = (sigmoid(margin) - target) / n
        grad = np.append(np.bincount(cols, weights=gap[rows] * vals, minlength=width)[:width] + l2 * w[:width], gap.sum())
        m += 0.1 * (grad - m)
        v += 0.001 * (grad * grad - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return w[:width], float(w[width])
