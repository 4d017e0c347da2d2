"""Logistic models on sparse rows, fitted on the driver from a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class SparseRows:
    """Rows of (column, value) pairs."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.rows = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        self.columns = np.concatenate([*columns, np.zeros(0, dtype=np.int64)]).astype(np.int64)
        self.values = np.concatenate([*values, np.zeros(0)]).astype(np.float64)
        self.height, self.width = len(columns), width

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], minlength=self.height)

    def transposed_times(self, residual: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * residual[self.rows], minlength=self.width)

    def pick(self, keep: np.ndarray) -> SparseRows:
        out = SparseRows([], [], self.width)
        inside = keep[self.rows]
        new_row = np.cumsum(keep) - 1
        out.rows, out.columns, out.values = new_row[self.rows[inside]], self.columns[inside], self.values[inside]
        out.height = int(keep.sum())
        return out


def fit_logistic(x: SparseRows, extra: np.ndarray, y: np.ndarray, l2: float = 1e-4, steps: int = 100,
                 rate: float = 0.5) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the sparse columns, of the dense ``extra`` columns, and the bias, by Adam over all rows.

    Deterministic: no sampling, zero start. Both classes weigh the same in total.
    """
    n, k = x.height, extra.shape[1]
    params, m, v = (np.zeros(x.width + k + 1) for _ in range(3))
    positive = max(1.0, float(y.sum()))
    weight = np.where(y > 0, 0.5 / positive, 0.5 / max(1.0, n - float(y.sum())))
    for step in range(1, steps + 1):
        z = x.times(params[:x.width]) + extra @ params[x.width:x.width + k] + params[-1]
        residual = (sigmoid(z) - y) * weight
        grad = np.concatenate([x.transposed_times(residual), extra.T @ residual, [residual.sum()]])
        grad[:-1] += l2 * params[:-1]
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        params -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return params[:x.width], params[x.width:x.width + k], float(params[-1])
