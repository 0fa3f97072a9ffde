"""Follow-the-regularised-leader (proximal) for sparse rows, in mini-batches on the driver."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows in compressed form; a bounded training sample."""

    def __init__(self, ids: list[np.ndarray], values: list[np.ndarray]):
        self.lengths = np.array([len(i) for i in ids], dtype=np.int64)
        self.starts = np.r_[0, np.cumsum(self.lengths)]
        self.ids = np.concatenate(ids).astype(np.int32) if len(ids) else np.empty(0, np.int32)
        self.values = np.concatenate(values).astype(np.float32) if len(values) else np.empty(0, np.float32)

    def __len__(self) -> int:
        return len(self.lengths)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row within the batch, feature, value) of every entry of the given rows."""
        at = np.concatenate([np.arange(self.starts[r], self.starts[r + 1]) for r in rows]) if len(rows) else np.empty(0, np.int64)
        return np.repeat(np.arange(len(rows)), self.lengths[rows]), self.ids[at], self.values[at]


class Ftrl:
    """Weights (features x outputs) with per-coordinate rates and an elastic-net penalty."""

    def __init__(self, features: int, outputs: int, *, alpha: float, beta: float = 1.0, l1: float, l2: float):
        self.z = np.zeros((features, outputs))
        self.n = np.zeros((features, outputs))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, ids: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[ids], self.n[ids]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0.0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def step(self, ids: np.ndarray, gradient: np.ndarray) -> None:
        """``ids`` distinct; ``gradient`` one row for each."""
        squared = gradient * gradient
        sigma = (np.sqrt(self.n[ids] + squared) - np.sqrt(self.n[ids])) / self.alpha
        self.z[ids] += gradient - sigma * self.weights(ids)
        self.n[ids] += squared


def scores(rows: np.ndarray, values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """Per row and output: sum of value times weight; ``weights`` has one row for each entry."""
    return np.stack([np.bincount(rows, weights=values * weights[:, k], minlength=n) for k in range(weights.shape[1])], axis=1)


def batch_step(model: Ftrl, data: Rows, batch: np.ndarray, slope) -> None:
    """One mini-batch: ``slope(scores)`` is the loss gradient for each row and output."""
    rows, ids, values = data.take(batch)
    if not len(ids):
        return
    distinct, inverse = np.unique(ids, return_inverse=True)
    weights = model.weights(distinct)
    g = slope(scores(rows, values, weights[inverse], len(batch)))
    each = values[:, None] * g[rows]
    gradient = np.stack([np.bincount(inverse, weights=each[:, k], minlength=len(distinct)) for k in range(each.shape[1])], axis=1)
    model.step(distinct, gradient / max(1, len(batch)) ** 0.5)
