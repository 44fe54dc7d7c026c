"""Linear models fitted with numpy."""

from __future__ import annotations

import numpy as np


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, dim: int, c: float = 10.0, epochs: int = 20) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss over sparse rows (places, values); the bias is a constant feature."""
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(rows))
    size = np.array([float(v @ v) + 1 for _, v in rows])
    order = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, v = rows[i]
            slope = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - slope / size[i], 0.0), c)
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
                moved += abs(step)
        if moved < 1e-3 * len(rows):
            break
    return w.astype(np.float32), bias


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Newton's method for logistic regression; the last column of x is the constant, which is not penalised."""
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
