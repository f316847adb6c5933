"""Logistic regression of a bounded table, fitted on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(z, -60, 60)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, rounds: int = 30) -> np.ndarray:
    """Coefficients, the last the intercept (not shrunk); Newton's method. Without rows or with one class, the smoothed share alone."""
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    share = (float((weight * y).sum()) + 0.5) / (float(weight.sum()) + 1)
    beta = np.zeros(d + 1)
    beta[-1] = np.log(share / (1 - share))
    if n == 0 or y.min() == y.max():
        return beta
    full = np.hstack([x, np.ones((n, 1))])
    shrink = np.append(np.full(d, ridge), 1e-6)
    loss = lambda b: -(weight * (y * (z := np.clip(full @ b, -60, 60)) - np.logaddexp(0, z))).sum() + 0.5 * (shrink * b * b).sum()
    now = loss(beta)
    for _ in range(rounds):
        p = sigmoid(full @ beta)
        slope = full.T @ (weight * (p - y)) + shrink * beta
        bend = (full * (weight * p * (1 - p) + 1e-9)[:, None]).T @ full + np.diag(shrink)
        step = np.linalg.solve(bend, slope)
        size = 1.0
        while size > 1e-6 and loss(beta - size * step) > now:
            size /= 2
        after = loss(beta - size * step)
        beta = beta - size * step
        if now - after < 1e-9 * max(1.0, abs(now)):
            break
        now = after
    return beta


def predict(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    return sigmoid(x @ beta[:-1] + beta[-1])
