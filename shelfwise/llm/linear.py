"""Logistic regression on small dense samples, for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


class Logistic:
    """Weights on standardised features, found by Newton steps on the penalised likelihood."""

    def __init__(self, penalty: float = 1.0, steps: int = 15):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        x, y = x.astype(np.float64), y.astype(np.float64)
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        ridge = np.full(z.shape[1], self.penalty)
        ridge[-1] = 1e-6
        w = np.zeros(z.shape[1])
        for _ in range(self.steps):
            p = sigmoid(z @ w)
            slope = z.T @ (weight * (p - y)) + ridge * w
            curve = (z * (weight * p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-8)
            step = np.linalg.solve(curve, slope)
            w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
            if np.abs(step).max() < 1e-5:
                break
        self.weights, self.bias = w[:-1] / self.scale, w[-1] - (w[:-1] / self.scale) @ self.mean
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return x.astype(np.float64) @ self.weights + self.bias
