"""Logistic regression by Newton's method, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Logistic:
    """Weights on standardised features, with an unpenalised constant."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 25, weight: np.ndarray | None = None):
        x = np.asarray(x, np.float64)
        y = np.asarray(y, np.float64)
        self.mean, spread = x.mean(axis=0), x.std(axis=0)
        self.scale = np.where(spread > 1e-12, spread, np.inf)
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])
        weight = np.ones(len(x)) if weight is None else weight
        w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], l2)
        penalty[-1] = 1e-6
        loss = lambda w: float((weight * (np.logaddexp(0, z @ w) - y * (z @ w))).sum() + 0.5 * (penalty * w * w).sum())
        now = loss(w)
        for _ in range(rounds):
            p = sigmoid(z @ w)
            gradient = z.T @ (weight * (p - y)) + penalty * w
            curve = (z * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(curve, gradient)
            size = 1.0
            while (new := loss(w - size * step)) > now and size > 1e-4:
                size /= 2
            if now - new < 1e-8 * max(1.0, now):
                break
            w, now = w - size * step, new
        self.w = w

    def margin(self, x: np.ndarray) -> np.ndarray:
        return ((np.asarray(x, np.float64) - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))
