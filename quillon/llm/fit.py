"""Small logistic models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Logistic:
    """Regularised logistic regression on standardised features, by Newton steps."""

    def __init__(self, penalty: float = 1.0, steps: int = 12):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Logistic:
        weight = np.ones(len(y)) if weight is None else weight
        self.mean, self.scale = x.mean(0), x.std(0)
        self.scale[self.scale < 1e-9] = 1.0
        z = np.hstack([self.standard(x), np.ones((len(x), 1))])
        self.w = np.zeros(z.shape[1])
        ridge = np.full(z.shape[1], self.penalty)
        ridge[-1] = 1e-6
        for _ in range(self.steps):
            p = logistic(z @ self.w)
            slope = z.T @ ((p - y) * weight) + ridge * self.w
            bend = (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.diag(ridge)
            step = np.linalg.solve(bend, slope)
            self.w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        return self

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.standard(x) @ self.w[:-1] + self.w[-1]

    def score(self, x: np.ndarray) -> np.ndarray:
        return logistic(self.logit(x))
