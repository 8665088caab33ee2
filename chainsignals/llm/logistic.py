"""Logistic regression on a bounded sample, by Newton steps, halved until they descend, in numpy."""

from __future__ import annotations

import numpy as np


class Logistic:
    """Standardised features, a ridge penalty, and clipped logits."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40):
        self.mean, self.scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (0.0, 1.0)
        z = np.column_stack([np.ones(len(x)), np.clip((x - self.mean) / self.scale, -6, 6)])
        rate = (y.sum() + 1) / (len(y) + 2)
        self.w = np.zeros(z.shape[1])
        self.w[0] = self.base = float(np.log(rate / (1 - rate)))
        if len(set(y.tolist())) < 2:
            return
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        loss = lambda w: float(np.logaddexp(0, m := z @ w).sum() - y @ m + penalty @ (w * w) / 2)
        now = loss(self.w)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            gradient = z.T @ (p - y) + penalty * self.w
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            step = np.linalg.solve(hessian, gradient)
            # where labels are separated, a whole step can overshoot until all logits are clipped to one side
            while (after := loss(self.w - step)) > now and np.abs(step).max() >= 1e-6:
                step /= 2
            if after > now:
                break
            self.w, now = self.w - step, after
            if np.abs(step).max() < 1e-6:
                break

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.w[0] + np.clip((x - self.mean) / self.scale, -6, 6) @ self.w[1:], -20, 20)
