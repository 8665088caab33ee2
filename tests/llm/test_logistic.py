"""The fit of the classifiers, on labels that the features part and on labels that they do not."""

import numpy as np
import pytest

from chainsignals.llm.logistic import Logistic


def rows(seed: int, n: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Features as those of op8: toxic documents have one or two telling words, the others none."""
    r, k = np.random.default_rng(seed), int(n * share)
    y, x = np.zeros(n), np.zeros((n, 4))
    y[:k] = 1
    x[:k, 0] = r.uniform(5, 9, k)
    x[:k, 1] = r.choice([4.0, 0.0], k)
    x[:k, 2] = np.log1p(r.integers(1, 4, k))
    x[:, 3] = np.log1p(r.integers(5, 600, n))
    return x, y


@pytest.mark.parametrize("n", [200, 4000, 16000])
@pytest.mark.parametrize("share", [0.02, 0.05, 0.1])
def test_separated_labels_are_parted(n, share):
    for seed in range(4):
        x, y = rows(seed, n, share)
        model = Logistic(x, y)
        assert np.array_equal(model.logit(x) >= 0, y == 1)
        assert np.abs(model.w).max() < 100


def test_mixed_labels_end_at_the_optimum():
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 4))
    y = (r.random(2000) < 1 / (1 + np.exp(-x @ np.array([1.0, -2.0, 0.5, 0.0])))).astype(float)
    model = Logistic(x, y)
    z = np.column_stack([np.ones(len(x)), np.clip((x - model.mean) / model.scale, -6, 6)])
    gradient = z.T @ (1 / (1 + np.exp(-z @ model.w)) - y) + np.array([1e-6, 1, 1, 1, 1]) * model.w
    assert np.abs(gradient).max() < 1e-3
