"""Logistic regression on sparse features, fitted on a bounded sample."""

from __future__ import annotations

import numpy as np

#: Steps whose curvature is remembered.
MEMORY = 10


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Sparse:
    """Entries ``(row, column, value)`` of a matrix of ``n`` rows, and columns after them that
    hold a value for every row (``dense``)."""

    def __init__(self, row: np.ndarray, col: np.ndarray, value: np.ndarray, n: int, columns: int,
                 dense: np.ndarray | None = None):
        self.row, self.col, self.value, self.n, self.sparse = row, col, value, n, columns
        self.dense = np.zeros((n, 0)) if dense is None else dense
        self.columns = columns + self.dense.shape[1]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], minlength=self.n) + self.dense @ w[self.sparse:]

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(self.col, self.value * r[self.row], minlength=self.sparse),
                         self.dense.T @ r)


def fit(x: Sparse, y: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 150,
        tolerance: float = 1e-6) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least regularised log-loss; rows of weight 0 take no part.

    Steps go along the gradient, bent by the curvature met in the last ones. A round has
    one product for the step and one for the gradient; the length of a step is looked for on the
    rows' odds alone. Ends when the loss falls by less than ``tolerance`` of itself.
    """
    total = max(weight.sum(), 1e-9)
    n = x.columns
    w, z = np.zeros(n + 1), np.zeros(x.n)  # the intercept is the last weight
    ridge = np.append(np.full(n, l2), 0.0)

    def loss(w, z):
        return (weight * (np.logaddexp(0, z) - y * z)).sum() / total + (ridge * w) @ w / 2

    def slope(w, z):
        r = weight * (sigmoid(z) - y) / total
        return np.append(x.back(r), r.sum()) + ridge * w

    here, g = loss(w, z), slope(w, z)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        d, scales = g.copy(), []
        for s, t, by in reversed(past):
            scales.append(by * (s @ d))
            d -= scales[-1] * t
        if past:
            s, t, by = past[-1]
            d /= by * (t @ t)
        for (s, t, by), a in zip(past, reversed(scales)):
            d += (a - by * (t @ d)) * s
        fall = g @ d
        if fall < 1e-15:
            break
        dz, step = x.dot(d[:n]) + d[n], 1.0
        if not past:
            step = min(1.0, 1 / np.sqrt(g @ g))
        while (there := loss(w - step * d, z - step * dz)) > here - 1e-4 * step * fall and step > 1e-9:
            step /= 2
        new_w, z = w - step * d, z - step * dz
        new_g = slope(new_w, z)
        s, t = new_w - w, new_g - g
        if s @ t > 1e-15:
            past = [*past[1 - MEMORY:], (s, t, 1 / (s @ t))]
        done = here - there <= tolerance * abs(here)
        w, g, here = new_w, new_g, there
        if done:
            break
    return w[:n], float(w[n])
