"""Group lasso on a Gram pair: ``0.5 x'Gx - b'x + sum_g pen_g ||x_g||``.

Accelerated proximal gradient with adaptive restart on the whole block at once.
A solution is accepted by its optimality residual, not by the size of a step.
"""

from __future__ import annotations

import numpy as np


def shrink(v: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Rows of ``v`` (groups, K) moved towards zero by ``t`` in norm, exactly zero inside it."""
    norm = np.sqrt(np.einsum("gk,gk->g", v, v))
    keep = np.where(norm > t, 1.0 - t / np.where(norm > 0, norm, 1.0), 0.0)
    return v * keep[:, None]


def objective(gram: np.ndarray, b: np.ndarray, x: np.ndarray, pen: np.ndarray) -> float:
    """Value at ``x`` (groups, K)."""
    flat = x.ravel()
    return float(0.5 * flat @ gram @ flat - b.ravel() @ flat + pen @ np.linalg.norm(x, axis=1))


def optimality_gap(gram: np.ndarray, b: np.ndarray, x: np.ndarray, pen: np.ndarray) -> float:
    """Largest violation of the stationarity conditions over groups."""
    grad = (gram @ x.ravel() - b.ravel()).reshape(x.shape)
    norm = np.linalg.norm(x, axis=1)
    active = norm > 0
    gap = np.maximum(np.linalg.norm(grad, axis=1) - pen, 0.0)
    unit = x[active] / norm[active, None]
    gap[active] = np.linalg.norm(grad[active] + pen[active, None] * unit, axis=1)
    return float(gap.max(initial=0.0))


def largest_curvature(g: np.ndarray, rounds: int = 30) -> float:
    """Largest eigenvalue by power iteration, raised by its own residual so that it bounds from above."""
    v = np.abs(g).sum(axis=1)
    size = np.linalg.norm(v)
    if size == 0:
        return 0.0
    v = v / size
    for _ in range(rounds):
        w = g @ v
        top = float(v @ w)
        v = w / max(np.linalg.norm(w), 1e-300)
    w = g @ v
    top = float(v @ w)
    return top + float(np.linalg.norm(w - top * v)) + 0.01 * top


def solve(gram: np.ndarray, b: np.ndarray, x0: np.ndarray, pen: np.ndarray, max_steps: int = 2000, tol: float = 1e-9):
    """Minimiser from the warm start ``x0`` (groups, K); returns ``(x, steps, gap)``.

    ``tol`` is relative to the largest entry of ``b``. Coordinates are rescaled by
    the mean curvature of their group, which leaves group norms comparable and
    tightens the step size. When no penalty acts the linear system is solved.
    """
    groups, width = x0.shape
    scale_b = max(float(np.abs(b).max(initial=0.0)), 1e-300)
    if not np.any(pen > 0):
        x = np.linalg.lstsq(gram, b.ravel(), rcond=1e-14)[0].reshape(x0.shape)
        return x, 1, optimality_gap(gram, b, x, pen)
    curve = np.sqrt(np.maximum(np.diag(gram).reshape(groups, width).mean(axis=1), 0.0))
    curve = np.where(curve > 0, curve, 1.0)
    d = np.repeat(1.0 / curve, width)
    g, rhs, t = gram * d[:, None] * d, b.ravel() * d, pen / curve
    step = 1.0 / max(largest_curvature(g), 1e-300)
    x = (x0 * curve[:, None]).ravel()
    y, momentum = x.copy(), 1.0
    gap = np.inf
    for k in range(1, max_steps + 1):
        new = shrink((y - step * (g @ y - rhs)).reshape(groups, width), step * t).ravel()
        move = new - x
        if (y - new) @ move > 0:
            momentum, y = 1.0, new.copy()
        else:
            after = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
            y = new + (momentum - 1) / after * move
            momentum = after
        x = new
        if k % 10 == 0 or k == max_steps:
            out = (x * d).reshape(groups, width)
            gap = optimality_gap(gram, b, out, pen)
            if gap <= tol * scale_b:
                return out, k, gap
    return (x * d).reshape(groups, width), max_steps, gap
