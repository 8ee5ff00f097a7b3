"""Sequential gradient segmentation: candidates carry (theta, sum of thetas, Hessian) that one row updates."""

from __future__ import annotations

import numpy as np

from . import fits
from .partition import trace

EPSILON = 1e-10


def buckets(n: int, count: int) -> np.ndarray:
    """Bucket of each row: count runs of n // count rows, what is left in the last."""
    return np.full(n, count - 1) if n < count else np.minimum(np.arange(n) // (n // count), count - 1)


def _rows(family: str, theta: np.ndarray, x: np.ndarray, y: float) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian weight of one row for each candidate's theta."""
    u = np.clip(theta @ x, -500, 500)
    mu = 1 / (1 + np.exp(-u)) if family == "binomial" else np.exp(np.minimum(u, 20))
    return -(y - mu)[:, None] * x, mu * (1 - mu) if family == "binomial" else np.minimum(mu, 1e10)


def glm_partition(family: str, y: np.ndarray, x: np.ndarray, beta: float, vanilla: float = 0.0, count: int = 10, delta: float = 0.0) -> list[int]:
    """Change points of a logit or log regression: exact up to row vanilla * n, sequential gradients from there."""
    n, k = len(y), x.shape[1]
    x = np.column_stack([np.ones(n), x])
    bucket = buckets(n, count)
    initial = np.zeros((count, k + 1))
    for b in range(count):
        own = bucket == b
        if own.sum() > k:
            initial[b] = np.clip(fits.glm(family, x[own], y[own])[0], -20, 20)
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0] = -beta
    log_factorial = np.r_[0, np.cumsum(np.log(np.maximum(1, np.arange(1, int(max(0, y.max())) + 1))))] if family == "poisson" else None
    starts, theta, sums, hessian = np.array([0]), initial[[0]], initial[[0]].copy(), np.zeros((1, k + 1, k + 1))
    hessian[0] = _rows(family, theta, x[0], y[0])[1][0] * np.outer(x[0], x[0])
    exact = int(vanilla * n)
    for t in range(1, n + 1):
        cost = np.zeros(len(starts))
        for i, a in enumerate(starts.tolist()):
            if t <= exact:
                if t - a >= k:
                    theta[i], cost[i] = fits.glm(family, x[a:t], y[a:t], theta[i])
                    theta[i] = np.clip(theta[i], -20, 20)
                    sums[i] = theta[i] * (t - a)
        if t <= exact:
            g = _rows(family, theta, x[t - 1], y[t - 1])[1]
            hessian += g[:, None, None] * np.outer(x[t - 1], x[t - 1])
        else:
            old = np.arange(len(starts)) < len(starts) - (1 if t > 1 else 0)
            if old.any():
                grad, w = _rows(family, theta[old], x[t - 1], y[t - 1])
                hessian[old] += w[:, None, None] * np.outer(x[t - 1], x[t - 1])
                step = np.linalg.solve(hessian[old] + EPSILON * np.eye(k + 1), grad[:, :, None])[:, :, 0]
                theta[old] = np.clip(theta[old] - step, -20, 20)
                sums[old] += theta[old]
                for i in np.flatnonzero(old):
                    a = int(starts[i])
                    if t - a >= k:
                        u = np.clip(x[a:t] @ np.clip(sums[i] / (t - a), -20, 20), -500, 500)
                        if family == "binomial":
                            cost[i] = (np.logaddexp(0, u) - y[a:t] * u).sum()
                        else:
                            cost[i] = (np.exp(np.minimum(u, 20)) - y[a:t] * u + log_factorial[y[a:t].astype(int)]).sum()
        value = total[starts] + cost
        best = int(np.argmin(value))
        total[t], back[t] = value[best] + beta, starts[best]
        keep = value <= total[t] - delta
        keep[best] = True
        starts, theta, sums, hessian = starts[keep], theta[keep], sums[keep], hessian[keep]
        if t < n:
            first = initial[bucket[t]]
            w = _rows(family, first[None], x[t], y[t])[1][0]
            starts, theta, sums = np.append(starts, t), np.vstack([theta, first]), np.vstack([sums, first])
            hessian = np.concatenate([hessian, w * np.outer(x[t], x[t])[None]])
    return trace(back, n)


def custom_partition(x: np.ndarray, cost, gradient, hessian, p: int, beta: float, count: int = 10, delta: float = 0.0, bound: float = 20.0) -> list[int]:
    """Change points under a user's cost by sequential gradients.

    ``cost(rows, theta)`` is a segment's, ``gradient(rows, theta)`` and ``hessian(rows, theta)`` those of its last row. Each
    candidate's theta moves by one Newton step a row, its segment is priced at the mean of its thetas, and starts from the
    fit of its bucket of rows. Thetas stay within ``bound``.
    """
    n, bucket, initial, eye = len(x), buckets(len(x), count), np.zeros((count, p)), np.eye(p)
    for b in range(count):
        own = np.flatnonzero(bucket == b)
        if len(own) >= p:
            theta, best = np.zeros(p), float(cost(x[own], np.zeros(p)))
            for _ in range(100):
                each = [x[i : i + 1] for i in own]
                g, h = sum(np.asarray(gradient(r, theta), float) for r in each), sum(np.asarray(hessian(r, theta), float) for r in each)
                step, damp = None, fits.RIDGE
                for _ in range(12):
                    step = np.linalg.solve(h + damp * (1 + np.trace(h)) * eye, g)
                    new = float(cost(x[own], theta - step))
                    if new <= best:
                        break
                    damp *= 10
                else:
                    break
                theta, gain, best = theta - step, best - new, new
                if np.abs(step).max() < 1e-6 or gain < 1e-6 * (1 + new):
                    break
            initial[b] = np.clip(theta, -bound, bound)
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0] = -beta
    starts, theta, sums = [0], [initial[0]], [initial[0].copy()]
    second = [np.asarray(hessian(x[:1], initial[0]), float)]
    for t in range(1, n + 1):
        price = np.zeros(len(starts))
        for i, a in enumerate(starts[: len(starts) - (1 if t > 1 else 0)]):
            rows = x[a:t]
            second[i] = second[i] + np.asarray(hessian(rows, theta[i]), float)
            theta[i] = np.clip(theta[i] - np.linalg.solve(second[i] + EPSILON * eye, np.asarray(gradient(rows, theta[i]), float)), -bound, bound)
            sums[i] = sums[i] + theta[i]
            if t - a >= p - 1:
                price[i] = cost(rows, np.clip(sums[i] / (t - a), -bound, bound))
        value = total[starts] + price
        best = int(np.argmin(value))
        total[t], back[t] = value[best] + beta, starts[best]
        keep = [i for i in range(len(starts)) if i == best or value[i] <= total[t] - delta]
        starts, theta, sums, second = ([v[i] for i in keep] for v in (starts, theta, sums, second))
        if t < n:
            first = initial[bucket[t]]
            starts.append(t)
            theta.append(first)
            sums.append(first.copy())
            second.append(np.asarray(hessian(x[t : t + 1], first), float))
    return trace(back, n)


def lasso_noise(y: np.ndarray, x: np.ndarray, count: int = 10) -> tuple[float, float]:
    """Mean noise and mean number of active predictors over the buckets' cross-validated fits."""
    bucket, sigma, active = buckets(len(y), count), np.zeros(count), np.zeros(count)
    for b in range(count):
        own = bucket == b
        if own.sum() > x.shape[1]:
            _, theta = fits.lasso_cv(x[own], y[own])
            sigma[b], active[b] = np.sqrt(np.mean((y[own] - x[own] @ theta) ** 2)), (theta != 0).sum()
    return float(sigma.mean()), float(active.mean())


def lasso_partition(y: np.ndarray, x: np.ndarray, beta: float, sigma: float, count: int = 10) -> list[int]:
    """Change points of a sparse regression by sequential soft-threshold steps."""
    n, p = x.shape
    bucket = buckets(n, count)
    initial = np.zeros((count, p))
    for b in range(count):
        own = bucket == b
        if own.sum() > p:
            initial[b] = fits.lasso_cv(x[own], y[own])[1]
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
    total[0] = -beta
    starts, theta, sums = np.array([0]), initial[[0]].copy(), initial[[0]].copy()
    m = (np.outer(x[0], x[0]) + 1e-5 * np.eye(p))[None]
    factor = sigma * np.sqrt(2 * np.log(max(2, p)))
    for t in range(1, n):
        cost = np.zeros(len(starts))
        old = np.arange(len(starts)) < len(starts) - (1 if t > 1 else 0)
        if old.any():
            m[old] += np.outer(x[t], x[t])
            grad = -(y[t] - theta[old] @ x[t])[:, None] * x[t]
            lam = factor / np.sqrt(t + 1 - starts[old])
            step = np.linalg.solve(m[old], grad[:, :, None])[:, :, 0]
            theta[old] = fits.soft(theta[old] - step, (lam / np.sqrt((m[old] ** 2).sum((1, 2))))[:, None])
            sums[old] += theta[old]
            for j, i in enumerate(np.flatnonzero(old)):
                a = int(starts[i])
                if t + 1 - a >= 3:
                    mean = sums[i] / (t + 1 - a)
                    cost[i] = ((y[a : t + 1] - x[a : t + 1] @ mean) ** 2).sum() / 2 + lam[j] * np.abs(mean).sum()
        value = total[starts] + cost
        best = int(np.argmin(value))
        total[t + 1], back[t + 1] = value[best] + beta, starts[best]
        keep = value <= total[t + 1]
        starts, theta, sums, m = np.append(starts[keep], t), np.vstack([theta[keep], initial[bucket[t]]]), np.vstack([sums[keep], initial[bucket[t]]]), np.concatenate([m[keep], (np.outer(x[t], x[t]) + 1e-5 * np.eye(p))[None]])
    return trace(back, n)
