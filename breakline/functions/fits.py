"""Small fits for segments: generalised linear models, lasso, ARMA and GARCH. Plain numpy, deterministic."""

from __future__ import annotations

import numpy as np

RIDGE = 1e-6


def ols(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares, no intercept."""
    theta = np.linalg.lstsq(x, y, rcond=None)[0]
    return theta, float(((y - x @ theta) ** 2).sum())


def glm(family: str, x: np.ndarray, y: np.ndarray, start: np.ndarray | None = None, rounds: int = 100, tol: float = 1e-6) -> tuple[np.ndarray, float]:
    """Newton fit of a logit or log model with a small ridge: coefficients and negative log-likelihood."""
    theta = np.zeros(x.shape[1]) if start is None or np.abs(start).max() > 10 else start.copy()
    loss, damp, eye = glm_loss(family, x, y, theta), RIDGE, np.eye(x.shape[1])
    for _ in range(rounds):
        u = np.clip(x @ theta, -30, 30)
        mu = 1 / (1 + np.exp(-u)) if family == "binomial" else np.exp(np.minimum(u, 20))
        w = mu * (1 - mu) if family == "binomial" else np.minimum(mu, 1e10)
        h, g = (x * w[:, None]).T @ x, x.T @ (y - mu)
        for _ in range(12):  # separated classes have no optimum: damped until the loss falls
            step = np.linalg.solve(h + damp * (1 + np.trace(h)) * eye, g)
            new = glm_loss(family, x, y, theta + step)
            if new <= loss:
                break
            damp *= 10
        else:
            break
        theta, gain, loss, damp = theta + step, loss - new, new, max(RIDGE, damp / 10)
        if np.abs(step).max() < tol or gain < 1e-6 * (1 + loss):
            break
    return theta, loss


def glm_loss(family: str, x: np.ndarray, y: np.ndarray, theta: np.ndarray) -> float:
    u = np.clip(x @ theta, -500, 500)
    if family == "binomial":
        return float((np.logaddexp(0, u) - y * u).sum())
    mu = np.exp(np.minimum(u, 20))
    return float((np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0) - (y - mu)).sum())


def soft(z, a):
    return np.sign(z) * np.maximum(np.abs(z) - a, 0)


def lasso(x: np.ndarray, y: np.ndarray, alpha: float, start: np.ndarray | None = None, rounds: int = 1000, tol: float = 1e-6) -> np.ndarray:
    """Cyclic coordinate descent for RSS / 2L + alpha |theta|, on the Gram matrix."""
    return lasso_gram(x.T @ x, x.T @ y, len(y), alpha, start, rounds, tol)


def lasso_gram(g: np.ndarray, c: np.ndarray, n: int, alpha: float, start=None, rounds: int = 1000, tol: float = 1e-6) -> np.ndarray:
    theta = np.zeros(len(c)) if start is None else start.copy()
    size = np.diag(g)
    grad = c - g @ theta
    for _ in range(rounds):
        most = 0.0
        for j in range(len(c)):
            if size[j] > 0:
                new = float(soft(grad[j] + size[j] * theta[j], alpha * n)) / size[j]
                if new != theta[j]:
                    grad -= g[:, j] * (new - theta[j])
                    most = max(most, abs(new - theta[j]))
                    theta[j] = new
        if most < tol:
            break
    return theta


def lasso_cv(x: np.ndarray, y: np.ndarray, folds: int = 5, steps: int = 20) -> tuple[float, np.ndarray]:
    """The alpha with the least error over contiguous folds, and its fit."""
    top = np.abs(x.T @ y).max() / max(1, len(y))
    if not top:
        return 0.0, np.zeros(x.shape[1])
    alphas = top * np.logspace(0, -3, steps)
    part = np.arange(len(y)) * folds // len(y)
    errors = np.zeros(steps)
    for f in range(folds):
        own, out = part != f, part == f
        theta = None
        for k, a in enumerate(alphas):
            theta = lasso(x[own], y[own], a, theta, 200, 1e-4)
            errors[k] += ((y[out] - x[out] @ theta) ** 2).sum()
    alpha = float(alphas[int(errors.argmin())])
    return alpha, lasso(x, y, alpha)


def arma_residuals(y: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> np.ndarray:
    """Conditional residuals, lanes by rows: y (m, L), ar (m, p), ma (m, q)."""
    p, q, length = ar.shape[1], ma.shape[1], y.shape[1]
    e = np.zeros((len(y), length + q))
    padded = np.concatenate([np.zeros((len(y), p)), y], 1)
    for t in range(length):
        r = y[:, t].copy()
        for k in range(p):
            r -= ar[:, k] * padded[:, p + t - 1 - k]
        for k in range(q):
            r -= ma[:, k] * e[:, q + t - 1 - k]
        e[:, q + t] = np.clip(r, -1e8, 1e8)
    return e[:, q:]


def arma(y: np.ndarray, p: int, q: int, start: np.ndarray | None = None, rounds: int = 12) -> np.ndarray:
    """(ar..., ma..., sigma2) by Gauss-Newton on conditional residuals, kept stationary and invertible."""
    k = p + q
    theta = np.zeros(k) if start is None else start[:k].copy()
    best = _rss(y, theta, p)
    for _ in range(rounds):
        lanes = theta + np.vstack([np.zeros(k), 1e-5 * np.eye(k)])
        e = arma_residuals(np.tile(y, (k + 1, 1)), lanes[:, :p], lanes[:, p:])
        jac = (e[1:] - e[0]).T / 1e-5
        step = np.linalg.solve(jac.T @ jac + (1e-4 * np.trace(jac.T @ jac) / k + 1e-12) * np.eye(k), -jac.T @ e[0])
        for scale in (1.0, 0.5, 0.25, 0.1):
            new = theta + scale * step
            if (value := _rss(y, new, p)) < best:
                break
        else:
            break
        done = best - value < 1e-8 * max(best, 1e-12)
        theta, best = new, value
        if done:
            break
    return np.r_[theta, max(best / len(y), 1e-12)]


def _rss(y: np.ndarray, theta: np.ndarray, p: int) -> float:
    ar, ma = theta[:p], theta[p:]
    for c in (np.r_[1, -ar], np.r_[1, ma]):  # roots inside the unit circle of z^p - ... : stationary, invertible
        if len(c) > 1 and np.abs(np.roots(c)).max(initial=0) >= 0.999:
            return np.inf
    return float((arma_residuals(y[None], ar[None], ma[None]) ** 2).sum())


def arma_lanes(y: np.ndarray, p: int, q: int, theta: np.ndarray, rounds: int) -> np.ndarray:
    """``arma`` without the variance for many segments at once: rows of y end together and begin with zeros, which the
    conditional residuals leave zero."""
    m, k = theta.shape
    rss = lambda th: np.where(_stable(th, p), (arma_residuals(np.tile(y, (len(th) // m, 1)), th[:, :p], th[:, p:]) ** 2).sum(1), np.inf)
    best = rss(theta)
    for _ in range(rounds):
        moved = np.concatenate([theta, *(theta + 1e-5 * np.eye(k)[j] for j in range(k))])
        e = arma_residuals(np.tile(y, (k + 1, 1)), moved[:, :p], moved[:, p:]).reshape(k + 1, m, -1)
        jac = (e[1:] - e[0]) / 1e-5
        h, g = np.einsum("aml,bml->mab", jac, jac), np.einsum("aml,ml->ma", jac, e[0])
        h = h + (1e-4 * np.einsum("maa->m", h) / k + 1e-12)[:, None, None] * np.eye(k)
        step = -np.linalg.solve(h, g[:, :, None])[:, :, 0]
        tries = np.concatenate([theta + s * step for s in (1.0, 0.5, 0.2, 0.05)])
        values = rss(tries).reshape(4, m)
        j = values.argmin(0)
        new = values[j, np.arange(m)]
        better = new < best
        if not better.any():
            break
        theta = np.where(better[:, None], tries.reshape(4, m, k)[j, np.arange(m)], theta)
        gain = (best - np.minimum(new, best)) / np.maximum(best, 1e-12)
        best = np.minimum(new, best)
        if gain.max() < 1e-6:
            break
    return theta


def _stable(theta: np.ndarray, p: int) -> np.ndarray:
    """Stationary and invertible lanes; closed forms to order two, roots beyond."""
    ok = np.ones(len(theta), bool)
    for c, sign in ((theta[:, :p], 1), (theta[:, p:], -1)):
        c = sign * c
        if c.shape[1] == 1:
            ok &= np.abs(c[:, 0]) < 0.999
        elif c.shape[1] == 2:
            ok &= (np.abs(c[:, 1]) < 0.999) & (c[:, 0] + c[:, 1] < 0.999) & (c[:, 1] - c[:, 0] < 0.999)
        elif c.shape[1]:
            ok &= np.array([np.abs(np.roots(np.r_[1, -r])).max() < 0.999 for r in c])
    return ok


def arma_losses(y: np.ndarray, starts: np.ndarray, theta: np.ndarray, p: int, q: int) -> np.ndarray:
    """Exact Gaussian negative log-likelihoods of y[start:] by the Kalman filter, variances concentrated out; starts
    ascend, so the lanes that run at a step are the first ones."""
    m, r = len(starts), max(p, q + 1)
    t, h = np.zeros((m, r, r)), np.zeros((m, r))
    t[:, :p, 0] = theta[:, :p]
    t[:, : r - 1, 1:] += np.eye(r - 1)
    h[:, 0], h[:, 1 : q + 1] = 1, theta[:, p : p + q]
    v = h[:, :, None] * h[:, None, :]
    kron = np.einsum("mij,mkl->mikjl", t, t).reshape(m, r * r, r * r)
    cov = np.linalg.solve(np.eye(r * r) * (1 + 1e-10) - kron, v.reshape(m, r * r, 1)).reshape(m, r, r)
    a, squares, logs = np.zeros((m, r)), np.zeros(m), np.zeros(m)
    turn = np.swapaxes(t, 1, 2)
    for i in range(int(starts[0]), len(y)):
        n = int(np.searchsorted(starts, i, "right"))
        f = np.maximum(cov[:n, 0, 0], 1e-12)
        err = y[i] - a[:n, 0]
        squares[:n] += err * err / f
        logs[:n] += np.log(f)
        gain = cov[:n, :, 0] / f[:, None]
        a[:n] = (t[:n] @ (a[:n] + gain * err[:, None])[:, :, None])[:, :, 0]
        cov[:n] = t[:n] @ (cov[:n] - gain[:, :, None] * cov[:n, None, 0]) @ turn[:n] + v[:n]
    size = len(y) - starts
    return 0.5 * (size * np.log(2 * np.pi * np.maximum(squares / size, 1e-12)) + size + logs)


def arma_loss(y: np.ndarray, theta: np.ndarray, p: int, q: int) -> float:
    return float(arma_losses(y, np.array([0]), theta[None], p, q)[0])


def garch_variances(y2: np.ndarray, theta: np.ndarray, p: int, q: int) -> np.ndarray:
    """Conditional variances, lanes by rows of theta (omega, alpha..., beta...)."""
    m, n = len(theta), len(y2)
    start = y2.mean()
    out = np.empty((m, n))
    for t in range(n):
        s = theta[:, 0].copy()
        for k in range(p):
            s += theta[:, 1 + k] * (y2[t - 1 - k] if t > k else start)
        for k in range(q):
            s += theta[:, 1 + p + k] * (out[:, t - 1 - k] if t > k else start)
        out[:, t] = np.maximum(s, 1e-12)
    return out


def garch(y: np.ndarray, p: int, q: int, start: np.ndarray | None = None, rounds: int = 25) -> tuple[np.ndarray, float]:
    """(omega, alpha..., beta...) and negative log-likelihood, by scoring steps inside the stationary region."""
    y2, k = y * y, 1 + p + q
    scale = max(float(y2.mean()), 1e-12)
    theta = np.r_[scale * (1 - 0.05 * (k - 1)), np.full(k - 1, 0.05)] if start is None else start.copy()
    loss = lambda th: 0.5 * (np.log(2 * np.pi * (v := garch_variances(y2, th, p, q))) + y2 / v).sum(1)
    best = float(loss(theta[None])[0])
    unit = np.r_[scale, np.ones(k - 1)]
    for _ in range(rounds):
        h = 1e-4 * unit
        v = garch_variances(y2, theta + np.vstack([np.zeros(k), np.diag(h)]), p, q)
        each = 0.5 * (np.log(v) + y2 / v)
        score = (each[1:] - each[0]) / h[:, None] * unit[:, None]
        step = -np.linalg.lstsq(score @ score.T + 1e-6 * np.eye(k), score.sum(1), rcond=None)[0] * unit
        tries = np.array([theta + s * step for s in (1.0, 0.5, 0.2, 0.05)])
        tries[:, 0] = np.maximum(tries[:, 0], 1e-6 * scale)
        tries[:, 1:] = np.maximum(tries[:, 1:], 0)
        over = tries[:, 1:].sum(1)
        tries[:, 1:] *= np.where(over > 0.999, 0.999 / np.maximum(over, 1e-12), 1)[:, None]
        values = loss(tries)
        j = int(values.argmin())
        if not values[j] < best - 1e-7 * abs(best):
            break
        theta, best = tries[j], float(values[j])
    return theta, best
