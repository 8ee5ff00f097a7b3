"""Segment costs. Each class prepares one series (prefix sums where they suffice) and prices [start, end) for an array
of starts at once: what an aggregate function is to a group, a cost is to a segment."""

from __future__ import annotations

import numpy as np

from . import fits

FLOOR = 1e-11


def rice(x: np.ndarray) -> np.ndarray:
    """Noise covariance from first differences, repaired until it is positive definite."""
    if len(x) < 2:
        return np.eye(x.shape[1])
    diff = np.diff(x, axis=0)
    return repaired(diff.T @ diff / (2 * (len(x) - 1)))


def repaired(s: np.ndarray) -> np.ndarray:
    """A symmetric matrix with as much jitter as makes it positive definite; the identity if none does."""
    eye = np.eye(len(s))
    if not np.isfinite(s).all():
        return eye
    s = (s + s.T) / 2
    for jitter in (0, *10.0 ** np.arange(-10, -1)):
        try:
            np.linalg.cholesky(s + jitter * eye)
            return s + jitter * eye
        except np.linalg.LinAlgError:
            continue
    return eye


def prefix(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0)])


class Moment:
    """Mean, variance or both. ``adjust``: the length term inside the recursion (half ln L under MBIC).

    A segment too short for a determinant is widened by d rows on both sides and priced by its own length. ``short``:
    "floor" leaves that out for one column, where one row then costs ln(1e-11) / 2, less than any penalty.
    """

    def __init__(self, x: np.ndarray, kind: str, adjust: str | None = "MBIC", sigma: np.ndarray | None = None, short: str = "widen"):
        self.kind, self.adjust, self.n, self.d = kind, adjust, *x.shape
        #: Rows from which on a segment is priced by itself.
        self.least = {"mean": 1, "variance": self.d, "meanvariance": 1 if short == "floor" and self.d == 1 else self.d + 1}[kind]
        if kind == "mean":
            s = rice(x) if sigma is None else np.atleast_2d(np.asarray(sigma, float))
            x = x @ np.linalg.cholesky(np.linalg.inv(s))
            self.square = prefix((x * x).sum(1))
        else:
            x = x - x.mean(0) if kind == "variance" else x
            self.outer = prefix(x[:, :, None] * x[:, None, :])
        self.sum = prefix(x)
        self.p = {"mean": self.d, "variance": self.d**2, "meanvariance": self.d + self.d**2}[kind]

    def raw(self, start: np.ndarray, end: int) -> np.ndarray:
        length = end - start
        if self.kind == "mean":
            s = self.sum[end] - self.sum[start]
            return ((self.square[end] - self.square[start]) - (s * s).sum(-1) / length) / 2
        a, b = start, np.broadcast_to(end, start.shape)
        short = length < self.least
        if short.any():
            a, b = np.where(short, np.maximum(start - self.d, 0), a), np.where(short, np.minimum(end + self.d, self.n), b)
        wide = b - a
        m = self.outer[b] - self.outer[a]
        if self.kind == "meanvariance":
            s = self.sum[b] - self.sum[a]
            m = m - s[:, :, None] * s[:, None, :] / wide[:, None, None]
        if self.d == 1:
            m = np.where(m[:, 0, 0] <= 0, FLOOR, m[:, 0, 0])
            return length / 2 * np.log(m / wide)
        return length / 2 * np.log(np.maximum(np.linalg.det(m / wide[:, None, None]), FLOOR))

    def _flat(self, start, end) -> tuple:
        """Length, sum and spread of [start, end) of one column, over arrays of both."""
        length, s, q = end - start, self.sum[:, 0], self.square if self.kind == "mean" else self.outer[:, 0, 0]
        apart = s[end] - s[start]
        m = q[end] - q[start]
        return length, m if self.kind == "variance" else m - apart * apart / length

    def under(self, start, end) -> np.ndarray:
        """The price without its length term and without widening (see ``partition_blocks``)."""
        with np.errstate(all="ignore"):
            length, m = self._flat(start, end)
            raw = m / 2 if self.kind == "mean" else length / 2 * np.log(np.where(m <= 0, FLOOR, m) / length)
        return raw * np.log2(np.e) if self.adjust == "MDL" else raw

    def unbounded(self, start, end) -> np.ndarray:
        """Where rows that differ by next to nothing take the floor, which later rows can undercut."""
        return np.zeros(len(start), bool) if self.kind == "mean" else self._flat(start, end)[1] <= 3 * FLOOR * self.n

    def pairs(self, start, end) -> np.ndarray:
        """``self`` for one column over arrays of starts and ends; without meaning where an end isn't after its start."""
        with np.errstate(all="ignore"):
            length, m = self._flat(start, end)
            c = m / 2 if self.kind == "mean" else length / 2 * np.log(np.where(m <= 0, FLOOR, m) / length)
            if self.least > 1 and (short := length == 1).any():
                c[short] = self.raw(np.broadcast_to(start, c.shape)[short], np.broadcast_to(end, c.shape)[short])
            if self.adjust == "MBIC":
                return c + np.log(length) / 2
            return (c + self.p * np.log(length) / 2) * np.log2(np.e) if self.adjust == "MDL" else c

    def slack(self, start: np.ndarray, end: int) -> np.ndarray:
        """How much the length terms of [start, end) and of what follows may exceed that of both together, at most: the
        longer what follows is, the more. Pruning has to leave it."""
        most = np.log((end - start) * (max(self.n - end, 1) / (self.n - start))) / 2
        return np.maximum(most, 0.0) * {"MBIC": 1.0, "MDL": self.p * np.log2(np.e)}.get(self.adjust, 0.0)

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        c, length = self.raw(start, end), end - start
        if self.adjust == "MBIC":
            return c + np.log(length) / 2
        if self.adjust == "MDL":
            return (c + self.p * np.log(length) / 2) * np.log2(np.e)
        return c


class Linear:
    """Least squares with one or more responses and no intercept, from prefix Gram matrices: no refit per segment."""

    def __init__(self, y: np.ndarray, x: np.ndarray, sigma: np.ndarray | None = None):
        y = y[:, None] if y.ndim == 1 else y
        self.p, self.q = x.shape[1], y.shape[1]
        self.xx, self.xy, self.yy = prefix(x[:, :, None] * x[:, None, :]), prefix(x[:, :, None] * y[:, None, :]), prefix(y[:, :, None] * y[:, None, :])
        self.sigma, self.least = sigma, self.p + 1
        if sigma is not None:
            self.inverse, self.log_det = np.linalg.inv(sigma), np.linalg.slogdet(sigma)[1]

    def residual(self, start: np.ndarray, end: int) -> np.ndarray:
        g, c = self.xx[end] - self.xx[start], self.xy[end] - self.xy[start]
        out = np.full((len(start), self.q, self.q), np.nan)
        if self.p == 1:  # one number for a matrix
            fit = g[:, 0, 0] > 0
            out[fit] = (self.yy[end] - self.yy[start])[fit] - np.swapaxes(c[fit], 1, 2) @ c[fit] / g[fit]
            return out
        scale = np.maximum(np.einsum("kii->k", g) / self.p, 1e-300)
        fit = np.linalg.cond(g / scale[:, None, None]) < 1e12
        if fit.any():
            b = np.linalg.solve(g[fit], c[fit])
            out[fit] = (self.yy[end] - self.yy[start])[fit] - np.swapaxes(c[fit], 1, 2) @ b
        return out

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        length = end - start
        r = self.residual(start, end)
        if self.sigma is None:
            c = r[:, 0, 0] / 2
        else:
            c = length / 2 * self.log_det + np.einsum("ij,kji->k", self.inverse, r) / 2
        return np.where(length < self.p + 1, 0.0, np.where(np.isnan(c), np.inf, c))

    def under(self, start, end) -> np.ndarray:
        """Of one predictor that is never zero and one response (see ``partition_blocks``)."""
        with np.errstate(all="ignore"):
            xx, xy, yy = (s[:, 0, 0] for s in (self.xx, self.xy, self.yy))
            c = xy[end] - xy[start]
            return ((yy[end] - yy[start]) - c * c / (xx[end] - xx[start])) / 2

    def unbounded(self, start, end) -> np.ndarray:
        return np.zeros(len(start), bool)

    def pairs(self, start, end) -> np.ndarray:
        return np.where(end - start < self.least, 0.0, self.under(start, end))


def noise(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Noise covariance of a regression from slopes of neighbouring blocks that slide by one row."""
    y = y[:, None] if y.ndim == 1 else y
    n, d, k = len(y), y.shape[1], x.shape[1] + 1
    if k < 2:
        return np.eye(d)
    found = []
    for i in range(n - k):
        a, b = slice(i, i + k), slice(i + 1, i + k + 1)
        try:
            ga, gb = np.linalg.inv(x[a].T @ x[a]), np.linalg.inv(x[b].T @ x[b])
        except np.linalg.LinAlgError:
            continue
        ba, bb = ga @ (x[a].T @ y[a]), gb @ (x[b].T @ y[b])
        diff = ba - bb
        between = np.trace(ga + gb - 2 * ga @ (x[i + 1 : i + k].T @ x[i + 1 : i + k]) @ gb)
        top, bottom = diff.T @ diff, np.full((d, d), between)
        if d > 1:
            apart = ((ba[:, :, None] - bb[:, None, :]) ** 2).sum(0)
            np.fill_diagonal(apart, 0)
            bottom = bottom + apart
        with np.errstate(all="ignore"):
            found.append(top / bottom)
    found = np.array(found).reshape(-1, d, d)
    found = found[np.isfinite(found).all((1, 2))]
    if not len(found):
        return np.eye(d)
    s = found.mean(0)
    if d == 1:
        return s
    values, vectors = np.linalg.eigh((s + s.T) / 2)
    return vectors @ np.diag(np.maximum(values, 1e-10)) @ vectors.T


class Fitted:
    """A cost that must be fitted segment by segment; fits start from those of the segment one row shorter."""

    def __init__(self, n: int, least: int, fit, short: float = 0.0):
        self.n, self.least, self.fit, self.short, self.warm = n, least, fit, short, {}

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        out, warm = np.full(len(start), self.short), {}
        for i, a in enumerate(start.tolist()):
            if end - a >= self.least:
                try:
                    warm[a], out[i] = self.fit(a, end, self.warm.get(a))
                except (np.linalg.LinAlgError, FloatingPointError, ValueError):
                    out[i] = np.inf
            elif a in self.warm:
                warm[a] = self.warm[a]
        self.warm = warm
        return out


def regression(family: str, y: np.ndarray, x: np.ndarray) -> Fitted:
    """Exact logit or log regression with an intercept."""
    x = np.column_stack([np.ones(len(y)), x])
    return Fitted(len(y), x.shape[1] + 1, lambda a, b, s: fits.glm(family, x[a:b], y[a:b], s))


def lasso(y: np.ndarray, x: np.ndarray, sigma: float, alpha: float | None = None) -> Fitted:
    xx, xy, yy = prefix(x[:, :, None] * x[:, None, :]), prefix(x * y[:, None]), prefix(y * y)

    def fit(a: int, b: int, start):
        g, c, n = xx[b] - xx[a], xy[b] - xy[a], b - a
        penalty = alpha if alpha is not None else sigma * np.sqrt(2 * np.log(max(2, x.shape[1]))) / np.sqrt(n)
        theta = fits.lasso_gram(g, c, n, penalty, start, 200, 1e-5)
        return theta, max(0.0, (yy[b] - yy[a] - 2 * c @ theta + theta @ g @ theta) / 2)

    return Fitted(len(y), 3, fit)


class Arma:
    """Exact likelihood at conditional least squares; all starts of a step are fitted side by side, each from its fit
    one row shorter."""

    def __init__(self, y: np.ndarray, p: int, q: int, trim: float):
        self.y, self.p, self.q, self.warm = y, p, q, {}
        self.least = max(int(trim * len(y)), max(p, q) + 3)

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        out = np.full(len(start), np.nan)
        own = np.flatnonzero(end - start >= self.least)
        if not len(own):
            return out
        first = int(start[own[0]])
        lanes = np.where(np.arange(first, end) >= start[own][:, None], self.y[first:end], 0.0)
        zero = np.zeros(self.p + self.q)
        theta = np.array([self.warm.get(a, zero) for a in start[own].tolist()])
        cold = np.array([a not in self.warm for a in start[own].tolist()])
        if cold.any():
            theta[cold] = fits.arma_lanes(lanes[cold], self.p, self.q, theta[cold], 12)
        if not cold.all():
            theta[~cold] = fits.arma_lanes(lanes[~cold], self.p, self.q, theta[~cold], 2)
        self.warm = dict(zip(start[own].tolist(), theta, strict=True))
        out[own] = fits.arma_losses(self.y[:end], start[own], theta, self.p, self.q)
        return out


def garch(y: np.ndarray, p: int, q: int, trim: float) -> Fitted:
    return Fitted(len(y), max(int(trim * len(y)), max(p, q) + 5), lambda a, b, s: fits.garch(y[a:b], p, q, s, 4 if s is not None else 25), np.nan)


class Rank:
    """Quadratic form of the mean ranks; ``r`` are ordinal ranks from 1, ties by position."""

    def __init__(self, r: np.ndarray, min_length: int = 2):
        n, d = r.shape
        centred = r - (n + 1) / 2
        s = ((r + 0.5 - (n + 1) / 2).T @ (r + 0.5 - (n + 1) / 2)) / n
        s = s + 1e-10 * np.trace(s) / d * np.eye(d)
        self.inverse, self.sum, self.least = np.linalg.inv(s), prefix(centred), max(2, d + 1, min_length or 0)

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        length = end - start
        mean = (self.sum[end] - self.sum[start]) / length[:, None]
        return np.where(length < self.least, 0.0, -length * np.einsum("ki,ij,kj->k", mean, self.inverse, mean))

    def under(self, start, end) -> np.ndarray:
        """Of one column, of short segments too (see ``partition_blocks``)."""
        length, s = end - start, self.sum[:, 0]
        with np.errstate(all="ignore"):
            mean = (s[end] - s[start]) / length
            return -length * (mean * self.inverse[0, 0] * mean)

    def unbounded(self, start, end) -> np.ndarray:
        return np.zeros(len(start), bool)

    def pairs(self, start, end) -> np.ndarray:
        return np.where(end - start < self.least, 0.0, self.under(start, end))


class Kernel:
    """Gaussian kernel by random Fourier features; gamma from the median squared distance where it is not given."""

    def __init__(self, x: np.ndarray, gamma: float | None = None, features: int = 256, seed: int = 0, min_length: int = 2, most: int = 10_000):
        if gamma is None:
            gamma = 1 / max(median_distance(x, most), 1e-12)
        rng = np.random.default_rng(seed)
        w = rng.normal(0, np.sqrt(2 * gamma), (features, x.shape[1]))
        b = rng.uniform(0, 2 * np.pi, features)
        self.sum, self.least = prefix(np.sqrt(2 / features) * np.cos(x @ w.T + b)), max(2, min_length or 0)

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        length = end - start
        s = self.sum[end] - self.sum[start]
        return np.where(length < self.least, 0.0, length - 2 * (s * s).sum(1) / length)


#: Pair distances that are held at once.
PAIRS = 4_000_000


def _distances(x: np.ndarray):
    """Squared distances of all pairs, some rows at a time."""
    rows = max(1, PAIRS // (4 * len(x)))
    for a in range(0, len(x) - 1, rows):
        own, rest = x[a : a + rows], x[a:]
        apart = np.zeros((len(own), len(rest)))
        for k in range(x.shape[1]):
            apart += (own[:, k, None] - rest[:, k]) ** 2
        yield apart[np.arange(len(own))[:, None] < np.arange(len(rest))]


def _ranked(x: np.ndarray, ranks: list[int]) -> list[float]:
    """Exact order statistics (ascending, from 0) of the pair distances: ranges of their bits are counted and narrowed
    until few enough are left to be sorted."""
    out: list[float] = []
    values, below = np.zeros(0), 0
    for rank in ranks:
        if not below <= rank < below + len(values):
            low, high, below, left = 0, int(np.float64(np.inf).view(np.int64)), 0, len(x) * (len(x) - 1) // 2
            while left > PAIRS and low < high:
                width = (high - low) // 65_536 + 1
                counts = np.zeros(65_536, np.int64)
                for d in _distances(x):
                    bits = d.view(np.int64)
                    counts += np.bincount((bits[(bits >= low) & (bits <= high)] - low) // width, minlength=65_536)
                total = np.cumsum(counts)
                k = int(np.searchsorted(total, rank - below, "right"))
                below, left = below + int(total[k] - counts[k]), int(counts[k])
                low, high = low + k * width, min(high, low + (k + 1) * width - 1)
            if low == high:
                values = np.broadcast_to(np.int64(low).view(np.float64), left)
            else:
                values = np.sort(np.concatenate([d[(d.view(np.int64) >= low) & (d.view(np.int64) <= high)] for d in _distances(x)]))
        out.append(float(values[rank - below]))
    return out


def median_distance(x: np.ndarray, most: int = 10_000) -> float:
    """Median squared distance of all pairs; beyond ``most`` rows of the reference's draw of so many."""
    if len(x) > most:
        x = x[np.random.default_rng(0).choice(len(x), most, replace=False)]
    pairs = len(x) * (len(x) - 1) // 2
    return sum(_ranked(x, [(pairs - 1) // 2, pairs // 2])) / 2 if pairs else 0.0


class Custom:
    """A user's ``cost(segment) -> float`` over rows [start, end)."""

    def __init__(self, x: np.ndarray, cost, min_length: int = 1):
        self.x, self.cost, self.least = x, cost, min_length

    def __call__(self, start: np.ndarray, end: int) -> np.ndarray:
        return np.array([float(self.cost(self.x[a:end])) if end - a >= self.least else 0.0 for a in start.tolist()])
