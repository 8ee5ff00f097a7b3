"""Synthetic series with known change points: one seeded task row per series, so any number is made in parallel.

Every generator gives a ``Dataset``: rows (series_id, t, v or y and x), truth (series_id, cp) and info (series_id and a
map of named figures). The stream of a series is numpy's PCG64 seeded with ``seed + series_id``: the same on any cluster.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def draw_change_points(n: int, k: int, rng: np.random.Generator) -> list[int]:
    """k change points from Dirichlet lengths; short segments are filled up from the longest."""
    if k <= 0:
        return []
    least = max(5, n // (k + 1) // 2)
    if least * (k + 1) > n:
        raise ValueError(f"{n} rows do not hold {k} change points")
    size = np.maximum(1, np.floor(rng.dirichlet(np.full(k + 1, 2000 / (k + 1))) * n)).astype(int)
    size = np.maximum(size, least)
    while size.sum() > n:
        size[size.argmax()] -= min(size.sum() - n, size.max() - least)
    size[-1] += n - size.sum()
    return np.cumsum(size)[:-1].tolist()


def _spans(n: int, cps: list[int]):
    return list(zip([0, *cps], [*cps, n], strict=True))


def mean_series(rng, n, cps, dims=1, kind="jump", snr_db=None, noise=1.0, size=(2.0, 5.0)):
    """Level changes ("jump") or changes of slope ("drift"); snr_db sets the noise from the levels' spread."""
    if kind not in ("jump", "drift"):
        raise ValueError("kind must be jump or drift")
    levels = np.zeros((len(cps) + 1, dims))
    for i in range(1, len(levels)):
        levels[i] = levels[i - 1] + rng.uniform(*size, dims) * rng.choice([-1, 1], dims)
    signal = np.zeros((n, dims))
    for (a, b), level in zip(_spans(n, cps), levels, strict=True):
        signal[a:b] = level if kind == "jump" else level * np.linspace(0, 1, b - a)[:, None]
    if snr_db is not None:
        noise = float(np.sqrt(max(signal.var(), 1e-12) / 10 ** (snr_db / 10)))
    snr = 10 * np.log10(max(signal.var(), 1e-12) / noise**2)
    return signal + rng.normal(0, noise, (n, dims)), {"noise_std": noise, "snr_db": snr, "difficulty": 1 / (1 + snr / 10)}


def variance_series(rng, n, cps, dims=1, kind="multiplicative", base=1.0, ratio=(2.0, 6.0)):
    if kind not in ("multiplicative", "additive"):
        raise ValueError("kind must be multiplicative or additive")
    var, x = base, np.zeros((n, dims))
    for i, (a, b) in enumerate(_spans(n, cps)):
        if i:
            r = rng.uniform(*ratio)
            var = (var * r if i % 2 else var / r) if kind == "multiplicative" else max(0.1, var + (r if i % 2 else -r))
        x[a:b] = rng.normal(0, np.sqrt(var), (b - a, dims))
    return x, {"last_variance": var}


def _design(rng, n, p, correlation):
    cov = correlation ** np.abs(np.subtract.outer(np.arange(p), np.arange(p))) if correlation else np.eye(p)
    return rng.multivariate_normal(np.zeros(p), cov, n)


def _coefficients(rng, k, p, kind):
    if kind not in ("random", "sign_flip", "magnitude"):
        raise ValueError("kind must be random, sign_flip or magnitude")
    out = [rng.uniform(0.5, 3, p) * rng.choice([-1, 1], p)]
    for _ in range(k):
        out.append(rng.uniform(0.5, 3, p) * rng.choice([-1, 1], p) if kind == "random" else -out[-1] if kind == "sign_flip" else out[-1] * rng.choice([0.3, 3]))
    return out


def regression_series(rng, n, cps, features=3, kind="random", correlation=0.0, noise=1.0, coefs=None):
    x = _design(rng, n, features, correlation)
    coefs = coefs or _coefficients(rng, len(cps), features, kind)
    y = np.concatenate([x[a:b] @ c for (a, b), c in zip(_spans(n, cps), coefs, strict=True)]) + rng.normal(0, noise, n)
    return np.column_stack([y, x]), {"condition_number": float(np.linalg.cond(x)), "effect_size": float(np.mean([np.linalg.norm(np.subtract(b, a)) for a, b in zip(coefs, coefs[1:], strict=False)] or [0]))}


def glm_series(rng, n, cps, features=2, family="binomial", trials=1, correlation=0.0, coefs=None):
    if family not in ("binomial", "poisson"):
        raise ValueError("family must be binomial or poisson")
    x = _design(rng, n, features, correlation)
    coefs = coefs or [c if family == "binomial" else c / 4 for c in _coefficients(rng, len(cps), features, "random")]
    u = np.concatenate([x[a:b] @ c for (a, b), c in zip(_spans(n, cps), coefs, strict=True)])
    y = rng.binomial(trials, 1 / (1 + np.exp(-u))) if family == "binomial" else rng.poisson(np.exp(np.clip(u, -10, 10)))
    return np.column_stack([y.astype(float), x]), {"trials": float(trials)}


def stationary(coefs) -> bool:
    """Whether 1 - c1 z - c2 z^2 ... has all its roots outside the unit circle."""
    roots = np.roots(np.r_[1.0, -np.asarray(coefs, float)]) if len(coefs) else np.zeros(0)
    return bool((np.abs(roots) < 1).all())


def arma_series(rng, n, cps, order=(1, 1), sigma_change=False, innovation="normal"):
    p, q = order
    draw = {"normal": lambda m: rng.normal(0, 1, m), "t": lambda m: rng.standard_t(5, m) / np.sqrt(5 / 3), "skew_normal": lambda m: (rng.gamma(4, 1, m) - 4) / 2}[innovation]
    y, info = np.zeros(n), {"is_stationary": 1.0, "is_invertible": 1.0}
    for i, (a, b) in enumerate(_spans(n, cps)):
        while True:
            phi, theta = rng.uniform(-0.9, 0.9, p), rng.uniform(-0.9, 0.9, q)
            if stationary(phi) and stationary(-theta):
                break
        sigma = rng.uniform(0.5, 3) if sigma_change and i else 1.0
        e, past = sigma * draw(b - a + q), np.zeros(p)
        for t in range(a, b):
            y[t] = phi @ past + e[t - a + q] + sum(theta[j] * e[t - a + q - 1 - j] for j in range(q))
            past = np.r_[y[t], past[:-1]] if p else past
    return y[:, None], info


def garch_series(rng, n, cps, order=(1, 1), regimes=("low", "high")):
    omega = {"low": 0.05, "medium": 0.3, "high": 1.5}
    p, q = order
    y, vol = np.zeros(n), np.zeros(n)
    for i, (a, b) in enumerate(_spans(n, cps)):
        alpha, beta = rng.uniform(0.05, 0.2, p) / max(p, 1), rng.uniform(0.5, 0.8, q) / max(q, 1)
        if (total := alpha.sum() + beta.sum()) > 0.98:
            alpha, beta = alpha * 0.95 / total, beta * 0.95 / total
        w = omega[regimes[i % len(regimes)]]
        level = w / (1 - alpha.sum() - beta.sum())
        y2, s2 = np.full(p, level), np.full(q, level)
        for t in range(a, b):
            s = w + alpha @ y2 + beta @ s2
            y[t], vol[t] = np.sqrt(s) * rng.normal(), np.sqrt(s)
            y2, s2 = np.r_[y[t] ** 2, y2[:-1]], np.r_[s, s2[:-1]] if q else s2
    return np.column_stack([y, vol]), {"mean_volatility": float(vol.mean())}


KINDS = {"mean": mean_series, "variance": variance_series, "regression": regression_series, "glm": glm_series, "arma": arma_series, "garch": garch_series}


@dataclass(frozen=True)
class Dataset:
    rows: DataFrame
    truth: DataFrame
    info: DataFrame


def generate(spark: SparkSession, kind: str, series: int = 1, n: int = 500, k: int = 3, seed: int = 0, change_points: list[int] | None = None, **options) -> Dataset:
    """Many series of one kind; options go to the kind's own function. Nothing is kept on the driver."""
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {', '.join(KINDS)}")
    make, pair = KINDS[kind], kind in ("regression", "glm")

    def draw(series_id: int):
        rng = np.random.default_rng(seed + series_id)
        cps = list(change_points) if change_points is not None else draw_change_points(n, k, rng)
        return cps, *make(rng, n, cps, **options)

    def rows(batches):
        for batch in batches:
            for i in batch["series_id"]:
                x = draw(int(i))[1]
                own = {"y": x[:, 0], "x": list(x[:, 1:])} if pair else {"v": list(x)}
                yield pd.DataFrame({"series_id": i, "t": np.arange(n), **own})

    def truth(batches):
        for batch in batches:
            yield pd.DataFrame([(i, c) for i in batch["series_id"] for c in draw(int(i))[0]], columns=["series_id", "cp"]).astype("int64")

    def info(batches):
        for batch in batches:
            yield pd.DataFrame([(i, {a: float(b) for a, b in draw(int(i))[2].items()}) for i in batch["series_id"]], columns=["series_id", "info"])

    ids = spark.range(series).withColumnRenamed("id", "series_id")
    return Dataset(ids.mapInPandas(rows, "series_id long, t long, y double, x array<double>" if pair else "series_id long, t long, v array<double>"), ids.mapInPandas(truth, "series_id long, cp long"), ids.mapInPandas(info, "series_id long, info map<string,double>"))


def annotation_noise(truth: DataFrame, keys: list[str], annotators: int = 3, keep: float = 0.9, jitter: float = 5.0, seed: int = 0) -> DataFrame:
    """(keys, annotator_id, cp): each annotator sees a point with probability ``keep``, some rows off, never below 0."""
    spread = truth.select(*keys, "cp", F.explode(F.sequence(F.lit(0), F.lit(annotators - 1))).alias("annotator_id"))
    unit = lambda salt: (F.pmod(F.xxhash64(*keys, "cp", "annotator_id", F.lit(seed), F.lit(salt)), F.lit(2**40)) + 0.5) / float(2**40)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * float(np.pi) * unit(2))
    return spread.filter(unit(0) < keep).select(*keys, "annotator_id", F.greatest(F.lit(0), F.round(F.col("cp") + normal * jitter)).cast("long").alias("cp")).distinct()
