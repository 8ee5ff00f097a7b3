"""Small matrices as columns: one row of sums for each series or window, solved by expressions or in Arrow batches."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import costs, fits
from .series import over, presegment, rice_covariance

Matrix = list[list[Column]]

#: Rows of a series whose neighbouring blocks are made in one task.
RUN = 100_000


def determinant(m: Matrix) -> Column:
    if len(m) == 1:
        return m[0][0]
    signed = [m[0][j] * determinant([[*r[:j], *r[j + 1 :]] for r in m[1:]]) * (-1 if j % 2 else 1) for j in range(len(m))]
    return sum(signed[1:], signed[0])


def inverse(m: Matrix) -> Matrix:
    """By cofactors: for a few columns. A singular matrix gives infinities or nulls."""
    size, det = len(m), F.nullif(determinant(m), F.lit(0.0))
    if size == 1:
        return [[1 / det]]
    minor = lambda i, j: determinant([[*r[:j], *r[j + 1 :]] for k, r in enumerate(m) if k != i])
    return [[minor(j, i) * (-1 if (i + j) % 2 else 1) / det for j in range(size)] for i in range(size)]


def regression_noise(df: DataFrame, keys: list[str], y: str, x: list[str], at: str = "t") -> DataFrame:
    """(keys, noise): noise variance of a regression of ``y`` on ``x`` without intercept, from the slopes of neighbouring
    blocks of p + 1 rows that slide by one: their squared distance over what unit noise would make of it, on average.

    Grams of blocks are sums over frames of a series' rows, the next block's are the next row's; the systems of p columns
    are solved as expressions. Blocks without a unique slope are left out; a series with none has noise 1. ``at`` counts a
    series' rows one by one, as ``index`` does: runs of rows are tasks of their own, each with the next run's first p + 1 rows.
    """
    p, w = len(x), over([*keys, "_run"], at)
    frame = lambda a, b: w.rowsBetween(a, b)
    flat = {**{f"_g{i}{j}": F.col(x[i]) * F.col(x[j]) for i in range(p) for j in range(i, p)}, **{f"_c{i}": F.col(x[i]) * F.col(y) for i in range(p)}}
    own = F.floor(F.col(at) / RUN)
    runs = F.explode(F.when(F.col(at) % RUN <= p, F.array(own, own - 1)).otherwise(F.array(own))).alias("_run")
    rows = df.select(*keys, at, *[v.cast("double").alias(k) for k, v in flat.items()], runs)
    sums = rows.select(*keys, "_run", at, *[F.sum(c).over(frame(0, p)).alias(f"a{c}") for c in flat], *[F.sum(c).over(frame(1, p)).alias(f"m{c}") for c in flat if c.startswith("_g")], F.lead(at, p + 1).over(w).alias("_full"))
    both = sums.select("*", *[F.lead(f"a{c}").over(w).alias(f"b{c}") for c in flat]).filter("_full IS NOT NULL")
    gram = lambda s: [[F.col(f"{s}_g{min(i, j)}{max(i, j)}") for j in range(p)] for i in range(p)]
    for s in "ab":  # inverses and slopes are columns of their own, so that they are computed once
        own = inverse(gram(s))
        both = both.withColumns({f"{s}i{i}{j}": own[i][j] for i in range(p) for j in range(p)})
        both = both.withColumns({f"{s}s{i}": sum((F.col(f"{s}i{i}{j}") * F.col(f"{s}_c{j}") for j in range(p)), F.lit(0.0)) for i in range(p)})
    middle = gram("m")
    crossed = sum((F.col(f"ai{i}{j}") * middle[j][k] * F.col(f"bi{k}{i}") for i, j, k in product(range(p), repeat=3)), F.lit(0.0))
    between = sum((F.col(f"ai{i}{i}") + F.col(f"bi{i}{i}") for i in range(p)), F.lit(0.0)) - 2 * crossed
    apart = sum(((F.col(f"as{i}") - F.col(f"bs{i}")) * (F.col(f"as{i}") - F.col(f"bs{i}")) for i in range(p)), F.lit(0.0))
    each = both.select(*keys, (apart / F.nullif(between, F.lit(0.0))).alias("_e")).filter("_e IS NOT NULL AND NOT isnan(_e) AND abs(_e) < double('infinity')")
    found = each.groupBy(*keys).agg(F.avg("_e").alias("noise")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    return df.select(*keys).distinct().join(found, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left").select(*keys, F.coalesce("noise", F.lit(1.0)).alias("noise"))


def _factors(d: int):
    """Factor L of the inverse covariance (x L is white), the covariance repaired until it is positive definite."""

    def run(batches):
        for batch in batches:
            numbers = ([np.nan if v is None else v for v in flat] for flat in batch.column("_s").to_pylist())
            out = [np.linalg.cholesky(np.linalg.inv(costs.repaired(np.array(v, float).reshape(d, d)))).ravel().tolist() for v in numbers]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "_l"])

    return run


def whiten_columns(df: DataFrame, keys: list[str], values: list[str], at: str = "t") -> DataFrame:
    """``df`` with z_<v> for each of ``values``: the columns over their series' noise covariance from first differences.

    The covariance (one small row for each series) is repaired by growing jitter until it is positive definite; a series
    of one row has the identity. Its factor is joined back and applied by expressions.
    """
    d = len(values)
    noise = rice_covariance(df, keys, values, at)
    flat = noise.select(*keys, F.array(*[F.col(f"c_{a}_{b}") for a, b in product(values, values)]).alias("_s"))
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    factors = flat.mapInArrow(_factors(d), f"{kinds}, _l array<double>").withColumnsRenamed({k: f"_k_{k}" for k in keys})
    joined = df.join(factors, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    z = [sum((F.col(v) * F.col("_l")[i * d + j] for i, v in enumerate(values)), F.lit(0.0)).alias(f"z_{values[j]}") for j in range(d)]
    return joined.select(*df.columns, *z)


FOLDS, ALPHAS = 5, 20


def _cross_validated(p: int):
    """Noise and number of active predictors of a bucket from its folds' Gram matrices alone."""
    upper = np.triu_indices(p)

    def one(folds: dict[int, np.ndarray]) -> tuple[float, float]:
        def parts(v):
            g = np.zeros((p, p))
            g[upper] = v[2 + p :]
            return g + np.triu(g, 1).T, v[2 : 2 + p], v[1], v[0]

        whole = parts(sum(folds.values()))
        if whole[3] <= p:
            return 0.0, 0.0
        top = np.abs(whole[1]).max() / max(1.0, whole[3])
        if not top:
            return float(np.sqrt(whole[2] / whole[3])), 0.0
        alphas, errors = top * np.logspace(0, -3, ALPHAS), np.zeros(ALPHAS)
        for f in range(FOLDS):
            out = parts(folds.get(f, np.zeros_like(next(iter(folds.values())))))
            g, c, _, n = parts(sum(folds.values()) - folds[f]) if f in folds else whole
            theta = None
            for k, a in enumerate(alphas):
                theta = fits.lasso_gram(g, c, n, a, theta, 200, 1e-4)
                errors[k] += out[2] - 2 * out[1] @ theta + theta @ out[0] @ theta
        theta = fits.lasso_gram(whole[0], whole[1], whole[3], float(alphas[int(errors.argmin())]))
        rss = max(0.0, whole[2] - 2 * whole[1] @ theta + theta @ whole[0] @ theta)
        return float(np.sqrt(rss / whole[3])), float((theta != 0).sum())

    def run(batches):
        for batch in batches:
            found = [one({e["fold"]: np.array(e["sums"]) for e in own}) for own in batch.column("folds").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([s for s, _ in found], pa.float64()), pa.array([a for _, a in found], pa.float64())], [*batch.schema.names[:-1], "sigma", "active"])

    return run


def lasso_noise(df: DataFrame, keys: list[str], y: str, x: list[str], count: int = 10, at: str = "t") -> DataFrame:
    """(keys, sigma, active): mean noise and mean number of active predictors of the cross-validated lasso fits of a series'
    ``count`` buckets. Rows become sums per (series, bucket, fold); a bucket of p rows or fewer counts as 0."""
    p = len(x)
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_n")).withColumnsRenamed({k: f"_k_{k}" for k in keys})
    rows = df.join(sizes, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    bucket = presegment(F.col("_n"), F.col(at), count)
    length = F.greatest(F.floor(F.col("_n") / count), F.lit(1))
    first = F.when(F.col("_n") < count, F.lit(0)).otherwise(bucket * length)
    own = F.when(F.col("_n") < count, F.col("_n")).when(bucket == count - 1, F.col("_n") - (count - 1) * length).otherwise(length)
    fold = F.floor((F.col(at) - first) * FOLDS / own).cast("int")
    v = [F.col(c).cast("double") for c in x]
    t = F.col(y).cast("double")
    sums = F.array(F.count("*").cast("double"), F.sum(t * t), *[F.sum(c * t) for c in v], *[F.sum(v[i] * v[j]) for i in range(p) for j in range(i, p)])
    grams = rows.groupBy(*keys, bucket.alias("_bucket"), fold.alias("fold")).agg(sums.alias("sums"))
    folded = grams.groupBy(*keys, "_bucket").agg(F.collect_list(F.struct("fold", "sums")).alias("folds"))  # five small rows
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    each = folded.mapInArrow(_cross_validated(p), f"{kinds}, _bucket int, sigma double, active double")
    return each.groupBy(*keys).agg((F.sum("sigma") / count).alias("sigma"), (F.sum("active") / count).alias("active"))
