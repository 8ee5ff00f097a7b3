"""Per-segment parameters, costs and residuals: aggregates by segment, joined back; fits only where no sum will do."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import costs, fits
from ..functions.penalty import adjustment


def segment_moments(labelled: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, seg_id, length, mean_<v>, cov_<a>_<b>): averages and sample covariances of each segment."""
    stats = [F.avg(v).alias(f"mean_{v}") for v in values] + [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in product(values, values)]
    return labelled.groupBy(*keys, "seg_id").agg(F.count("*").alias("length"), *stats)


def segment_costs(labelled: DataFrame, keys: list[str], value: str, kind: str, sizes: DataFrame | None = None) -> DataFrame:
    """(keys, seg_id, cost) of one value column from sums alone. mean: of the whitened value; variance: about the
    series' mean, which ``labelled`` must hold as ``centre``."""
    n, v = F.count("*"), F.col(value)
    if kind == "mean":
        cost = (F.sum(v * v) - F.sum(v) * F.sum(v) / n) / 2
    elif kind == "variance":
        cost = n / 2 * F.log(F.greatest(F.sum((v - F.col("centre")) * (v - F.col("centre"))), F.lit(costs.FLOOR)) / n)
    else:
        cost = n / 2 * F.log(F.greatest(F.var_pop(v), F.lit(costs.FLOOR)))
    return labelled.groupBy(*keys, "seg_id").agg(cost.alias("cost"))


def segment_energy(labelled: DataFrame, keys: list[str], value: str) -> DataFrame:
    return labelled.groupBy(*keys, "seg_id").agg(F.avg(F.col(value) * F.col(value)).alias("energy"))


def ols_one(labelled: DataFrame, keys: list[str], y: str, x: str) -> DataFrame:
    """(keys, seg_id, slope, rss): one predictor, no intercept, from three sums."""
    sums = labelled.groupBy(*keys, "seg_id").agg(F.sum(F.col(x) * F.col(x)).alias("xx"), F.sum(F.col(x) * F.col(y)).alias("xy"), F.sum(F.col(y) * F.col(y)).alias("yy"))
    return sums.select(*keys, "seg_id", (F.col("xy") / F.col("xx")).alias("slope"), (F.col("yy") - F.col("xy") * F.col("xy") / F.col("xx")).alias("rss"))


def _one(family: str, x: np.ndarray, spec) -> tuple[list[float], float, np.ndarray]:
    """Parameters, cost and residuals of one segment."""
    n, d = x.shape
    if family in ("binomial", "poisson"):
        z = np.column_stack([np.ones(n), x[:, 1:]])
        theta, loss = fits.glm(family, z, x[:, 0])
        u = np.clip(z @ theta, -30, 30)
        return theta.tolist(), loss, x[:, 0] - (1 / (1 + np.exp(-u)) if family == "binomial" else np.exp(u))
    if family in ("arma", "garch"):
        p, q = spec.order
        if family == "arma":
            theta = fits.arma(x[:, 0], p, q)
            e = fits.arma_residuals(x[:, 0][None], theta[None, :p], theta[None, p : p + q])[0]
            return theta.tolist(), fits.arma_loss(x[:, 0], theta, p, q), e
        theta, loss = fits.garch(x[:, 0], p, q)
        return theta.tolist(), loss, x[:, 0] / np.sqrt(fits.garch_variances(x[:, 0] ** 2, theta[None], p, q)[0])
    if family == "lasso":
        alpha = spec.lasso_alpha
        theta = fits.lasso(x[:, 1:], x[:, 0], alpha) if alpha is not None else fits.lasso_cv(x[:, 1:], x[:, 0])[1]
        e = x[:, 0] - x[:, 1:] @ theta
        return theta.tolist(), float((e * e).sum() / 2), e
    r = spec._responses(d)
    theta = np.linalg.lstsq(x[:, r:], x[:, :r], rcond=None)[0]
    e = x[:, :r] - x[:, r:] @ theta
    return theta.T.ravel().tolist(), float((e * e).sum() / 2), e[:, 0] if r == 1 else np.sqrt((e * e).sum(1))


def _fit_rows(d) -> DataFrame:
    """Rows that a segment's fit reads, with their segment."""
    from . import post

    lag = d.spec.lag
    if not lag:
        return post.label(d.fit, d.segments, d.keys)
    segs = post.segments(post.shift(d.change_points, -lag), d.sizes.withColumn("n", F.col("n") - lag), d.keys)
    return post.label(d.fit.withColumn("t", F.col("t") - lag), segs, d.keys)


def _moments(d) -> DataFrame:
    """(keys, seg_id, theta, cost) of the moment families in several columns: sums of each segment beside its series' noise
    or mean, one small row each, priced as the recursion prices it."""
    keys, spec, v = d.keys, d.spec, [F.col(c).cast("double") for c in d.columns]
    p, family, adjust = len(v), spec.family, spec.cost_adjustment
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = d.labelled.groupBy(*keys, "seg_id").agg(F.array(F.count("*").cast("double"), *[F.sum(c) for c in v], *[F.sum(v[i] * v[j]) for i, j in pairs]).alias("_sums"))
    if family == "mean" and spec.variance_estimate is None:
        from .series import rice_covariance

        noise = rice_covariance(d.rows, keys, d.columns)
        whole = noise.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.array(*[F.col(f"c_{a}_{b}") for a, b in product(d.columns, d.columns)]).alias("_whole"))
    else:
        whole = d.rows.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.array(*[F.avg(c) for c in v]).alias("_whole"))
    joined = sums.join(whole, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).select(*keys, "seg_id", "_sums", "_whole")
    given = None if spec.variance_estimate is None else np.atleast_2d(np.array(spec.variance_estimate, float))
    upper = np.triu_indices(p)
    count = {"mean": p, "variance": p * p, "meanvariance": p + p * p}[family]

    def one(own: np.ndarray, whole: np.ndarray) -> tuple[list[float], float]:
        n, s = own[0], own[1 : 1 + p]
        q = np.zeros((p, p))
        q[upper] = own[1 + p :]
        q = q + np.triu(q, 1).T
        about = (q - np.outer(s, s) / n) / max(n - 1, 1) if n > 1 else np.zeros((p, p))
        theta = {"mean": s / n, "variance": about.ravel(), "meanvariance": np.r_[s / n, about.ravel()]}[family]
        if family == "mean":
            inverse = np.linalg.inv(given if given is not None else costs.repaired(whole.reshape(p, p)))
            raw = (np.sum(inverse * q) - s @ inverse @ s / n) / 2
        else:
            m = q - np.outer(s, s) / n if family == "meanvariance" else q - np.outer(s, whole) - np.outer(whole, s) + n * np.outer(whole, whole)
            raw = n / 2 * np.log(max(np.linalg.det(m / n), costs.FLOOR))
        return theta.tolist(), float((raw + adjustment(adjust, count, n)) * (np.log2(np.e) if adjust == "MDL" else 1.0))

    def priced(batches):
        for batch in batches:
            numbers = lambda c: [np.array([np.nan if x is None else x for x in r], float) for r in batch.column(c).to_pylist()]  # noqa: E731, B023
            found = [one(a, b) for a, b in zip(numbers("_sums"), numbers("_whole"), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array([t for t, _ in found], pa.list_(pa.float64())), pa.array([c for _, c in found], pa.float64())], [*batch.schema.names[:-2], "theta", "cost"])

    kinds = ", ".join(f"`{k}` {d.rows.schema[k].dataType.simpleString()}" for k in keys)
    return joined.mapInArrow(priced, f"{kinds}, seg_id int, theta array<double>, cost double")


def _aggregated(d, values: list[str]) -> bool:
    """Whether the segments' fits are Newton steps over sums: logit and log models of scalar columns."""
    return d.spec.family in ("binomial", "poisson") and not any(d.fit.schema[v].dataType.typeName() == "array" for v in values)


def _glm_rows(d, values: list[str]) -> DataFrame:
    """The labelled rows, written once for the rounds."""
    from .series import cut

    if not hasattr(d, "_written"):
        d._written = cut(_fit_rows(d).select(*d.keys, "t", "seg_id", *values), "rows")
    return d._written


def _glm(d, values: list[str]) -> DataFrame:
    """(keys, seg_id, theta, loss) of every segment."""
    from .newton import glm_by_segment

    if not hasattr(d, "_fits"):
        d._fits = glm_by_segment(_glm_rows(d, values), [*d.keys, "seg_id"], values[0], values[1:], d.spec.family)
    return d._fits


def refit(d) -> DataFrame:
    """(keys, seg_id, theta, cost): aggregates for the moment families, one grouped fit per segment for the rest."""
    from .detect import MOMENTS, matrix

    keys, spec, family = d.keys, d.spec, d.spec.family
    if family in MOMENTS and len(d.columns) == 1:
        v = d.columns[0]
        rows = d.labelled
        if family == "variance":
            rows = rows.join(d.rows.groupBy(*keys).agg(F.avg(v).alias("centre")), keys)
        if family == "mean":
            from .series import rice_variance

            rows = rows.join(rice_variance(d.rows, keys, v), keys) if spec.variance_estimate is None else rows.withColumn("rice_variance", F.lit(float(np.ravel(spec.variance_estimate)[0])))
            rows = rows.withColumn("_z", F.col(v) / F.sqrt("rice_variance"))
        cost = segment_costs(rows, keys, "_z" if family == "mean" else v, family)
        stats = rows.groupBy(*keys, "seg_id").agg(F.count("*").alias("length"), F.avg(v).alias("m"), F.var_samp(v).alias("s"))
        theta = {"mean": F.array("m"), "variance": F.array("s"), "meanvariance": F.array("m", "s")}[family]
        p = 2 if family == "meanvariance" else 1
        extra = p * F.log("length") / 2 if spec.cost_adjustment in ("MBIC", "MDL") else F.lit(0.0)
        scale = F.lit(float(np.log2(np.e))) if spec.cost_adjustment == "MDL" else F.lit(1.0)
        return stats.join(cost, [*keys, "seg_id"]).select(*keys, "seg_id", theta.alias("theta"), ((F.col("cost") + extra) * scale).alias("cost"))
    values = [c for c in d.fit.columns if c not in keys and c != "t"]
    scalars = not any(d.fit.schema[c].dataType.typeName() == "array" for c in values)
    if family in MOMENTS and scalars:
        return _moments(d)
    rows = _fit_rows(d)
    if _aggregated(d, values):
        return _glm(d, values).withColumnRenamed("loss", "cost")
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", seg_id int, theta array<double>, cost double"

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table, values)
        if family in MOMENTS:
            theta = {"mean": x.mean(0), "variance": np.atleast_2d(np.cov(x.T)).ravel() if len(x) > 1 else np.zeros(x.shape[1] ** 2)}
            theta = theta[family] if family in theta else np.r_[x.mean(0), theta["variance"]]
            cost = costs.Moment(x, family, None)
            theta, value = theta.tolist(), float(cost.raw(np.array([0]), len(x))[0] + adjustment(spec.cost_adjustment, cost.p, len(x)))
        elif family in ("rank", "rbf", "custom"):
            theta, value = x.mean(0).tolist(), float(spec.cost(x)) if family == "custom" else float("nan")
        else:
            theta, value, _ = _one(family, x, spec)
        named = [pa.array([k.as_py()], table.schema.field(c).type) for c, k in zip(keys, key, strict=False)]
        return pa.Table.from_arrays([*named, pa.array([key[-1].as_py()], pa.int32()), pa.array([theta], pa.list_(pa.float64())), pa.array([value], pa.float64())], [*keys, "seg_id", "theta", "cost"])

    return rows.groupBy(*keys, "seg_id").applyInArrow(fit, schema)


def residuals(d) -> DataFrame:
    """(keys, t, seg_id, residual): about the mean, over the deviation, or what a segment's fit leaves."""
    from .detect import MOMENTS, matrix

    keys, spec, family = d.keys, d.spec, d.spec.family
    if family in MOMENTS and len(d.columns) == 1:
        from pyspark.sql import Window

        v, w = F.col(d.columns[0]), Window.partitionBy(*keys, "seg_id")
        centred, spread = v - F.avg(v).over(w), F.stddev_samp(v).over(w)
        out = {"mean": centred, "variance": v / spread, "meanvariance": centred / spread}[family]
        return d.labelled.select(*keys, "t", "seg_id", out.alias("residual"))
    rows = _fit_rows(d)
    values = [c for c in d.fit.columns if c not in keys and c != "t"]
    if _aggregated(d, values):
        from .newton import predicted

        fitted = _glm(d, values).alias("f")
        joined = _glm_rows(d, values).alias("r").join(fitted, [F.col(f"r.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*keys, "seg_id"]])
        mean = predicted(family, [F.col(f"r.{c}").cast("double") for c in values[1:]], F.col("theta"))[1]
        return joined.select(*[F.col(f"r.{k}") for k in keys], "r.t", "r.seg_id", (F.col(f"r.{values[0]}").cast("double") - mean).alias("residual"))
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", t long, seg_id int, residual double"

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        x = matrix(table, values)
        if family in (*MOMENTS, "rank", "rbf", "custom"):
            e = np.sqrt(((x - x.mean(0)) ** 2).sum(1))
        else:
            e = _one(family, x, spec)[2]
        out = [table.column(k) for k in keys] + [pa.array(table.column("t").to_numpy() + spec.lag, pa.int64()), table.column("seg_id"), pa.array(e, pa.float64())]
        return pa.Table.from_arrays(out, [*keys, "t", "seg_id", "residual"])

    return rows.groupBy(*keys, "seg_id").applyInArrow(fit, schema)
