"""Change-point detection over many series.

Spark indexes, lags, ranks and groups; the recursion runs once per series in a grouped Arrow task on the columns it
needs; trimming, merging and segments are window and join plans again. Series are independent, so the work spreads
over as many tasks as there are series. One series must fit a task; ``long.detect_long`` cuts a giant one.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import costs, penalty, sequential
from ..functions.partition import calibrate, partition, partition_blocks
from . import post
from .series import index, lags

MOMENTS = ("mean", "variance", "meanvariance")
REGRESSIONS = ("lm", "binomial", "poisson", "lasso")
AUTOREGRESSIVE = ("ar", "var")
FAMILIES = (*MOMENTS, *REGRESSIONS, *AUTOREGRESSIVE, "arma", "garch", "rank", "rbf", "mgaussian", "custom")


@dataclass(frozen=True)
class Spec:
    """What to detect, checked before any plan is built.

    ``pruning``: "exact" keeps every start that may still win, so the moment families' sums are least (unless rows are
    collinear to 1e-11 over long stretches, where a floor takes the determinant's place); "plain" is the rule without
    the allowance for length terms and widened segments, which can lose a better partition. ``pruning_coef`` is
    subtracted from the allowance. ``cost(rows)`` prices a segment of a custom family; with ``cost_gradient`` and
    ``cost_hessian`` (of a segment's last row) it is ``cost(rows, theta)`` of ``p`` parameters, found by sequential
    gradients. ``vanilla_percentage`` is the share of a regression's rows that are fitted exactly, before sequential
    gradients go on: 0 to 1, or "auto" (all up to 200 rows, half up to 500, none beyond). rbf without ``gamma`` takes its
    bandwidth from the median distance of at most ``bandwidth_rows`` rows, drawn beyond that. ``short``: how meanvariance prices one row of one column, "widen" or "floor" (see
    ``costs.Moment``).
    """

    family: str = "mean"
    beta: str | float = "MBIC"
    cost_adjustment: str | None = "MBIC"
    trim: float = 0.02
    order: tuple[int, ...] = ()
    vanilla_percentage: float | str = 0.0
    segment_count: int = 10
    pruning_coef: float = 0.0
    prune_delta: bool = False
    pruning: str = "exact"
    short: str = "widen"
    variance_estimate: tuple | None = None
    p: int | None = None
    p_response: int = 1
    lasso_alpha: float | None = None
    min_segment_length: int | None = None
    gamma: float | None = None
    feature_dim: int = 256
    bandwidth_rows: int = 10_000
    seed: int = 0
    target: int | None = None
    cost: object = field(default=None, compare=False)
    cost_gradient: object = field(default=None, compare=False)
    cost_hessian: object = field(default=None, compare=False)

    def __post_init__(self):
        if self.family not in FAMILIES:
            raise ValueError(f"unknown family {self.family!r}")
        if isinstance(self.beta, str) and self.beta not in penalty.CRITERIA:
            raise ValueError(f"beta must be a number or one of {', '.join(penalty.CRITERIA)}, not {self.beta!r}")
        if self.family in (*AUTOREGRESSIVE, "arma", "garch") and not self.order:
            raise ValueError(f"{self.family} needs an order")
        if self.family in ("arma", "garch") and len(self.order) != 2:
            raise ValueError(f"{self.family} needs an order (p, q)")
        if self.family == "custom" and self.cost is None:
            raise ValueError("a custom family needs a cost")
        if (self.cost_gradient is None) != (self.cost_hessian is None) or self.cost_gradient is not None and not self.p:
            raise ValueError("a gradient and a Hessian of a cost go together, with the number p of parameters")
        if self.pruning not in ("exact", "plain"):
            raise ValueError("pruning must be exact or plain")
        if self.short not in ("widen", "floor"):
            raise ValueError("short must be widen or floor")
        if not 0 <= self.trim < 0.5:
            raise ValueError("trim must be in [0, 0.5)")

    @property
    def lag(self) -> int:
        return self.order[0] if self.family in AUTOREGRESSIVE else 0

    def solve(self, x: np.ndarray) -> list[int]:
        """Change points of one series before trimming; x holds the response columns first."""
        n, d = x.shape
        if n < 2:
            return []
        if not np.isfinite(x).all():
            raise ValueError("a series holds a null, NaN or infinite value")
        run = self._runner(x)
        if self.target is not None:
            return calibrate(run, self.target)[1]
        return run(self._beta(x))

    def _beta(self, x: np.ndarray) -> float:
        n, d = x.shape
        if not isinstance(self.beta, str):
            return float(self.beta)
        if self.family in ("rank", "rbf", "custom") and self.cost_gradient is None:
            return 50.0
        responses = self._responses(d)
        pairs = tuple(self.order) + (0,) * (2 - len(self.order)) if self.order else (0, 0)
        predictors = d - responses
        k = self.p or {"lm": predictors * responses, "ar": self.lag, "var": predictors * responses}.get(self.family) or penalty.parameters(self.family, d if self.family in (*MOMENTS, "mgaussian") else predictors, pairs)
        beta = penalty.penalty(self.beta, k, n, self.family)
        if self.family in ("lm", "ar") and responses == 1:
            beta *= float(costs.noise(x[:, 0], x[:, 1:])[0, 0])
        if self.family == "lasso" and self._vanilla(n) < 1:
            beta *= 1 + sequential.lasso_noise(x[:, 0], x[:, 1:], self.segment_count)[1]
        return beta

    def _responses(self, d: int) -> int:
        if self.family == "var":
            return d // (1 + self.lag)
        return self.p_response if self.family in ("lm", "mgaussian") else 1

    def _vanilla(self, n: int) -> float:
        v = self.vanilla_percentage
        return penalty.vanilla(n, self.family) if v == "auto" else float(v)

    def _runner(self, x: np.ndarray):
        n, d = x.shape
        f, r = self.family, self._responses(d)
        if f in MOMENTS:
            cost = costs.Moment(x, f, self.cost_adjustment, None if self.variance_estimate is None else np.array(self.variance_estimate, float), self.short)
            exact = self.pruning == "exact"
            if exact and d == 1 and not self.pruning_coef:
                return lambda beta: partition_blocks(n, beta, cost, known=True)
            slack = lambda start, end: (cost.slack(start, end) if exact else 0.0) - self.pruning_coef
            return lambda beta: partition(n, beta, cost, slack=slack, known=True, least=cost.least if exact else 1)
        if f in ("lm", "ar", "var", "mgaussian"):
            y, z = (x[:, :r], x[:, r:]) if f != "mgaussian" or self.p_response < d else (x, np.ones((n, 1)))
            sigma = costs.noise(y, z) if f in ("var", "mgaussian") or r > 1 else None
            cost = costs.Linear(y, z, sigma)
            if self.pruning == "exact" and sigma is None and z.shape[1] == 1 and z.all():
                return lambda beta: partition_blocks(n, beta, cost)
            # short segments cost nothing, which is more than the others may cost once the noise has a determinant
            return lambda beta: partition(n, beta, cost, least=cost.p + 1 if sigma is not None and self.pruning == "exact" else 1)
        if f in ("binomial", "poisson"):
            if (v := self._vanilla(n)) < 1:
                delta = 0.1 * np.log(n) if self.prune_delta and n > 100 else 0.0
                return lambda beta: sequential.glm_partition(f, x[:, 0], x[:, 1:], beta, v, self.segment_count, delta)
            return lambda beta: partition(n, beta, costs.regression(f, x[:, 0], x[:, 1:]))
        if f == "lasso":
            sigma, _ = sequential.lasso_noise(x[:, 0], x[:, 1:], self.segment_count)
            if self._vanilla(n) < 1:
                return lambda beta: sequential.lasso_partition(x[:, 0], x[:, 1:], beta, sigma, self.segment_count)
            return lambda beta: partition(n, beta, costs.lasso(x[:, 0], x[:, 1:], sigma, self.lasso_alpha), first=2, newest=2)
        if f in ("arma", "garch"):
            make = costs.Arma if f == "arma" else costs.garch
            least = make(x[:, 0], *self.order, self.trim).least
            return lambda beta: partition(n, beta, make(x[:, 0], *self.order, self.trim), first=least)
        if f == "rank":
            cost = costs.Rank(x, self.min_segment_length)
            if self.pruning == "exact" and d == 1:
                return lambda beta: partition_blocks(n, beta, cost)
            return lambda beta: partition(n, beta, cost, least=cost.least if self.pruning == "exact" else 1)
        if f == "rbf":
            cost = costs.Kernel(x, self.gamma, self.feature_dim, self.seed, self.min_segment_length, self.bandwidth_rows)
            return lambda beta: partition(n, beta, cost, least=cost.least if self.pruning == "exact" else 1)
        if self.cost_gradient is not None:
            return lambda beta: sequential.custom_partition(x, self.cost, self.cost_gradient, self.cost_hessian, self.p, beta, self.segment_count)
        return lambda beta: partition(n, beta, costs.Custom(x, self.cost, self.min_segment_length or 1))


def matrix(table: pa.Table, columns: list[str]) -> np.ndarray:
    """Rows in order of t as doubles; array columns are laid side by side."""
    table = table.sort_by("t")
    parts = []
    for c in columns:
        column = table.column(c)
        if pa.types.is_list(column.type):
            parts.append(np.array(column.to_pylist(), float).reshape(table.num_rows, -1))
        else:
            parts.append(column.to_numpy(zero_copy_only=False).astype(float)[:, None])
    return np.concatenate(parts, 1)


@dataclass
class Detection:
    """Lazy results: nothing runs until a table is asked for, and each plan computes only what it shows."""

    rows: DataFrame
    keys: list[str]
    columns: list[str]
    spec: Spec
    fit: DataFrame

    @cached_property
    def sizes(self) -> DataFrame:
        return self.rows.groupBy(*self.keys).agg(F.count("*").alias("n"))

    @cached_property
    def raw_change_points(self) -> DataFrame:
        """(keys, cp) as the recursion found them."""
        s = self.spec
        found = self.fit.groupBy(*self.keys).applyInArrow(_kernel(self.keys, self.fit.columns, s), _schema(self.fit, self.keys))
        return post.shift(found, s.lag) if s.lag else found

    @cached_property
    def change_points(self) -> DataFrame:
        """(keys, cp) after trimming, merging and the least length."""
        s, keys = self.spec, self.keys
        found = post.shift(self.raw_change_points, -s.lag) if s.lag else self.raw_change_points
        sizes = self.sizes.withColumn("n", F.col("n") - s.lag)
        core = s.family in (*MOMENTS, "mgaussian")
        out = post.trim(found, sizes, keys, s.trim, closed=not core)
        out = post.merge_runs(out, sizes, keys, s.trim) if core else post.merge_pairs(out, sizes, keys, s.trim)
        if s.min_segment_length:
            out = post.min_length(out, sizes, keys, s.min_segment_length)
        return post.shift(out, s.lag) if s.lag else out

    @cached_property
    def segments(self) -> DataFrame:
        return post.segments(self.change_points, self.sizes, self.keys)

    @cached_property
    def labelled(self) -> DataFrame:
        return post.label(self.rows, self.segments, self.keys)

    def parameters(self) -> DataFrame:
        """(keys, seg_id, theta, cost): one fit per final segment."""
        from .segments import refit

        return refit(self)

    def residuals(self) -> DataFrame:
        """(keys, t, seg_id, residual)."""
        from .segments import residuals

        return residuals(self)

    def summary(self) -> DataFrame:
        """(keys, n_change_points, family)."""
        counts = self.change_points.groupBy(*self.keys).agg(F.count("*").alias("_c"))
        return self.sizes.join(counts, self.keys, "left").select(*self.keys, F.coalesce("_c", F.lit(0)).alias("n_change_points"), F.lit(self.spec.family).alias("family"))


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", cp long"


def _kernel(keys: list[str], columns: list[str], spec: Spec):
    values = [c for c in columns if c not in keys and c != "t"]

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        cps = spec.solve(matrix(table, values))
        names = [pa.array([k.as_py()] * len(cps), table.schema.field(c).type) for c, k in zip(keys, key, strict=True)]
        return pa.Table.from_arrays([*names, pa.array(cps, pa.int64())], [*keys, "cp"])

    return solve


def detect(df: DataFrame, series: str | list[str], sort: str | list[str], values: str | list[str], x: str | list[str] = (), **options) -> Detection:
    """Detect change points in every series of ``df``.

    ``values`` are the observed columns (or the response), ``x`` predictors; scalars or arrays. ``sort`` must be unique
    within a series. Options are those of ``Spec``. Nulls and NaNs raise when the plan runs.
    """
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    keys, sort, values, x = as_list(series), as_list(sort), as_list(values), as_list(x)
    spec = Spec(**options)
    rows = index(df.select(*dict.fromkeys([*keys, *sort, *values, *x])), keys, sort)
    columns = [*values, *x]
    if spec.family in AUTOREGRESSIVE:
        if spec.family == "ar" and len(values) != 1:
            raise ValueError("ar takes one value column")
        if spec.family == "var" and len(values) < 2:
            raise ValueError("var takes two value columns or more")
        lagged = lags(rows, keys, values, spec.lag)
        fit = lagged.select(*keys, "t", *values, *[f"{v}_lag{k}" for k in range(1, spec.lag + 1) for v in values])
    elif spec.family == "rank":
        from .series import ordinal_rank

        fit = rows.select(*keys, "t", *[ordinal_rank(v, keys).alias(v) for v in values])
    else:
        fit = rows.select(*keys, "t", *columns)
    return Detection(rows, keys, columns, spec, fit)


def _family(name: str):
    def run(df: DataFrame, series, sort, values, x=(), **options) -> Detection:
        return detect(df, series, sort, values, x, family=name, **options)

    run.__name__ = name
    run.__doc__ = f"``detect`` with the family {name}."
    return run


mean, variance, meanvariance = _family("mean"), _family("variance"), _family("meanvariance")
linear_regression, logistic_regression, poisson_regression, lasso = _family("lm"), _family("binomial"), _family("poisson"), _family("lasso")
ar, var, arma, garch, rank, rbf = _family("ar"), _family("var"), _family("arma"), _family("garch"), _family("rank"), _family("rbf")


def detect_grid(df: DataFrame, series, sort, values, betas: list[float], **options) -> DataFrame:
    """(keys, beta, cp): every series under every penalty; a series is indexed, dealt and prepared once."""
    as_list = lambda v: [v] if isinstance(v, str) else list(v)
    keys, sort, own = as_list(series), as_list(sort), as_list(values)
    specs = [Spec(beta=float(b), **options) for b in betas]
    rows = index(df.select(*dict.fromkeys([*keys, *sort, *own])), keys, sort)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table, own)
        found = [(s.beta, cp) for s in specs for cp in s.solve(x)]
        names = [pa.array([k.as_py()] * len(found), table.schema.field(c).type) for c, k in zip(keys, key, strict=True)]
        return pa.Table.from_arrays([*names, pa.array([b for b, _ in found], pa.float64()), pa.array([c for _, c in found], pa.int64())], [*keys, "beta", "cp"])

    return rows.select(*keys, "t", *own).groupBy(*keys).applyInArrow(solve, _schema(rows, keys).replace("cp long", "beta double, cp long"))
