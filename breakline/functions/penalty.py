"""Penalties: what one more change point must earn, as a number or as a Column."""

from __future__ import annotations

import math

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

CRITERIA = ("MBIC", "BIC", "MDL")
#: Families whose penalty is scaled by the noise variance, counts one parameter more in BIC, and takes log2 in MDL.
LINEAR = ("lm", "ar", "var")
NUMERIC_ONLY = ("rank", "rbf")


def parameters(family: str, d: int, order: tuple[int, int] = (0, 0), responses: int = 1) -> int:
    """Parameters of one segment. ``d``: value columns, or predictors of a regression."""
    p, q = order
    return {"mean": d, "variance": d * d, "meanvariance": d + d * d, "mgaussian": d + d * d, "lm": d * responses, "ar": p, "var": d * p * d, "arma": p + q + 1, "garch": p + q + 1}.get(family, d)


def penalty(criterion: str | float, p: int, n: int, family: str = "mean") -> float:
    """The penalty for a series of n rows; a number stands for itself."""
    if not isinstance(criterion, str):
        return float(criterion)
    if criterion not in CRITERIA:
        raise ValueError(f"beta must be a number or one of {', '.join(CRITERIA)}, not {criterion!r}")
    if family in NUMERIC_ONLY:
        raise ValueError(f"{family} takes a number for beta")
    log_n = math.log(n)
    if family in LINEAR:
        return {"MBIC": (p + 2) * log_n / 2, "BIC": (p + 1) * log_n / 2, "MDL": (p + 2) * math.log2(n) / 2}[criterion]
    return {"MBIC": (p + 2) * log_n / 2, "BIC": p * log_n / 2, "MDL": p * log_n / 2}[criterion]


def penalty_column(criterion: str, p: Column, n: Column, family: str = "mean") -> Column:
    """``penalty`` over columns."""
    if criterion not in CRITERIA:
        raise ValueError(f"unknown criterion {criterion!r}")
    extra = {"MBIC": 2, "BIC": 1 if family in LINEAR else 0, "MDL": 2 if family in LINEAR else 0}[criterion]
    log = F.log2(n) if criterion == "MDL" and family in LINEAR else F.log(n)
    return (p + extra) * log / 2


def adjustment(criterion: str | None, p: int, length):
    """What a segment's reported cost adds for its length: p ln L / 2 under MBIC and MDL, nothing else."""
    import numpy as np

    return p * np.log(length) / 2 if criterion in ("MBIC", "MDL") else 0.0 * np.asarray(length, float)


def vanilla(n: int, family: str) -> float:
    """Share of exact steps under 'auto': long regressions use sequential gradients, everything else is exact."""
    if family not in ("binomial", "poisson", "lasso") or n <= 200:
        return 1.0
    return 0.5 if n <= 500 else 0.0


def register(spark: SparkSession) -> None:
    """SQL functions penalty_mbic(p, n), penalty_bic(p, n) and penalty_mdl(p, n)."""
    for name, body in (("mbic", "(p + 2) * ln(n) / 2"), ("bic", "p * ln(n) / 2"), ("mdl", "p * ln(n) / 2")):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION penalty_{name}(p DOUBLE, n DOUBLE) RETURNS DOUBLE RETURN {body}")
