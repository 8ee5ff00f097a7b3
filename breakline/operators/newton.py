"""Regressions of all segments at once by aggregated Newton steps.

A round is one grouped aggregate: every open segment's loss, gradient and Hessian at its trial coefficients are sums over
its rows. The small systems (one row for each segment) are solved in Arrow batches; no segment's rows meet in a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fits import RIDGE
from .series import cut

#: Segments up to which their coefficients are broadcast to the rows (a few numbers each).
BROADCAST_SEGMENTS = 100_000
#: Newton steps and shorter steps at most; a segment is done when its step or, relative to 1 + loss, its gain is this small.
ROUNDS, HALVINGS, STEP, GAIN = 60, 20, 1e-9, 1e-7


def predicted(family: str, x: list[Column], theta: Column) -> tuple[Column, Column]:
    """Linear predictor and mean; the intercept comes first in ``theta``."""
    u = theta[0]
    for k, c in enumerate(x):
        u = u + theta[k + 1] * c
    if family == "binomial":
        return u, 1 / (1 + F.exp(-F.greatest(F.least(u, F.lit(30.0)), F.lit(-30.0))))
    return u, F.exp(F.least(u, F.lit(20.0)))


def _loss(family: str, y: Column, u: Column, mu: Column) -> Column:
    if family == "binomial":
        return F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - y * u
    return F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) - (y - mu)


def _moved(d: int, first: int):
    """The next state of each segment from its sums at the trial: accepted if the loss fell, else a shorter step."""
    upper = np.triu_indices(d)

    def run(batches):
        for batch in batches:
            rows = batch.num_rows
            of = lambda c: np.array(batch.column(c).to_pylist(), float).reshape(rows, -1)  # noqa: E731, B023
            theta, trial, step, sums = of("theta"), of("trial"), of("step"), of("sums")
            loss, turn, halved = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("loss", "turn", "halved"))
            done = batch.column("done").to_numpy(zero_copy_only=False).copy()
            for k in np.flatnonzero(~done):
                new, g = sums[k, 0], sums[k, 1 : 1 + d]
                if np.isfinite(new) and new <= loss[k]:
                    h = np.zeros((d, d))
                    h[upper] = sums[k, 1 + d :]
                    h = h + np.triu(h, 1).T
                    gain, theta[k], loss[k], halved[k] = loss[k] - new, trial[k], new, 0
                    step[k] = np.linalg.solve(h + RIDGE * (1 + np.trace(h)) * np.eye(d), g)
                    done[k] = np.abs(step[k]).max() < STEP or gain < GAIN * (1 + new)
                else:
                    step[k], halved[k] = step[k] / 4, halved[k] + 1
                    done[k] = halved[k] >= HALVINGS
                turn[k] += 1
                done[k] |= turn[k] >= ROUNDS
                trial[k] = theta[k] + step[k]
            lists = lambda a: pa.array(a.tolist(), pa.list_(pa.float64()))
            keys = [batch.column(i) for i in range(first)]
            yield pa.RecordBatch.from_arrays([*keys, lists(theta), lists(trial), lists(step), pa.array(loss), pa.array(turn, pa.int32()), pa.array(halved, pa.int32()), pa.array(done)], [*batch.schema.names[:first], "theta", "trial", "step", "loss", "turn", "halved", "done"])

    return run


def glm_by_segment(rows: DataFrame, by: list[str], y: str, x: list[str], family: str) -> DataFrame:
    """(by, theta, loss): logit ("binomial") or log ("poisson") coefficients of each group of ``rows``, intercept first, and
    the negative log-likelihood. Groups whose classes are separated have no optimum: theirs stop when the loss no longer
    falls. ``rows`` should be a table that was written: it is read once a round, for the open groups only."""
    d = 1 + len(x)
    zero = F.array(*[F.lit(0.0)] * d)
    state = cut(rows.select(*by).distinct().select(*by, zero.alias("theta"), zero.alias("trial"), zero.alias("step"), F.lit(float("inf")).alias("loss"), F.lit(0).alias("turn"), F.lit(0).alias("halved"), F.lit(False).alias("done")), "state")
    few = state.count() <= BROADCAST_SEGMENTS
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in by)
    schema = f"{kinds}, theta array<double>, trial array<double>, step array<double>, loss double, turn int, halved int, done boolean"
    z, own = [F.lit(1.0), *[F.col(c).cast("double") for c in x]], F.col(y).cast("double")
    on = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    while not (open_ := state.filter("NOT done")).isEmpty():
        trials = open_.select(*by, "trial")
        joined = rows.alias("r").join((F.broadcast(trials) if few else trials).alias("s"), on("r", "s")).select(*[F.col(f"r.{k}") for k in by], own.alias("_y"), *[c.alias(f"_z{i}") for i, c in enumerate(z)], "trial")
        zs = [F.col(f"_z{i}") for i in range(d)]
        u, mu = predicted(family, zs[1:], F.col("trial"))
        w = mu * (1 - mu) if family == "binomial" else F.least(mu, F.lit(1e10))
        priced = joined.withColumns({"_l": _loss(family, F.col("_y"), u, mu), "_e": F.col("_y") - mu, "_w": w})
        sums = [F.sum("_l"), *[F.sum(c * F.col("_e")) for c in zs], *[F.sum(zs[i] * zs[j] * F.col("_w")) for i in range(d) for j in range(i, d)]]
        totals = priced.groupBy(*by).agg(F.array(*sums).alias("sums"))
        moved = state.alias("s").join(totals.alias("t"), on("s", "t"), "left").select(*[F.col(f"s.{k}") for k in by], "theta", "trial", "step", "loss", "turn", "halved", "done", F.coalesce("sums", F.array(*[F.lit(0.0)] * len(sums))).alias("sums"))
        state = cut(moved.mapInArrow(_moved(d, len(by)), schema), "state")
    return state.select(*by, "theta", "loss")
