"""Recursive filters over series of any length by an affine scan.

ARMA residuals and GARCH variances of given parameters are steps ``state -> A state + input``. A range of rows maps the
state before it to the state after it by one small matrix and one vector; these are composed over the ranges (one row
each), and every range is then filled by itself from the state that it begins with. Within a range, blocks are lanes of
an array that step side by side and are joined the same way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import cut


class Filter:
    """s_t = const + sum feed_k x_{t-k} (k from 0) + sum back_j s_{t-j} (j from 1); the state is the last s, then the last x."""

    def __init__(self, feed: list[float], back: list[float], const: float = 0.0):
        self.feed, self.back, self.const = np.array(feed, float), np.array(back, float), float(const)
        self.q, self.p = len(back), len(feed) - 1
        a = np.zeros((self.q + self.p, self.q + self.p))
        if self.q:
            a[0, : self.q], a[0, self.q :] = self.back, self.feed[1:]
            a[np.arange(1, self.q), np.arange(self.q - 1)] = 1
        if self.p > 1:
            a[np.arange(self.q + 1, self.q + self.p), np.arange(self.q, self.q + self.p - 1)] = 1
        self.step = a

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Output for inputs in order, and the state after them."""
        n, q, p = len(x), self.q, self.p
        past = np.concatenate([state[q:][::-1], x])
        drive = self.const + sum(f * past[p - k : p - k + n] for k, f in enumerate(self.feed))
        out = self._recursed(drive, state[:q]) if q else drive
        last = np.concatenate([state[:q][::-1], out])[::-1][:q]
        return out, np.concatenate([last, past[::-1][:p]])

    def _recursed(self, drive: np.ndarray, lags: np.ndarray) -> np.ndarray:
        n, q = len(drive), self.q
        turns = max(q, int(np.ceil(np.sqrt(n))))
        lanes = -(-n // turns)
        u = np.zeros((lanes, turns))
        u.ravel()[:n] = drive
        # all lanes from zero, and what each lag before a lane adds
        rows = np.zeros((turns + q, lanes + q))
        rows[:q, lanes:] = np.eye(q)[::-1]
        for t in range(turns):
            rows[q + t, :lanes] = u[:, t]
            for j in range(q):
                rows[q + t] += self.back[j] * rows[q + t - 1 - j]
        own, answer = rows[q:, :lanes], rows[q:, lanes:]
        out = np.empty((lanes, turns))
        for k in range(lanes):
            out[k] = own[:, k] + answer @ lags
            lags = np.concatenate([lags[::-1], out[k]])[::-1][:q]
        return out.ravel()[:n]


def _runs(batches):
    """(part, begins, first of its part, rows): sorted batches cut where a part or a series begins."""
    last = None
    for batch in batches:
        part, new = batch.column("_part").to_numpy(zero_copy_only=False), batch.column("_new").to_numpy(zero_copy_only=False)
        if not len(part):
            continue
        edges = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | new[1:]])
        for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(part)], strict=True):
            fresh_part = last != part[a]
            yield int(part[a]), bool(new[a]) or fresh_part, fresh_part, batch.slice(a, b - a)
            last = part[a]


def recursive_filter(df: DataFrame, keys: list[str], order: list[str], value: str, feed: list[float], back: list[float], const: float = 0.0, before: str | None = None, name: str = "s") -> DataFrame:
    """``df`` with ``name``: const + sum feed_k value_{t-k} + sum back_j s_{t-j} within each series (``keys``), by ``order``
    (unique). Values and outputs before a series' first row are column ``before`` (alike in all rows of a series), or 0.
    A null in ``value`` counts as NaN, and so does all that follows it."""
    f = Filter(feed, back, const)
    rows = df.withColumns({"_x": F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))), "_before": F.col(before).cast("double") if before else F.lit(0.0)})
    by = [*keys, *order]
    dealt = cut(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()), "ranges")
    if keys:
        w, own = Window.partitionBy("_part").orderBy(*by), F.struct(*keys)
        dealt = dealt.withColumn("_new", ~F.coalesce(F.lag(own).over(w).eqNullSafe(own), F.lit(True)))
        ends = dealt.groupBy("_part").agg(F.min(F.struct(*by)).alias("first"), F.max(F.struct(*by)).alias("last")).collect()  # a row for each range
    else:
        dealt = dealt.withColumn("_new", F.lit(False))
        ends = dealt.select("_part").distinct().collect()
    ordered = dealt.repartition("_part").sortWithinPartitions("_part", *by)

    def mapped(batches):
        """For each range, of its last series: whether it fills the range, its rows, and the state after them from zero (or
        from what stands before a series, where it begins inside)."""
        done: dict[int, list] = {}
        for part, new, first, rows_ in _runs(batches):
            x = rows_.column("_x").to_numpy()
            if new:
                filled = np.full(f.q + f.p, rows_.column("_before")[0].as_py())
                done[part] = [first, 0, np.zeros(f.q + f.p) if first else filled, filled[:1]]
            state = done[part]
            state[2], state[1] = f.run(x, state[2])[1], state[1] + len(x)
        yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([d[0] for d in done.values()], pa.bool_()), pa.array([d[1] for d in done.values()], pa.int64()), pa.array([d[2].tolist() for d in done.values()], pa.list_(pa.float64())), pa.array([float(d[3][0]) if len(d[3]) else 0.0 for d in done.values()], pa.float64())], ["part", "whole", "n", "state", "before"])

    maps = {r.part: r for r in ordered.select("_part", "_new", "_x", "_before").mapInArrow(mapped, "part int, whole boolean, n long, state array<double>, before double").collect()}
    begins, after, last = {}, None, None
    for e in sorted(ends, key=lambda e: e["_part"]):
        m = maps[e["_part"]]
        same = after is not None and (not keys or e["first"][: len(keys)] == last[: len(keys)])
        begins[e["_part"]] = after if same else None
        into = after if same else np.full(f.q + f.p, m.before)
        after = np.array(m.state) + (np.linalg.matrix_power(f.step, m.n) @ into if m.whole else 0.0)
        last = e["last"] if keys else None
    shared = df.sparkSession.sparkContext.broadcast(begins)  # a few numbers for each range

    def filled(batches):
        state = None
        for part, new, first, rows_ in _runs(batches):
            if new:
                known = shared.value[part] if first else None
                state = np.full(f.q + f.p, rows_.column("_before")[0].as_py()) if known is None else known
            out, state = f.run(rows_.column("_x").to_numpy(), state)
            kept = rows_.select([c for c in rows_.schema.names if c not in ("_x", "_before", "_part", "_new")])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(out)], [*kept.schema.names, name])

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns)
    return ordered.mapInArrow(filled, f"{kinds}, `{name}` double")


def arma_residuals(df: DataFrame, keys: list[str], order: list[str], value: str, ar: list[float], ma: list[float], name: str = "residual") -> DataFrame:
    """Conditional residuals of an ARMA model of given parameters; values and residuals before a series are 0."""
    return recursive_filter(df, keys, order, value, [1.0, *[-a for a in ar]], [-m for m in ma], name=name)


def garch_variances(df: DataFrame, keys: list[str], order: list[str], value: str, omega: float, alpha: list[float], beta: list[float], name: str = "variance") -> DataFrame:
    """Conditional variances of a GARCH model of given parameters; before a series stands its mean square."""
    if keys:
        means = df.groupBy(*keys).agg(F.avg(F.col(value) * F.col(value)).alias("_mean"))
        rows = df.join(means.withColumnsRenamed({k: f"_k_{k}" for k in keys}), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]).select(*df.columns, "_mean")
    else:
        rows = df.withColumn("_mean", F.lit(float(df.agg(F.avg(F.col(value) * F.col(value))).first()[0] or 0.0)))
    squared = rows.withColumn("_square", F.col(value) * F.col(value))
    return recursive_filter(squared, keys, order, "_square", [0.0, *alpha], beta, omega, "_mean", name).drop("_square", "_mean")
