"""Whitening of embeddings by cyclic Jacobi rotations of their covariance.

Three passes over the vectors, each a map over batches and a sum of one small matrix per task in two rounds: sums, the
scatter about the rounded mean (whole numbers, so no digits are lost to the vectors' large common offset), and the
covariance of what was whitened. The driver holds one matrix of dimension squared, rotates its off-diagonal entries
away pair by pair, and sends the whitening matrix back. Jacobi keeps small eigenvalues to their own relative accuracy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

COMPONENTS = 32
SCALE, OFFSET = 64, 1_000_000
#: Where a scaled entry is held, far beyond what embeddings have: sums of squares stay finite.
EDGE = 2.0**50
#: Groups in which the tasks' matrices are added up first, so that no group grows with the number of tasks.
SLOTS = 256


def remaining(vectors: DataFrame, column: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, v array<double>) of the vectors without null or non-finite entries, and their dimension: the length that
    most of them have (the larger of equals). Vectors of another length and empty ones are left out."""
    v = F.col(column).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & fine)
    sizes = rows.filter(F.size("v") > 0).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes["d"] if sizes else 0
    return rows.filter(F.size("v") == d) if d else rows.limit(0), d


def scaled(column: pa.Array, d: int) -> np.ndarray:
    """Rows of floor(64 c), as whole numbers in doubles."""
    return np.clip(np.floor(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d) * SCALE), -EDGE, EDGE)


def _sum(rows: pa.Table, keys: list[str]) -> pa.Table:
    values = rows.column("values").combine_chunks()
    total = values.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1).sum(0)
    return pa.table({**{k: rows.column(k)[:1] for k in keys}, "values": pa.array([total], values.type)})


def summed(parts: DataFrame, kind: str) -> dict[int, np.ndarray]:
    """Sums of ``parts`` (slot, line, values) by line: a matrix of as many lines, whatever the number of tasks."""
    first = parts.groupBy("slot", "line").applyInArrow(lambda t: _sum(t, ["slot", "line"]), f"slot int, line int, values array<{kind}>")
    last = first.groupBy("line").applyInArrow(lambda t: _sum(t, ["line"]), f"line int, values array<{kind}>")
    return {r.line: np.array(r["values"]) for r in last.collect()}


def _emit(lines: dict[int, np.ndarray], kind: pa.DataType) -> pa.RecordBatch:
    slot = TaskContext.get().partitionId() % SLOTS
    return pa.RecordBatch.from_arrays([pa.array([slot] * len(lines), pa.int32()), pa.array(list(lines), pa.int32()), pa.array([v.tolist() for v in lines.values()], pa.list_(kind))], ["slot", "line", "values"])


def _sums(batches, d):
    n, s = 0, np.zeros(d)
    for batch in batches:
        x = scaled(batch.column("v"), d)
        n, s = n + len(x), s + x.sum(0)  # whole numbers: exact below 2**53
    if n:
        yield _emit({0: np.r_[n, s].astype(np.int64)}, pa.int64())


def _scatter(batches, d, shift, weights=None):
    """Sums and products of the vectors about ``shift``, or of what ``weights`` make of them."""
    k = d if weights is None else weights.shape[1]
    total, product, any_ = np.zeros(k), np.zeros((k, k)), False
    for batch in batches:
        y = scaled(batch.column("v"), d) - shift
        y = y if weights is None else y @ weights
        total, product, any_ = total + y.sum(0), product + y.T @ y, any_ or len(y) > 0
    if any_:
        yield _emit({-1: total, **dict(enumerate(product))}, pa.float64())


def _covariance(lines: dict[int, np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance (divisor n) from sums and products about a point next to the mean."""
    mean = lines[-1] / n
    return mean, np.array([lines[i] for i in range(len(mean))]) / n - np.outer(mean, mean)


def jacobi(v: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix by cyclic Jacobi rotations.

    A pair is turned until its off-diagonal entry is below the last digit of its two diagonal entries' geometric mean.
    Of each eigenvector's two signs the one whose largest entry is positive.
    """
    a, q, d = (v + v.T) / 2, np.eye(len(v)), len(v)
    tiny = np.finfo(float).eps / 4
    for _ in range(sweeps):
        turned = False
        for i in range(d - 1):
            for j in range(i + 1, d):
                off = a[i, j]
                if off == 0 or abs(off) <= tiny * np.sqrt(abs(a[i, i])) * np.sqrt(abs(a[j, j])):
                    continue
                turned = True
                slope = (a[j, j] - a[i, i]) / (2 * off)
                t = (1.0 if slope >= 0 else -1.0) / (abs(slope) + np.hypot(1.0, slope))
                c = 1 / np.hypot(1.0, t)
                s = t * c
                for m in (a.T, a, q.T):  # columns, then rows of the matrix, then columns of the vectors
                    x, y = m[i].copy(), m[j].copy()
                    m[i], m[j] = c * x - s * y, s * x + c * y
                a[i, j] = a[j, i] = 0.0
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    e, q = e[order], q[:, order]
    q = q * np.where(q[np.abs(q).argmax(0), np.arange(d)] < 0, -1.0, 1.0)
    return e, q / np.linalg.norm(q, axis=0)


SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Sums of (n x - S)^2 in whole numbers; null where one does not fit a long."""
    top = float(np.abs(y).max(initial=0)) * n + max(map(abs, rest), default=0)
    if top * top * y.shape[1] < 2.0**62:
        own = n * y.astype(np.int64) - np.array(rest, np.int64)
        return (own * own).sum(1).tolist()
    exact = (sum((n * int(c) - r) ** 2 for c, r in zip(row, rest, strict=True)) for row in y.tolist())
    return [x if x < 2**63 else None for x in exact]


def _whitened(batches, d, n, shift, rest, weights, explained, error):
    k = weights.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):  # k rows for each vector
            part = batch.slice(at, 2000)
            y = scaled(part.column("v"), d) - shift
            rows = len(y)
            z = (y - np.array(rest) / n) @ weights
            deviation = np.array(_deviations(y, n, rest), object)
            ids = part.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, n), pa.int64()), pa.array(np.repeat(deviation, k).tolist(), pa.int64()), pa.array(z.ravel()), pa.array(np.tile(explained, rows)), pa.array(np.full(rows * k, error))], [c.split()[0] for c in SCHEMA.split(", ")])


def whiten(vectors: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """A row for each vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, empty or hold a null, NaN or infinite entry are left out, and so are those of another length
    than most. Entries become floor(64 c), plus an offset that no result depends on but ``x`` itself. Repeated rows and
    ids (null ones too) are rows of their own. A component without variance (fewer vectors than dimensions, or equal
    ones) is whitened to 0, explains 0 and stays out of ``identity_error``. ``deviation`` is null where it does not fit
    a long. Without vectors there are no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows, d = remaining(vectors, column)
    sums = summed(rows.mapInArrow(lambda b: _sums(b, d), "slot int, line int, values array<long>"), "long") if d else {}
    if not sums:
        return spark.createDataFrame([], SCHEMA)
    n, *total = (int(x) for x in sums[0])
    centre = [(2 * s + n) // (2 * n) for s in total]
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]  # S - n m: at most half of n
    shift = np.array(centre, float)
    mean, v = _covariance(summed(rows.mapInArrow(lambda b: _scatter(b, d, shift), "slot int, line int, values array<double>"), "double"), n)
    e, q = jacobi(v)
    k = min(components, d)
    own = e[:k] > max(e[0], 0.0) * d * np.finfo(float).eps
    weights = np.where(own, q[:, :k] / np.sqrt(np.where(own, e[:k], 1.0)), 0.0)
    explained = np.where(own, e[:k], 0.0) / (np.trace(v) or 1.0)
    shared = spark.sparkContext.broadcast(weights)  # dimension times components
    lines = summed(rows.mapInArrow(lambda b: _scatter(b, d, shift + np.array(rest) / n, shared.value), "slot int, line int, values array<double>"), "double")
    off = np.abs(_covariance(lines, n)[1] - np.eye(k))[np.ix_(own, own)]
    error = float(off.max(initial=0.0))
    return rows.mapInArrow(lambda b: _whitened(b, d, n, shift, rest, shared.value, explained, error), SCHEMA)


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
