"""Greedy one-to-one matching of true and predicted change points: nearest first, ties by position, no pair tables.

The greedy result is what repeated mutual choice gives: a pair that is the best of both its points, in the order of
(distance, true, predicted), is taken, its points leave, and the rest choose again. The best partner of a point is the
last or the next point of the other side, so each round is two ordered passes and never lists pairs. Most points leave in
the first rounds; once what is left is small, or rounds stop paying (points of one side before all of the other are
matched from the inside out, one pair a round), the rest is finished by a heap over neighbours, per island.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .series import cut

#: Points that are left to the heap at once; a round must take out more than this share of the points, or the heap goes on.
FEW, PAYS = 200_000, 0.1


def _taken(keys: list[str], margin: float | None):
    """The greedy pairs of one group: neighbours of different sides in a heap; when a pair leaves, its neighbours meet."""

    def take(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("cp", "ascending"), ("own", "ascending")])
        at, own = table.column("cp").to_pylist(), table.column("own").to_pylist()
        n = len(at)
        before, after, live = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n

        def offer(i: int, j: int):
            t, p = (i, j) if own[i] else (j, i)
            return at[j] - at[i], at[t], at[p], i, j

        near = lambda i, j: own[i] != own[j] and (margin is None or at[j] - at[i] <= margin)
        heap = [offer(i, i + 1) for i in range(n - 1) if near(i, i + 1)]
        heapq.heapify(heap)
        found = []
        while heap:
            distance, t, p, i, j = heapq.heappop(heap)
            if not (live[i] and live[j]):
                continue
            live[i] = live[j] = False
            found.append((t, p, distance))
            a, b = before[i], after[j]
            if a >= 0:
                after[a] = b
            if b < n:
                before[b] = a
            if a >= 0 and b < n and near(a, b):
                heapq.heappush(heap, offer(a, b))
        first = {k: table.schema.field(k).type for k in keys}
        out = np.array(found, np.int64).reshape(-1, 3)
        return pa.table({**{k: pa.array([v.as_py()] * len(out), first[k]) for k, v in zip(keys, key, strict=False)}, "true_cp": out[:, 0], "pred_cp": out[:, 1], "distance": out[:, 2]})

    return take


def _chosen(points: DataFrame, keys: list[str]) -> DataFrame:
    """``points`` (keys, cp, own) with ``best``, the nearest point of the other side (the smaller of two), and ``mutual``."""
    up = Window.partitionBy(*keys).orderBy("cp", "own")
    down = Window.partitionBy(*keys).orderBy(F.desc("cp"), F.desc("own"))
    passed = lambda own, w: F.last(F.when(F.col("own") == own, F.col("cp")), True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    sides = points.select("*", passed(True, up).alias("_tl"), passed(False, up).alias("_pl")).select("*", passed(True, down).alias("_tr"), passed(False, down).alias("_pr"))
    left, right = F.when(F.col("own"), F.col("_pl")).otherwise(F.col("_tl")), F.when(F.col("own"), F.col("_pr")).otherwise(F.col("_tr"))
    best = F.when(left.isNull(), right).when(right.isNull() | (F.col("cp") - left <= right - F.col("cp")), left).otherwise(right)
    held = sides.select(*keys, "cp", "own", best.alias("best"))
    # of two that choose each other no third stands between, so the partner is the row before or after
    other = lambda f: F.coalesce((f("best").over(up) == F.col("cp")) & (f("cp").over(up) == F.col("best")) & (f("own").over(up) != F.col("own")), F.lit(False))
    return held.withColumn("mutual", other(F.lag) | other(F.lead))


def closest_pairs(true: DataFrame, pred: DataFrame, keys: list[str], margin: float | None = None) -> DataFrame:
    """(keys, true_cp, pred_cp, distance): pairs taken nearest first, ties by the true and then the predicted position, each
    point once, until a side is used up or no pair within ``margin`` is left. Positions count once a side."""
    side = lambda df, own: df.select(*keys, F.col("cp").cast("long").alias("cp"), F.lit(own).alias("own"))
    points = side(true, True).union(side(pred, False)).distinct()
    parts, left = [], points.count()
    while left > FEW:
        chosen = cut(_chosen(points, keys), "chosen")
        near = F.col("best").isNotNull() if margin is None else F.abs(F.col("best") - F.col("cp")) <= margin
        parts.append(chosen.filter(F.col("mutual") & F.col("own") & near).select(*keys, F.col("cp").alias("true_cp"), F.col("best").alias("pred_cp"), F.abs(F.col("best") - F.col("cp")).alias("distance")))
        points = chosen.filter(~F.col("mutual") & near).select(*keys, "cp", "own")  # those without a partner never get one
        was, left = left, points.count()
        if left > (1 - PAYS) * was:
            break
    w = Window.partitionBy(*keys).orderBy("cp", "own")
    apart = F.coalesce(F.col("cp") - F.lag("cp").over(w) > margin, F.lit(True)) if margin is not None else F.row_number().over(w) == 1
    islands = points.withColumn("_new", apart.cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
    schema = ", ".join(f"`{k}` {points.schema[k].dataType.simpleString()}" for k in keys) + ", true_cp long, pred_cp long, distance long"
    rest = islands.groupBy(*keys, "_island").applyInArrow(_taken(keys, margin), schema)
    for part in parts:
        rest = rest.union(part)
    return rest
