"""Change points of one giant series.

The recursion runs in parallel on overlapping chunks; what they propose is thinned by recursions over the proposals alone,
priced from prefix sums, in regions of 8 and of 64 chunks; at last each border moves to the best place near it. No task
holds more than a chunk's rows or 64 chunks' proposals.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import costs, penalty
from ..functions.partition import partition
from .detect import Spec, matrix
from .series import cut, first_diff, prefix_sums_global
from .small import regression_noise

FAMILIES = ("mean", "variance", "meanvariance", "lm")
#: Rows on either side of a border among which its best place is sought.
REACH = 50


def _price(family: str, d: dict, length, noise: float, log, greatest):
    """A segment's cost from differences of prefix sums, in numpy or as a column. Sums of a series are about its mean, so
    they lose no digits to a large level."""
    if family == "mean":
        return (d["vv"] - d["v"] * d["v"] / length) / (2 * noise) + log(length) / 2
    if family == "lm":
        return (d["yy"] - d["xy"] * d["xy"] / greatest(d["xx"], 1e-300)) / 2
    spread = d["vv"] if family == "variance" else d["vv"] - d["v"] * d["v"] / length
    return length / 2 * log(greatest(spread, costs.FLOOR) / length) + log(length) / 2


def detect_long(df: DataFrame, sort: str, value: str, x: str | None = None, family: str = "mean", chunk: int = 100_000, beta: float | None = None, trim: float = 0.0) -> DataFrame:
    """(cp): change points of one giant series in its mean, variance, both ("meanvariance"), or in the slope of ``value`` on
    ``x`` ("lm", no intercept), under MBIC unless ``beta`` is given.

    Approximate: a change point must be proposed by its chunk. ``sort`` must be unique. Against the exact recursion on
    series of 6,000 rows in 12 chunks, at least nine of ten points are found at their place (test). A series of fewer
    than two rows has none.
    """
    if family not in FAMILIES or (family == "lm") != (x is not None):
        raise ValueError(f"family must be one of {', '.join(FAMILIES)}, lm with x")
    spark = df.sparkSession
    df = cut(df.select(sort, value, *([x] if x else [])), "series")  # read for its mean, its ranges and its sums
    centre = 0.0 if family == "lm" else float(df.agg(F.avg(value)).first()[0] or 0.0)
    v = F.col(value).cast("double") - F.lit(centre)
    squares = {"v": v, "vv": v * v} if x is None else {"xx": F.col(x) * F.col(x), "xy": F.col(x) * v, "yy": v * v}
    own = df.select(sort, v.alias("_v"), *([F.col(x).cast("double").alias("_x")] if x else []), F.lit(1.0).alias("one"), *[c.cast("double").alias(k) for k, c in squares.items()])
    columns = ["_v"] if x is None else ["_v", "_x"]
    names = list(squares)
    sums = [f"s_{k}" for k in names]
    rows = cut(prefix_sums_global(own, [sort], ["one", *squares]).select((F.col("s_one") - 1).cast("long").alias("t"), *columns, *sums), "places")  # read many times
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "cp long")
    noise = _noise(rows, family, chunk)
    b = beta if beta is not None else penalty.penalty("MBIC", {"meanvariance": 2}.get(family, 1), n, family) * (noise if family == "lm" else 1.0)
    spec = Spec(family=family, beta=float(b), variance_estimate=((noise,),) if family == "mean" else None)
    least = {"mean": 1, "variance": 1, "meanvariance": 2, "lm": 2}[family]
    placed = rows.withColumn("c", F.floor(F.col("t") / chunk))
    both = placed.union(placed.filter(F.col("t") % chunk < chunk // 10).withColumn("c", F.col("c") - 1)).filter("c >= 0").select("c", "t", *columns)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        start = int(table.column("t").to_numpy().min())
        return pa.table({"cp": pa.array([start + c for c in spec.solve(matrix(table, columns))], pa.int64())})

    places = rows.select((F.col("t") + 1).alias("at"), *sums)  # sums of all rows before a place
    found = both.groupBy("c").applyInArrow(solve, "cp long").distinct()

    def thin(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        at = table.column("at").to_numpy()
        each = {k: table.column(f"s_{k}").to_numpy() for k in names}

        def cost(start, end):
            length = (at[end] - at[start]).astype(float)
            price = _price(family, {k: s[end] - s[start] for k, s in each.items()}, length, noise, np.log, np.maximum)
            return np.where(length < least, np.inf if family == "meanvariance" else 0.0, price)

        chosen = at[partition(len(at) - 1, b, cost, slack=lambda start, end: np.log(n) / 2 if family != "lm" else 0.0)]
        return pa.table({"cp": pa.array(chosen.astype(np.int64))})

    # regions of several chunks, then of many, choose again among what was proposed inside them; a region's borders
    # are no change points, so one proposed just there stays as it is
    for width in (8 * chunk, 64 * chunk):
        marked = cut(places.join(found.select(F.col("cp").alias("at")), "at", "left_semi"), "proposals")
        first = spark.createDataFrame([(0, *[0.0] * len(sums))], places.schema)
        borders = places.filter((F.col("at") % width == 0) | (F.col("at") == n)).union(first)
        region = F.floor((F.col("at") - 1) / width)
        inner = marked.filter((F.col("at") % width != 0) & (F.col("at") < n)).withColumn("g", region)
        ends = borders.withColumn("g", region).filter("at > 0").union(borders.filter(F.col("at") < n).withColumn("g", F.floor(F.col("at") / width)))
        chosen = inner.union(ends).groupBy("g").applyInArrow(thin, "cp long")
        found = chosen.union(marked.filter((F.col("at") % width == 0) & (F.col("at") < n)).select(F.col("at").alias("cp")))
        if width >= n:
            break
    moved = _moved(cut(found.distinct(), "found"), places, sums, family, noise, n, least)
    return moved.filter((F.col("cp") > trim * n) & (F.col("cp") < (1 - trim) * n)).distinct()


def _noise(rows: DataFrame, family: str, chunk: int) -> float:
    """Noise variance from differences, or from slopes of neighbouring blocks, inside runs of rows."""
    runs = rows.withColumn("c", F.floor(F.col("t") / chunk))
    if family == "mean":
        return runs.withColumn("d", first_diff("_v", ["c"])).agg(F.sum(F.col("d") * F.col("d")) / F.nullif(2.0 * F.count("d"), F.lit(0.0))).first()[0] or 1.0
    if family == "lm":
        each = regression_noise(runs, ["c"], "_v", ["_x"]).join(runs.groupBy("c").agg(F.count("*").alias("m")), "c")
        return each.agg(F.sum(F.col("noise") * F.col("m")) / F.sum("m")).first()[0] or 1.0
    return 1.0


def _moved(found: DataFrame, places: DataFrame, sums: list[str], family: str, noise: float, n: int, least: int) -> DataFrame:
    """Each border at the place near it, between its neighbours, where its two segments cost least (the first of equals)."""
    part = F.floor(F.col("cp") / 1_000_000)  # ranges of places: borders are few, and those of a range are one group
    w = Window.partitionBy("_p").orderBy("cp")
    marked = found.withColumn("_p", part)
    ends = marked.groupBy("_p").agg(F.min("cp").alias("lo"), F.max("cp").alias("hi"))
    order = Window.orderBy("_p")  # as many rows as ranges
    beside = ends.select("_p", F.lag("hi").over(order).alias("before"), F.lead("lo").over(order).alias("after"))
    near = marked.join(beside, "_p").select("cp", F.coalesce(F.lag("cp").over(w), "before", F.lit(0)).alias("a"), F.coalesce(F.lead("cp").over(w), "after", F.lit(n)).alias("b"))
    tried = near.select("*", F.explode(F.sequence(F.greatest(F.col("cp") - REACH, F.col("a") + least), F.greatest(F.least(F.col("cp") + REACH, F.col("b") - least), F.greatest(F.col("cp") - REACH, F.col("a") + least)))).alias("m"))
    zero = places.limit(1).select(F.lit(0).cast("long").alias("at"), *[F.lit(0.0).alias(s) for s in sums])
    every = places.union(zero)
    at = lambda df, c: df.join(every.select(F.col("at").alias(c), *[F.col(s).alias(f"{c}_{s}") for s in sums]), c)
    held = reduce(at, ("a", "b", "m"), tried)
    names = [s[2:] for s in sums]
    side = lambda lo, hi: _price(family, {k: F.col(f"{hi}_s_{k}") - F.col(f"{lo}_s_{k}") for k in names}, (F.col(hi) - F.col(lo)).cast("double"), noise, F.log, lambda c, f: F.greatest(c, F.lit(f)))
    best = held.filter("m > a AND m < b").withColumn("cost", side("a", "m") + side("m", "b")).groupBy("cp").agg(F.min_by("m", F.struct("cost", "m")).alias("m"))
    return found.join(best, "cp", "left").select(F.coalesce("m", "cp").cast("long").alias("cp"))
