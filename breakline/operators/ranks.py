"""Ranks and order statistics of series of any length, without a window over a whole series.

Everything rests on ``prefix_sums_global``: rows are dealt by ranges of an order, each range is summed by itself, and the
ranges' totals are added on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import cut, prefix_sums_global

#: Parts that an interval of distances is cut into in each round, and pairs of distinct values for each distinct value
#: at which an interval is listed instead of being cut on.
PARTS, LISTED = 16, 64


def ordinal_rank_long(df: DataFrame, value: str, order: list[str], keys: list[str] = (), name: str = "rank") -> DataFrame:
    """``df`` with the rank of each row from 1 by ``value`` in its series, ties by ``order`` (which makes rows unique)."""
    by = [*keys, value, *order]
    ranked = prefix_sums_global(df.withColumn("_one", F.lit(1)), by, ["_one"])
    if not keys:
        return ranked.select(*df.columns, F.col("s__one").cast("long").alias(name))
    first = ranked.groupBy(*keys).agg(F.min("s__one").alias("_first"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = ranked.join(first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first"), same)
    return joined.select(*df.columns, (F.col("s__one") - F.col("_first") + 1).cast("long").alias(name))


def auc(df: DataFrame, keys: list[str], score: str, label: str) -> DataFrame:
    """(keys, auc): area under the curve; ties of a score count half; null where one class is missing. Rows are folded
    to one per distinct score before they are put in order."""
    counts = df.groupBy(*keys, F.col(score).alias("_score")).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("_pos"), F.sum(F.when(F.col(label) == 1, 0).otherwise(1)).alias("_neg"))
    below = prefix_sums_global(counts, [*keys, "_score"], ["_neg"]).withColumn("_below", F.col("s__neg") - F.col("_neg"))
    pos, neg, n = F.sum("_pos"), F.sum("_neg"), F.col("_pos").cast("double")
    wins = F.sum(n * (F.col("_below") + F.col("_neg") / 2)) - pos * F.min("_below")
    return below.groupBy(*keys).agg((wins / F.nullif((pos * neg).cast("double"), F.lit(0.0))).alias("auc"))


def _within(points: DataFrame, limits: DataFrame) -> DataFrame:
    """(k, which, x, pairs, listed): for every limit x of a state, how many pairs of rows are no further apart, and how many
    pairs of distinct values. Values and values moved up by x run in one order, so each finds what lies below it."""
    same = F.col("p.k").eqNullSafe(F.col("l.k"))
    both = points.alias("p").join(limits.alias("l"), same).select("p.k", "l.which", "l.x", F.explode(F.array(F.struct(F.col("p.v").alias("v"), F.lit(0).alias("moved")), F.struct((F.col("p.v") + F.col("l.x")).alias("v"), F.lit(1).alias("moved")))).alias("e"), "p.c")
    rows = both.select("k", "which", "x", "e.v", "e.moved", "c", F.when(F.col("e.moved") == 0, F.col("c")).otherwise(0).alias("w"), F.when(F.col("e.moved") == 0, 1).otherwise(0).alias("u"))
    sums = prefix_sums_global(rows, ["k", "which", "x", "v", "moved"], ["w", "u"])
    start = F.min(F.col("s_w") - F.col("w")), F.min(F.col("s_u") - F.col("u"))
    n, m = F.sum("w"), F.sum("u")
    moved = lambda c: F.sum(F.when(F.col("moved") == 1, c))
    pairs = moved(F.col("c") * F.col("s_w")) - n * start[0] - n - n * (n - 1) / 2
    listed = moved(F.col("s_u")) - m * start[1] - m - m * (m - 1) / 2
    return sums.groupBy("k", "which", "x").agg(pairs.cast("double").alias("pairs"), listed.cast("double").alias("listed"), m.alias("m"))


def median_pair_distance(df: DataFrame, keys: list[str], value: str, name: str = "median_d2") -> DataFrame:
    """(keys, median_d2): median squared distance of all pairs of rows of a series, by rank and without pairs.

    The rank's interval of distances is cut into ``PARTS`` in each round; how many pairs lie below a distance is counted in
    one ordered pass over the values. Once few pairs of distinct values are left in the interval (at most ``LISTED`` for
    each value), these are listed and the rank is read off. An even number of pairs has two middle ranks, whose squares
    are averaged. Null and NaN values are left out; a series of fewer than two rows has a null.
    """
    k = F.struct(*[F.col(c).alias(c) for c in keys]) if keys else F.struct(F.lit(0).alias("_"))
    rows = df.select(k.alias("k"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    points = cut(rows.groupBy("k", "v").agg(F.count("*").alias("c")), "points")
    series = points.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("m"), F.min("v").alias("least"), (F.max("v") - F.min("v")).alias("wide"), F.sum(F.col("c") * (F.col("c") - 1) / 2).alias("zero"))
    total = F.col("n") * (F.col("n") - 1) / 2
    ranks = F.array_distinct(F.array(F.floor((total - 1) / 2), F.floor(total / 2)))
    begun = series.filter("n > 1").select("k", "m", "least", "wide", "zero", F.explode(ranks).alias("which"))
    found = begun.filter("which < zero").select("k", "which", F.lit(0.0).alias("d"))
    # each middle rank's interval of distances (lo, hi], the pairs up to lo, and the pairs of distinct values inside
    open_ = cut(begun.filter("which >= zero").select("k", "which", "m", "least", F.lit(0.0).alias("lo"), F.col("wide").alias("hi"), F.col("zero").alias("below"), (F.col("m") * (F.col("m") - 1) / 2).alias("listed")), "open")
    lists = open_.limit(0)
    while not open_.isEmpty():
        step = (F.col("hi") - F.col("lo")) / PARTS
        few = (F.col("listed") <= F.greatest(LISTED * F.col("m"), F.lit(1000))) | (F.col("lo") + step <= F.col("lo"))
        lists = lists.union(open_.filter(few))
        wide = cut(open_.filter(~few), "wide")
        if wide.isEmpty():
            break
        limits = wide.select("k", "which", F.explode(F.transform(F.sequence(F.lit(0), F.lit(PARTS)), lambda i: F.when(i == PARTS, F.col("hi")).otherwise(F.col("lo") + i * step))).alias("x"))
        counted = _within(points, limits).alias("c").join(wide.alias("s"), F.col("c.k").eqNullSafe(F.col("s.k")) & (F.col("c.which") == F.col("s.which")))
        over = F.col("c.pairs") > F.col("s.which")
        narrowed = counted.groupBy("s.k", "s.which", "s.m", "s.least").agg(F.max(F.when(~over, F.struct("c.x", "c.pairs", "c.listed"))).alias("lo"), F.min(F.when(over, F.struct("c.x", "c.listed"))).alias("hi"))
        open_ = cut(narrowed.select("k", "which", "m", "least", F.col("lo.x").alias("lo"), F.col("hi.x").alias("hi"), F.col("lo.pairs").alias("below"), (F.col("hi.listed") - F.col("lo.listed")).alias("listed")), "open")
    found = found.union(_listed(points, cut(lists, "lists")))
    squares = found.groupBy("k").agg(F.avg(F.col("d") * F.col("d")).alias(name)).withColumnRenamed("k", "_k")
    return series.join(squares, F.col("k").eqNullSafe(F.col("_k")), "left").select(*[F.col("k")[c].alias(c) for c in keys], name)


def _listed(points: DataFrame, states: DataFrame) -> DataFrame:
    """(k, which, d): the distance of each state's rank, from the pairs of distinct values inside its interval. Values are
    dealt by steps of the interval's width, so a value meets those of three steps."""
    same = F.col("p.k").eqNullSafe(F.col("s.k"))
    own = points.alias("p").join(states.alias("s"), same).select("s.*", "p.v", "p.c")
    at = lambda v: F.floor((v - F.col("least")) / (F.col("hi") - F.col("lo")))
    a = own.select("*", F.explode(F.sequence(at(F.col("v") + F.col("lo")), at(F.col("v") + F.col("hi")))).alias("step")).alias("a")
    b = own.select("k", "which", "v", "c", at(F.col("v")).alias("step")).alias("b")
    near = (F.col("b.v") > F.col("a.v") + F.col("a.lo")) & (F.col("b.v") <= F.col("a.v") + F.col("a.hi"))
    met = a.join(b, F.col("a.k").eqNullSafe(F.col("b.k")) & (F.col("a.which") == F.col("b.which")) & (F.col("a.step") == F.col("b.step")) & near)
    each = met.groupBy("a.k", "a.which", "a.below", (F.col("b.v") - F.col("a.v")).alias("d")).agg(F.sum(F.col("a.c") * F.col("b.c")).alias("w"))
    sums = prefix_sums_global(each, ["k", "which", "d"], ["w"])
    start = sums.groupBy("k", "which").agg(F.min(F.col("s_w") - F.col("w")).alias("start")).withColumnsRenamed({"k": "_k", "which": "_w"})
    reached = sums.join(start, F.col("k").eqNullSafe(F.col("_k")) & (F.col("which") == F.col("_w"))).filter(F.col("below") + F.col("s_w") - F.col("start") > F.col("which"))
    return reached.groupBy("k", "which").agg(F.min("d").alias("d"))
