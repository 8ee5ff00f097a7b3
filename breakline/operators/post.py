"""Change points after the recursion: trim, merge, shift, least length, segments. Gaps-and-islands windows on a table of
(keys, cp) beside a table of (keys, n)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trim(cps: DataFrame, sizes: DataFrame, keys: list[str], share: float, closed: bool) -> DataFrame:
    """Change points not too near either end. ``closed``: the limits themselves stay."""
    low, high = F.lit(share) * F.col("n"), (1 - F.lit(share)) * F.col("n")
    cp = F.col("cp")
    inside = (cp >= low) & (cp <= high) if closed else (cp > low) & (cp < high)
    return cps.join(sizes, keys).filter(inside & (cp > 0)).select(*keys, "cp")


def _islands(cps: DataFrame, sizes: DataFrame, keys: list[str], share: float, closed: bool) -> DataFrame:
    """Runs of change points whose gaps are close: ``closed`` counts a gap of exactly share * n as close."""
    w = Window.partitionBy(*keys).orderBy("cp")
    gap, limit = F.col("cp") - F.lag("cp").over(w), F.lit(share) * F.col("n")
    new = F.when(gap.isNull() | (gap > limit if closed else gap >= limit), 1).otherwise(0)
    return cps.distinct().join(sizes, keys).select(*keys, "cp", new.alias("_new")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def merge_runs(cps: DataFrame, sizes: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Each run of close change points becomes the middle of its first and last."""
    runs = _islands(cps, sizes, keys, share, closed=True)
    return runs.groupBy(*keys, "_run").agg(F.floor((F.min("cp") + F.max("cp")) / 2).cast("long").alias("cp")).select(*keys, "cp")


def merge_pairs(cps: DataFrame, sizes: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Close change points become the means of neighbours, two by two; an odd last member of a run is dropped."""
    runs = _islands(cps, sizes, keys, share, closed=False)
    w = Window.partitionBy(*keys, "_run")
    placed = runs.select(*keys, "_run", "cp", F.row_number().over(w.orderBy("cp")).alias("_k"), F.count("*").over(w).alias("_m"))
    pairs = placed.groupBy(*keys, "_run", "_m", F.floor((F.col("_k") - 1) / 2).alias("_pair")).agg(F.count("*").alias("_c"), F.floor(F.avg("cp")).cast("long").alias("cp"))
    return pairs.filter((F.col("_c") == 2) | (F.col("_m") == 1)).select(*keys, "cp")


def enforce(cps: list[int], n: int, least: int) -> list[int]:
    """Drop change points until every inner segment has ``least`` rows; the shorter neighbour takes the segment in.

    The leftmost short segment goes first; what is left of it is long enough, so one step back is all that a drop undoes.
    """
    rest = sorted(cps, reverse=True)
    done: list[int] = [0]  # start, then kept change points: the segments between them are long enough
    while rest:
        start, end = done[-1], rest[-1]
        if len(done) > 1 and end - start < least:  # an inner segment; the last one is open
            after = (rest[-2] if len(rest) > 1 else n) - end
            if start - done[-2] < after:
                done.pop()
            else:
                rest.pop()
        else:
            done.append(rest.pop())
    return done[1:]


def min_length(cps: DataFrame, sizes: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``enforce`` per series, one group of its change points each."""
    rows = cps.join(sizes, keys).select(*keys, "cp", "n")
    schema = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys) + ", cp long"

    def kept(key: tuple, table: pa.Table) -> pa.Table:
        out = enforce(table.column("cp").to_pylist(), table.column("n")[0].as_py(), least)
        names = [pa.array([k.as_py()] * len(out), table.schema.field(c).type) for c, k in zip(keys, key, strict=True)]
        return pa.Table.from_arrays([*names, pa.array(out, pa.int64())], [*keys, "cp"])

    return rows.groupBy(*keys).applyInArrow(kept, schema)


def shift(cps: DataFrame, by: int) -> DataFrame:
    return cps.withColumn("cp", F.col("cp") + by)


def segments(cps: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seg_id, start, end): half-open segments, also of series without change points."""
    bounds = cps.select(*keys, F.col("cp").cast("long").alias("start")).union(sizes.select(*keys, F.lit(0).cast("long"))).distinct()
    w = Window.partitionBy(*keys).orderBy("start")
    return bounds.join(sizes, keys).select(*keys, (F.row_number().over(w) - 1).cast("int").alias("seg_id"), "start", F.coalesce(F.lead("start").over(w), F.col("n")).cast("long").alias("end")).filter("end > start")


def label(rows: DataFrame, segs: DataFrame, keys: list[str], at: str = "t") -> DataFrame:
    """``rows`` with seg_id, start and end of the segment that holds them: starts flow down each series' order, so the
    join of rows and segments needs no range comparison."""
    marks = segs.select(*keys, F.col("start").alias(at), F.struct("seg_id", "start", "end").alias("_seg"))
    w = Window.partitionBy(*keys).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(marks, [*keys, at], "left").withColumn("_seg", F.last("_seg", ignorenulls=True).over(w))
    return joined.select(*rows.columns, "_seg.seg_id", F.col("_seg.start").alias("seg_start"), F.col("_seg.end").alias("seg_end"))
