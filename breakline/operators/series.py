"""Feature derivation over ordered series: index, prefix sums, lags, ranks, noise. Windows and aggregates only.

A series is a group of rows (``keys``) in an order (``order``, unique within the series). Every window is partitioned by
the series, so many series run side by side; one giant series goes through ``prefix_sums_global``.
"""

from __future__ import annotations

import tempfile
import uuid
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that all executors share (``spark.checkpoint.dir``) and read again. A local session
    may leave it unset; on a cluster that is an error."""
    spark = df.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='breakline-')}"
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared}/breakline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def index(df: DataFrame, keys: list[str], order: list[str], name: str = "t") -> DataFrame:
    """``df`` with the 0-based position of each row in its series."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def index_long(df: DataFrame, keys: list[str], order: list[str], name: str = "t") -> DataFrame:
    """``index`` of few, long series: rows are dealt by ranges of (keys, order) and written, numbered inside their range,
    and a series' rows in the ranges before (one row for each range and series) are added on. No task sorts a series."""
    dealt = cut(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("_part", *keys).agg(F.count("*").alias("_n")).select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    own = dealt.withColumn("_o", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)) - 1)
    same = [F.col("_part") == F.col("_p"), *[F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]]
    return own.join(F.broadcast(starts), same).select(*df.columns, (F.col("_o") + F.col("_b")).cast("long").alias(name))


def over(keys: list[str], order: str = "t"):
    return Window.partitionBy(*keys).orderBy(order)


def up_to(keys: list[str], order: str = "t"):
    return over(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def first_diff(value: str, keys: list[str], order: str = "t") -> Column:
    return F.col(value) - F.lag(value).over(over(keys, order))


def prefix_stats(df: DataFrame, keys: list[str], values: list[str], kind: str = "mean", order: str = "t") -> DataFrame:
    """Running sufficient statistics: sums s_j, and q (mean) or the products q_i_j (variance: of centred values)."""
    w, whole = up_to(keys, order), Window.partitionBy(*keys)
    x = {v: F.col(v) - F.avg(v).over(whole) if kind == "variance" else F.col(v) for v in values}
    df = df.select("*", *[x[v].alias(f"_x_{v}") for v in values])
    sums = [F.sum(f"_x_{v}").over(w).alias(f"s_{v}") for v in values]
    if kind == "mean":
        products = [F.sum(sum((F.col(f"_x_{v}") * F.col(f"_x_{v}") for v in values), F.lit(0.0))).over(w).alias("q")]
    else:
        products = [F.sum(F.col(f"_x_{a}") * F.col(f"_x_{b}")).over(w).alias(f"q_{a}_{b}") for a, b in product(values, values)]
    return df.select("*", *sums, *products).drop(*[f"_x_{v}" for v in values])


def prefix_sums_global(df: DataFrame, order: list[str], values: list[str], parts: int | None = None) -> DataFrame:
    """Running sums over one giant series without a one-task window: ranges of the order are summed by themselves, and
    the ranges' totals (one row each) are added on. ``order`` must be unique. The dealt rows are written out once, so the
    ranges cannot differ between the passes, whatever is lost."""
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt = cut(ranged.sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_part").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0.0)).alias(f"_b_{v}") for v in values])
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.select("*", *[F.sum(v).over(w).alias(f"_o_{v}") for v in values])
    joined = own.join(F.broadcast(starts), "_part")
    return joined.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_b_{v}")).alias(f"s_{v}") for v in values])


def lags(df: DataFrame, keys: list[str], values: list[str], order: int, at: str = "t") -> DataFrame:
    """Autoregression rows: lag-major columns <v>_lag<k>, the first ``order`` rows of each series dropped."""
    w = over(keys, at)
    lagged = [F.lag(v, k).over(w).alias(f"{v}_lag{k}") for k in range(1, order + 1) for v in values]
    return df.select("*", *lagged).filter(F.col(at) >= order)


def ordinal_rank(value: str, keys: list[str], order: str = "t") -> Column:
    """Rank from 1; ties by position."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(value, order))


def lengths(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def presegment(n: Column, t: Column, count: int = 10) -> Column:
    """Bucket of row t of n: runs of n div count rows, the rest in the last bucket."""
    return F.when(n < count, F.lit(count - 1)).otherwise(F.least(F.floor(t / F.greatest(F.floor(n / count), F.lit(1))), F.lit(count - 1))).cast("int")


def even_bounds(n: Column, count: int = 10) -> Column:
    """Borders of ``count`` runs of nearly equal length: round(i n / count)."""
    return F.transform(F.sequence(F.lit(0), F.lit(count)), lambda i: F.round(i * n / count).cast("long"))


def rice_variance(df: DataFrame, keys: list[str], value: str, at: str = "t") -> DataFrame:
    """Noise variance per series from first differences; 1 for a series of one row."""
    d = df.select(*keys, first_diff(value, keys, at).alias("_d"))
    return d.groupBy(*keys).agg((F.sum(F.col("_d") * F.col("_d")) / (2 * (F.count("*") - 1))).alias("_s")).select(*keys, F.coalesce("_s", F.lit(1.0)).alias("rice_variance"))


def rice_covariance(df: DataFrame, keys: list[str], values: list[str], at: str = "t") -> DataFrame:
    """Entries c_<a>_<b> of the noise covariance per series."""
    d = df.select(*keys, *[first_diff(v, keys, at).alias(f"_d_{v}") for v in values])
    n = 2 * (F.count("*") - 1)
    return d.groupBy(*keys).agg(*[(F.sum(F.col(f"_d_{a}") * F.col(f"_d_{b}")) / n).alias(f"c_{a}_{b}") for a, b in product(values, values)])


def whiten(df: DataFrame, keys: list[str], value: str, at: str = "t", variance: float | None = None) -> DataFrame:
    """``df`` with z = value over its series' noise deviation."""
    if variance is not None:
        return df.withColumn("z", F.col(value) / F.sqrt(F.lit(float(variance))))
    return df.join(rice_variance(df, keys, value, at), keys).withColumn("z", F.col(value) / F.sqrt("rice_variance")).drop("rice_variance")


def sliding(value: str, keys: list[str], size: int, shift: int = 0, at: str = "t") -> Column:
    """Sum of ``size`` rows from the current one on, shifted."""
    return F.sum(value).over(over(keys, at).rowsBetween(shift, shift + size - 1))


def winsorise(value: Column, most: float = 20.0) -> Column:
    return F.least(F.greatest(value, F.lit(-most)), F.lit(most))


def squared_distances(df: DataFrame, keys: list[str], features: str, at: str = "t", every: int = 1) -> DataFrame:
    """Median squared distance of pairs per series, for the kernel bandwidth: pairs of every ``every``-th row, matched
    within their series. For whole long series the kernel's own estimate on a fixed sample is the scalable way."""
    rows = df.filter(F.col(at) % every == 0).select(*keys, F.col(at).alias("_t"), F.col(features).alias("_f"))
    a, b = rows.alias("a"), rows.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a._t") < F.col("b._t")]
    gap = F.aggregate(F.zip_with("a._f", "b._f", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, on).groupBy(*[F.col(f"a.{k}").alias(k) for k in keys]).agg(F.percentile(gap, F.lit(0.5)).alias("median_d2"))
