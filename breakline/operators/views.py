"""Tables behind the usual plots: series with their segments, histograms, segment lengths, margin curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import auc as auc


def detection_view(rows: DataFrame, segments: DataFrame, keys: list[str], values: list[str], dims: int = 3) -> DataFrame:
    """Rows with segment and a mark on each segment's first row, of the first ``dims`` value columns."""
    from .post import label

    return label(rows, segments, keys).select(*keys, "t", *values[:dims], "seg_id", ((F.col("t") == F.col("seg_start")) & (F.col("t") > 0)).alias("is_change"))


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 50) -> DataFrame:
    """(keys, bin, low, high, count) over each group's own range; the largest value falls into the last bin."""
    limits = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_ = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)))
    counted = df.join(limits, keys).withColumn("_w", width).groupBy(*keys, bin_.cast("int").alias("bin"), "_lo", "_w").agg(F.count("*").alias("count"))
    return counted.select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), "count")


def segment_lengths(segments: DataFrame, keys: list[str]) -> DataFrame:
    return segments.select(*keys, "seg_id", (F.col("end") - F.col("start")).alias("length"))


def annotator_view(annotations: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cp, n_annotators): how many annotators marked each point."""
    return annotations.groupBy(*keys, "cp").agg(F.countDistinct("annotator_id").alias("n_annotators"))


def metric_comparison(results: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long table (keys, metric, value) with titles for axis labels."""
    pairs = F.array(*[F.struct(F.lit(m.replace("_", " ").title()).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return results.select(*keys, F.explode(pairs).alias("x")).select(*keys, "x.metric", "x.value")


def segment_summary(labelled: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, seg_id, length, mean, variance, kurtosis, overdispersion) of each segment; kurtosis is the excess."""
    v = F.col(value)
    return labelled.groupBy(*keys, "seg_id").agg(F.count("*").alias("length"), F.avg(v).alias("mean"), F.var_pop(v).alias("variance"), F.kurtosis(v).alias("kurtosis"), (F.var_pop(v) / F.avg(v)).alias("overdispersion"))
