"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document gets the key ``-ln(u) / weight`` with ``u`` drawn from a hash of its doc_id: ascending keys are a
weighted sample without replacement, the same on every run. Whole epochs of a source come first; the rest of its
target is filled in key order, by prefix sums of sizes. The prefix sums run over ranges of (source, key), so a
source with a third of all rows is spread over as many tasks as its share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, running, table

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def word_count(text: Column) -> Column:
    r"""Number of ``[^\x20\x09-\x0D]+`` in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, share: float = SHARE, most: float = MAX_EPOCHS) -> DataFrame:
    """``sources`` (source, weight, source_size) with ``target``: ``share`` of all sizes dealt by weight, none above
    ``most`` times its size; what exceeds that is dealt again among the others by weight.

    Targets are the lesser of a source's stop, ``most * size``, and its weight times one level. In order of the level at
    which sources stop, prefix sums give what all would take at each of these levels; the sources whose level the goal
    reaches stand at their stop, and the rest is dealt by weight. One sort, whatever the number of sources; one row of
    sums reaches the driver.
    """
    stop = F.col("source_size") * float(most)
    total = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    goal, weight = share * (total["size"] or 0), total["weight"] or 0
    ranked = running(sources.withColumns({"_stop": stop, "_level": stop / F.col("weight")}), [F.col("_level"), F.col("_no_source"), F.col("source")], {"_stopped": F.col("_stop"), "_passed": F.col("weight")}, "levels")
    at_level = F.col("_stopped") + F.col("_stop") + F.col("_level") * (weight - F.col("_passed") - F.col("weight"))
    held = at_level <= goal
    sums = ranked.agg(F.coalesce(F.sum(F.when(held, F.col("_stop"))), F.lit(0.0)).alias("stopped"), F.coalesce(F.sum(F.when(~held, F.col("weight"))), F.lit(0)).alias("free")).first()
    level = (goal - sums["stopped"]) / sums["free"] if sums["free"] else float("inf")
    return sources.withColumn("target", F.least(stop, F.col("weight") * F.lit(float(level))))


def mix(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken.

    ``quality`` (doc_id, weight; one row each) scales a document's chance (missing, null or not positive: 1). Sources
    rank by code point, null last, and take ``weights`` in turn. A null text has size 0 and is taken 0 times. Repeated
    doc_ids are separate rows with one key; ties of the key go by doc_id, then by row. The last document that fits a
    target in part gives that many words. An empty table gives no rows.
    """
    rows, row = numbered(docs)
    return planned(rows.select(F.col(row).alias("rid"), "doc_id", "source", "text"), quality, weights, share, most, seed).drop("rid")


def planned(docs: DataFrame, quality: DataFrame | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """``mix`` with the rows' numbers: ``docs`` has rid, doc_id, source and text."""
    u = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(2**53)) + 0.5) / float(2**53)
    rows = cut(docs.select("rid", "doc_id", "source", word_count(F.col("text")).alias("size"), (-F.log(u)).alias("_key")), "sizes")  # texts are read once
    if quality is not None:
        own = quality.filter("weight > 0").select(F.col("doc_id").alias("_rated"), F.col("weight").alias("_weight"))
        rows = rows.join(own, F.col("doc_id") == F.col("_rated"), "left").withColumn("_key", F.col("_key") / F.coalesce("_weight", F.lit(1.0)))
        rows = rows.drop("_rated", "_weight")
    rows = rows.withColumn("_no_source", F.col("source").isNull())
    dealt = cut(running(rows, [F.col("_no_source"), F.col("source"), F.col("_key"), F.col("doc_id"), F.col("rid")], {"before": F.col("size")}, "mix"), "mix")
    by_source = dealt.groupBy("_no_source", "source").agg(F.sum("size").alias("source_size"), F.min("before").alias("start"))
    ranked = running(by_source, [F.col("_no_source"), F.col("source")], {"rank": F.lit(1)}, "sources")
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = cut(targets(cut(ranked.withColumn("weight", pick), "sources"), share, most), "targets")
    joined = dealt.join(sources.withColumnRenamed("source", "_s").drop("rank", "weight").withColumnRenamed("_no_source", "_n"), F.col("source").eqNullSafe(F.col("_s")))
    goal = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0)
    rest = goal - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - (F.col("before") - F.col("start"))))
    return joined.select("rid", "doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def label_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): a document labelled good is twice as likely to come early, one labelled bad half as likely."""
    best = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return best.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).otherwise(1.0).alias("weight"))


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), label_weights(table(spark, sf_dir, "labels")))


def mixed_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the mix takes, all columns, with ``size`` and ``taken`` (words, repeats counted); columns of
    ``docs`` that have these names give way to them."""
    rows, row = numbered(docs)
    plan = planned(rows.select(F.col(row).alias("rid"), "doc_id", "source", "text"), label_weights(labels)).filter("taken > 0").select(F.col("rid").alias(row), "size", "taken")
    own = [c for c in docs.columns if c.lower() not in ("size", "taken")]
    return rows.select(row, *own).join(plan, row).select(*own, "size", "taken")
