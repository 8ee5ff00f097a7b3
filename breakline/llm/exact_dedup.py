"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size. Distinct blocks are sorted into integer names; neighbouring names are
paired and the pairs named again, until each document has one integer. Equal integers (of equal depth) mean equal
texts: a name stands for contents that were compared in full, so there are no collisions.

Copies are folded before every shuffle of contents (``distinct`` combines on the map side), so a text that a third
of all rows share is sent once per map task. Names travel back over SHA-256 digests; that no digest stands for two
blocks is verified on every run, and the blocks themselves are joined where one does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lower_az, numbered, table

BLOCK = 4096


def _named(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Sort distinct rows inside their hash partitions and number them: equal keys, one integer."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def exact_dedup(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``named_documents`` without the rows' numbers."""
    return named_documents(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("rid")), block).drop("rid")


def named_documents(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, rid: its number): rid, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z. A null text counts as empty. Of equal texts the row with
    the largest doc_id stays; among rows that repeat that doc_id one stays; null doc_ids come last. An empty table
    gives no rows. Other columns of ``docs`` are not read.
    """
    text = lower_az(F.coalesce(F.col("text"), F.lit("")))
    raw = docs.select("rid", "doc_id", text.cast("binary").alias("b"))
    size = F.octet_length("b")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / block).cast("int") - 1, F.lit(0))), lambda i: F.substring(F.col("b"), i * block + 1, F.lit(block)))
    content = raw.select(F.explode(pieces).alias("block")).distinct()
    digest = lambda c: F.unhex(F.sha2(c, 256))
    names = cut(_named(content, ["block"]).select(digest("block").alias("digest"), "name"), "names")
    clash = not names.groupBy("digest").count().filter("count > 1").isEmpty()
    if clash:  # two blocks under one digest: the blocks themselves are joined, so the row numbers must hold
        raw = cut(raw, "raw")
    base = cut(raw.select("rid", "doc_id", F.sha2("b", 256).alias("text_sha256"), F.transform(pieces, digest).alias("digests")), "base")
    if clash:
        level = raw.select("rid", F.posexplode(pieces).alias("i", "block")).join(_named(content, ["block"]), "block").select("rid", "i", "name")
    else:
        level = base.select("rid", F.posexplode("digests").alias("i", "digest")).join(names, "digest").select("rid", "i", "name")
    longest = base.agg(F.max(F.size("digests"))).first()[0] or 1
    single = base.filter(F.size("digests") == 1).select("rid")
    depth = 0
    level = cut(level, "level")
    done = level.join(single, "rid", "left_semi").select("rid", F.lit(0).alias("depth"), F.lit(1).alias("n"), "name") if longest > 1 else level.select("rid", F.lit(0).alias("depth"), F.lit(1).alias("n"), "name")
    level = level.join(base.filter(F.size("digests") > 1).select("rid", F.size("digests").alias("n")), "rid") if longest > 1 else None
    while longest > 1:
        depth += 1
        pairs = level.groupBy("rid", "n", F.floor(F.col("i") / 2).cast("int").alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(F.col("i") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"))
        pairs = cut(pairs, "pairs")
        ids = cut(_named(pairs.select("a", "b").distinct(), ["a", "b"]), "ids")
        level = cut(pairs.join(ids, ["a", "b"]).select("rid", "n", "i", "name"), "level")
        longest = (longest + 1) // 2
        last = F.col("n") <= 2**depth
        done = done.unionByName(level.filter(last).select("rid", F.lit(depth).alias("depth"), "n", "name"))
        level = level.filter(~last)
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(-(2**63))), "doc_id", "rid"))
    owned = done.join(base.select("rid", "doc_id", "text_sha256"), "rid")
    groups = owned.groupBy("depth", "n", "name").agg(best.alias("top"), F.count("*").alias("group_size"))
    return owned.join(groups, ["depth", "n", "name"]).select("rid", "doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("top.rid")).alias("kept"), "text_sha256")


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns; of rows that are equal in doc_id too, one."""
    rows, row = numbered(docs)
    dropped = named_documents(rows.select("doc_id", "text", F.col(row).alias("rid"))).filter("NOT kept").select(F.col("rid").alias(row))
    return rows.join(dropped, row, "left_anti").select(docs.columns)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = {
    "op9_exact_dedup": """
        WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM d WINDOW w AS (PARTITION BY t)""",
}
