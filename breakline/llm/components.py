"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _settled(edges: DataFrame) -> bool:
    """Whether every node has one link and links to a node without any: stars around their smallest nodes."""
    onward = edges.join(edges.select(F.col("a").alias("_a")), F.col("b") == F.col("_a"), "left_semi").select("a")
    several = edges.groupBy("a").count().filter("count > 1").select("a")
    return onward.union(several).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every end of ``links`` (a, b): root is the smallest node of its component.

    Each round replaces links by links to the smallest neighbour, aggregated per node before they are joined back; the
    number of rounds grows with the logarithm of the longest path. Nothing but "settled or not" reaches the driver.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _settled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = cut(large, "large")
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lower, "a")
        small = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small, "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
