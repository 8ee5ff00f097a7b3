"""Queries over one series of all rows of a table: no step holds the series in a task or a window of one key."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filters, ranks
from ..operators import long as L
from .catalog import EVENTS, events, read

LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]


def rank_of_lines(spark, sf):
    """Rank of every line by price, ties by position."""
    return ranks.ordinal_rank_long(read(spark, sf, "lineitem").select("l_extendedprice", *LINES), "l_extendedprice", LINES).select("l_orderkey", "l_linenumber", "rank")


def rank_of_lines_by_flag(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_returnflag", "l_extendedprice", *LINES)
    return ranks.ordinal_rank_long(rows, "l_extendedprice", LINES, ["l_returnflag"]).select("l_orderkey", "l_linenumber", "l_returnflag", "rank")


def auc_of_lines(spark, sf):
    """How well the quantity tells returned lines from others, over all lines."""
    rows = read(spark, sf, "lineitem").select(F.lit("all").alias("k"), "l_quantity", (F.col("l_returnflag") == "R").cast("int").alias("back"))
    return ranks.auc(rows, ["k"], "l_quantity", "back").select("k", F.round("auc", 9).alias("auc"))


def median_distance_of_customers(spark, sf):
    """Over all customers as one series."""
    rows = read(spark, sf, "customer").select(F.lit("all").alias("k"), F.floor("c_acctbal").cast("double").alias("v"))
    return ranks.median_pair_distance(rows, ["k"], "v")


AR, MA = 0.5, 0.4
OMEGA, ALPHA, BETA = 0.05, 0.1, 0.8


def arma_residuals_of_lines(spark, sf):
    """Residuals of one series of all lines' quantities."""
    rows = read(spark, sf, "lineitem").select(*LINES, (F.col("l_quantity") - 25).cast("double").alias("y"))
    return filters.arma_residuals(rows, [], LINES, "y", [AR], [MA]).select("l_orderkey", "l_linenumber", F.round("residual", 6).alias("residual"))


def garch_variances_of_events(spark, sf):
    rows = events(spark, sf).select("k", "t", (F.col("v") / 1000).alias("v"))
    return filters.garch_variances(rows, ["k"], ["t"], "v", OMEGA, [ALPHA], [BETA]).select("k", "t", F.round("variance", 6).alias("variance"))


def _lines_at(spark, sf):
    return read(spark, sf, "lineitem").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at")).agg(F.avg("l_quantity").alias("q"), F.avg("l_extendedprice").alias("price"))


def long_series_variance(spark, sf):
    """Quantities of all lines as one series, four times as spread in every other run of 1,500 orders."""
    wide = F.when(F.col("at") % 24_000 >= 12_000, 4.0).otherwise(1.0)
    return L.detect_long(_lines_at(spark, sf).select("at", ((F.col("q") - 25) * wide).alias("v")), "at", "v", family="variance", chunk=5_000)


def long_series_lm(spark, sf):
    """Price on quantity over all lines as one series, half as dear in every other run of 1,500 orders."""
    cheap = F.when(F.col("at") % 24_000 >= 12_000, 0.5).otherwise(1.0)
    return L.detect_long(_lines_at(spark, sf).select("at", "q", (F.col("price") / 1000 * cheap).alias("v")), "at", "v", "q", "lm", chunk=5_000)


QUERIES: dict = {"long_series_variance": long_series_variance, "long_series_lm": long_series_lm, "arma_residuals_of_lines": arma_residuals_of_lines, "garch_variances_of_events": garch_variances_of_events, "rank_of_lines": rank_of_lines, "rank_of_lines_by_flag": rank_of_lines_by_flag, "auc_of_lines": auc_of_lines, "median_distance_of_customers": median_distance_of_customers}

#: The residual's recursion written out: powers of the coefficient over the rows before, to the 45th.
RESIDUAL = " + ".join(f"{(-MA) ** k!r} * coalesce(lag(u, {k}) OVER w, 0)" for k in range(46))

SQL: dict = {
    "arma_residuals_of_lines": f"WITH x AS (SELECT *, l_quantity - 25 AS y FROM lineitem), z AS (SELECT *, y - {AR} * coalesce(lag(y) OVER w, 0) AS u FROM x WINDOW w AS (ORDER BY {', '.join(LINES)})) SELECT l_orderkey, l_linenumber, round({RESIDUAL}, 6) AS residual FROM z WINDOW w AS (ORDER BY {', '.join(LINES)})",
    "garch_variances_of_events": f"""WITH RECURSIVE {EVENTS}, m AS (SELECT k, avg(v * v / 1e6) AS m FROM e GROUP BY k),
        s AS (SELECT k, 0::BIGINT AS t, {OMEGA} + {ALPHA} * m + {BETA} * m AS h FROM m UNION ALL SELECT s.k, s.t + 1, {OMEGA} + {ALPHA} * e.v * e.v / 1e6 + {BETA} * s.h FROM s JOIN e ON e.k = s.k AND e.t = s.t WHERE EXISTS (SELECT 1 FROM e x WHERE x.k = s.k AND x.t = s.t + 1))
        SELECT k, t, round(h, 6) AS variance FROM s""",
    "rank_of_lines": f"SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_extendedprice, {', '.join(LINES)}) AS rank FROM lineitem",
    "rank_of_lines_by_flag": f"SELECT l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice, {', '.join(LINES)}) AS rank FROM lineitem",
    "auc_of_lines": "WITH x AS (SELECT (l_returnflag = 'R')::INTEGER AS back, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS r FROM lineitem) SELECT 'all' AS k, round((sum(back * r) - sum(back) * (sum(back) + 1) / 2) / (sum(back)::DOUBLE * (count(*) - sum(back))), 9) AS auc FROM x",
    "median_distance_of_customers": "WITH c AS (SELECT c_custkey, floor(c_acctbal) AS v FROM customer) SELECT 'all' AS k, median((a.v - b.v) * (a.v - b.v)) AS median_d2 FROM c a JOIN c b ON a.c_custkey < b.c_custkey",
}
