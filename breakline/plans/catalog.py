"""Registered queries of the change-point engine, each over whole tables, and the SQL that they equal.

Series come from the driver's tables: ``events`` by event type in order of (ts, event_id), ``lineitem`` by return flag,
and months of ``orders`` by priority, with a known level shift, well above the noise, added in both engines. Values that
enter sums are whole numbers, so sums do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import penalty
from ..operators import detect as D
from ..operators import long as L
from ..operators import metrics as M
from ..operators import post, ranks, segments, series, views
from ..sources import generators

KEY = ["k"]


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark, sf) -> DataFrame:
    """(k, t, v, event_id): cents as whole numbers."""
    rows = read(spark, sf, "events").select(F.col("event_type").alias("k"), "ts", "event_id", F.floor(F.col("value") * 100).cast("double").alias("v"))
    return series.index_long(rows, KEY, ["ts", "event_id"]).select("k", "t", "v", "event_id")


EVENTS = "e AS (SELECT event_type AS k, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS t, floor(value * 100)::DOUBLE AS v, event_id FROM events)"


def months(spark, sf) -> DataFrame:
    """(k, t, v): mean order price of each month and priority in whole thousands, 300 higher in months 30 to 49."""
    rows = read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg(F.floor(F.sum(F.floor("o_totalprice")) / F.count("*") / 1000).cast("double").alias("v0"))
    at = series.index(rows, KEY, ["m"])
    return at.select("k", "t", (F.col("v0") + F.when(F.col("t").between(30, 49), 300.0).otherwise(0.0)).alias("v"))


MONTHS = """m0 AS (SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m') AS m, floor(sum(floor(o_totalprice)::BIGINT) / count(*) / 1000) AS v0 FROM orders GROUP BY ALL),
    e AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY m) - 1 AS t, v0 + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY m) - 1 BETWEEN 30 AND 49 THEN 300.0 ELSE 0.0 END AS v FROM m0)"""

#: The months with signs that alternate in months 30 to 49, so that a row's dependence on the one before turns round.
WAVES = f"{MONTHS}, wv AS (SELECT k, t, v * CASE WHEN t BETWEEN 30 AND 49 AND t % 2 = 1 THEN -1.0 ELSE 1.0 END AS v FROM e)"


def waves(spark, sf) -> DataFrame:
    turned = F.col("t").between(30, 49) & (F.col("t") % 2 == 1)
    return months(spark, sf).select("k", "t", (F.col("v") * F.when(turned, -1.0).otherwise(1.0)).alias("v"))


def _waves(family: str, **options):
    return lambda spark, sf: D.detect(waves(spark, sf), "k", "t", "v", family=family, **options).raw_change_points


#: Unpruned recursion in SQL over lists of prefix sums; {cost} prices [j, t) from s, q and the length.
DP = """p AS (SELECT k, t + 1 AS t, sum({s}) OVER w AS s, sum({q}) OVER w AS q, count(*) OVER (PARTITION BY k) AS n FROM {src} WINDOW w AS (PARTITION BY k ORDER BY t)),
    dp AS (
      SELECT d.k, 0::BIGINT AS t, [0.0::DOUBLE] AS S, [0.0::DOUBLE] AS Q, [(-{beta})::DOUBLE] AS FF, [0::BIGINT] AS R, n FROM (SELECT DISTINCT k, n FROM p) d
      UNION ALL
      SELECT k, t, S, Q, list_append(FF, list_min(c)), list_append(R, list_position(c, list_min(c)) - 1), n
      FROM (SELECT d.k, p.t, list_append(d.S, p.s) AS S, list_append(d.Q, p.q) AS Q, d.FF, d.R, d.n,
                   [FF[j + 1] + {cost} + {beta} FOR j IN range(0, p.t)] AS c
            FROM dp d JOIN p ON p.k = d.k AND p.t = d.t + 1)
    ),
    tr AS (
      SELECT k, R[n + 1] AS cp, R FROM dp WHERE t = n AND R[n + 1] > 0
      UNION ALL
      SELECT k, R[cp + 1], R FROM tr WHERE R[cp + 1] > 0
    )
    SELECT k, cp FROM tr"""

#: The recursion with its list of live starts: {stats} are row values whose prefix sums price a segment ({cost}, over
#: D1, D2, ...); starts worse than the best by more than the penalty and {slack} are dropped. {beta} and {slack} may use n.
PRUNED = """p AS (SELECT k, t + 1 AS t, [{sums}] AS ps, count(*) OVER (PARTITION BY k) AS n FROM {src} WINDOW w AS (PARTITION BY k ORDER BY t)),
    z0 AS (SELECT k, n, ({beta})::DOUBLE AS beta, ({slack})::DOUBLE AS slack FROM (SELECT DISTINCT k, n FROM p) {extra}),
    dp AS (
      SELECT k, 0::BIGINT AS t, [[{zeros}]] AS PS, [-beta] AS FF, [0::BIGINT] AS A, [0::BIGINT] AS R, n, beta, slack FROM z0
      UNION ALL
      SELECT k, t, PS, list_append(FF, m + beta), list_append([A[i] FOR i IN range(1, len(A) + 1) IF c[i] <= m + beta + slack], t), list_append(R, A[list_position(c, m)]), n, beta, slack
      FROM (SELECT *, list_min(c) AS m FROM (
        SELECT d.k, p.t, list_append(d.PS, p.ps) AS PS, d.FF, d.A, d.R, d.n, d.beta, d.slack, [FF[j + 1] + {cost} FOR j IN A] AS c
        FROM dp d JOIN p ON p.k = d.k AND p.t = d.t + 1))
    ),
    tr AS (
      SELECT k, R[n + 1] AS cp, R FROM dp WHERE t = n AND R[n + 1] > 0
      UNION ALL
      SELECT k, R[cp + 1], R FROM tr WHERE R[cp + 1] > 0
    )"""
LENGTH = "(p.t - j)"
MEAN_COST = f"(((p.q - list_extract(d.Q, j + 1)) - (p.s - list_extract(d.S, j + 1)) * (p.s - list_extract(d.S, j + 1)) / {LENGTH}) / 2 + ln({LENGTH}) / 2)"
VARIANCE_COST = f"({LENGTH} / 2.0 * ln(greatest(p.q - list_extract(d.Q, j + 1), 1e-11) / {LENGTH}) + ln({LENGTH}) / 2)"
NOISE = "r AS (SELECT k, sum(d * d) / (2 * (count(*) - 1)) AS s2 FROM (SELECT k, v - lag(v) OVER (PARTITION BY k ORDER BY t) AS d FROM e) GROUP BY k)"


def _dp(before: str, src: str, s: str, q: str, beta: str, cost: str) -> str:
    return f"WITH RECURSIVE {before}, " + DP.format(src=src, s=s, q=q, beta=beta, cost=cost)


def _pruned(before: str, src: str, stats: list[str], beta: str, cost: str, slack: str = "0", extra: str = "") -> str:
    for i in range(len(stats), 0, -1):
        cost = cost.replace(f"D{i}", f"(p.ps[{i}] - list_extract(list_extract(d.PS, j + 1), {i}))")
    sums = ", ".join(f"sum({x}) OVER w" for x in stats)
    return f"WITH RECURSIVE {before}, " + PRUNED.format(src=src, sums=sums, zeros=", ".join(["0.0::DOUBLE"] * len(stats)), beta=beta, cost=cost, slack=slack, extra=extra)


#: Trimmed and merged change points of the moment families, from the recursion's.
FINISHED = """sz AS (SELECT k, count(*) AS n FROM e GROUP BY k), c AS (SELECT k, cp FROM tr JOIN sz USING (k) WHERE cp > 0.02 * n AND cp < 0.98 * n),
    g AS (SELECT k, cp, CASE WHEN cp - lag(cp) OVER w > 0.02 * n OR lag(cp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM c JOIN sz USING (k) WINDOW w AS (PARTITION BY k ORDER BY cp)),
    f AS (SELECT k, (min(cp) + max(cp)) // 2 AS cp FROM (SELECT k, cp, sum(new) OVER (PARTITION BY k ORDER BY cp) AS run FROM g) GROUP BY k, run),
    sg AS (SELECT e.k, e.t, e.v, count(f.cp)::INTEGER AS seg_id FROM e LEFT JOIN f ON f.k = e.k AND f.cp <= e.t GROUP BY ALL)"""


def _detect(family: str, **options):
    return lambda spark, sf: D.detect(months(spark, sf), "k", "t", "v", family=family, **options).raw_change_points


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return D.mean(months(spark, sf), "k", "t", "v").change_points


# --- series -----------------------------------------------------------------------------------------------------------


def series_index(spark, sf):
    return events(spark, sf)


def prefix_stats(spark, sf):
    return series.prefix_stats(events(spark, sf), KEY, ["v"]).select("k", "t", "s_v", "q")


def prefix_sums_long(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return series.prefix_sums_global(rows, ["l_orderkey", "l_linenumber", "l_quantity"], ["l_quantity"]).groupBy("l_orderkey", "l_linenumber").agg(F.max("s_l_quantity").alias("s"))


def first_diff(spark, sf):
    return events(spark, sf).select("k", "t", series.first_diff("v", KEY).alias("d"))


def lag_matrix_ar(spark, sf):
    return series.lags(events(spark, sf), KEY, ["v"], 2).select("k", "t", "v", "v_lag1", "v_lag2")


def lag_matrix_var(spark, sf):
    rows = events(spark, sf).withColumn("w", F.col("event_id").cast("double"))
    return series.lags(rows, KEY, ["v", "w"], 1).select("k", "t", "v", "w", "v_lag1", "w_lag1")


def ordinal_rank(spark, sf):
    return events(spark, sf).select("k", "t", series.ordinal_rank("v", KEY).alias("rank"))


def presegment_buckets(spark, sf):
    rows = events(spark, sf)
    return rows.join(series.lengths(rows, KEY), KEY).select("k", "t", series.presegment(F.col("n"), F.col("t")).alias("bucket"))


def rice_variance(spark, sf):
    return series.rice_variance(events(spark, sf), KEY, "v").select("k", F.round("rice_variance", 4).alias("rice_variance"))


def sliding_sum(spark, sf):
    return events(spark, sf).select("k", "t", series.sliding("v", KEY, 5).alias("s"))


def penalty_table(spark, sf):
    n = series.lengths(events(spark, sf), KEY)
    return n.select("k", *[F.round(penalty.penalty_column(c, F.lit(1), F.col("n"), f), 6).alias(f"{f}_{c.lower()}") for f in ("mean", "lm") for c in penalty.CRITERIA])


# --- segments ---------------------------------------------------------------------------------------------------------


def _blocks(spark, sf, size: int = 100) -> DataFrame:
    return events(spark, sf).withColumn("seg_id", F.floor(F.col("t") / size).cast("int"))


def segment_moments(spark, sf):
    out = segments.segment_moments(_blocks(spark, sf), KEY, ["v"])
    return out.select("k", "seg_id", "length", F.round("mean_v", 4).alias("mean_v"), F.round("cov_v_v", 2).alias("cov_v_v"))


def segment_cost(kind: str):
    def run(spark, sf):
        rows = _blocks(spark, sf)
        if kind == "variance":
            rows = rows.join(rows.groupBy(*KEY).agg(F.avg("v").alias("centre")), KEY)
        return segments.segment_costs(rows, KEY, "v", kind).select("k", "seg_id", F.round("cost", 3).alias("cost"))

    return run


def segment_energy(spark, sf):
    return segments.segment_energy(_blocks(spark, sf), KEY, "v").select("k", "seg_id", F.round("energy", 2).alias("energy"))


def ols_segment(spark, sf):
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), F.month("l_shipdate").alias("seg_id"), "l_quantity", F.floor("l_extendedprice").cast("double").alias("y"))
    return segments.ols_one(rows, KEY, "y", "l_quantity").select("k", "seg_id", F.round("slope", 6).alias("slope"), F.round(F.col("rss") / 1e6, 2).alias("rss_millions"))


def residuals_mean(spark, sf):
    d = D.mean(months(spark, sf), "k", "t", "v")
    return d.residuals().select("k", "t", "seg_id", F.round("residual", 6).alias("residual"))


def parameters_mean(spark, sf):
    d = D.mean(months(spark, sf), "k", "t", "v")
    return d.parameters().select("k", "seg_id", F.round(F.col("theta")[0], 6).alias("theta"), F.round("cost", 5).alias("cost"))


def summary_mean(spark, sf):
    return D.mean(months(spark, sf), "k", "t", "v").summary()


def _two(spark, sf) -> DataFrame:
    return events(spark, sf).withColumn("w", (F.col("event_id") % 1000).cast("double"))


def prefix_stats_products(spark, sf):
    return series.prefix_stats(_two(spark, sf), KEY, ["v", "w"], "meanvariance").select("k", "t", "s_v", "s_w", "q_v_v", "q_v_w", "q_w_v", "q_w_w")


def rice_covariance(spark, sf):
    out = series.rice_covariance(_two(spark, sf), KEY, ["v", "w"])
    return out.select("k", *[F.round(c, 3).alias(c) for c in ("c_v_v", "c_v_w", "c_w_v", "c_w_w")])


def segment_moments_two(spark, sf):
    rows = _two(spark, sf).withColumn("seg_id", F.floor(F.col("t") / 100).cast("int"))
    out = segments.segment_moments(rows, KEY, ["v", "w"])
    return out.select("k", "seg_id", "length", F.round("mean_v", 4).alias("mean_v"), F.round("mean_w", 4).alias("mean_w"), F.round("cov_v_w", 2).alias("cov_v_w"), F.round("cov_w_w", 2).alias("cov_w_w"))


def whiten(spark, sf):
    return series.whiten(events(spark, sf), KEY, "v").select("k", "t", F.round("z", 6).alias("z"))


def winsorise(spark, sf):
    return events(spark, sf).select("k", "t", series.winsorise(F.floor(F.col("v") / 100) - 50, 20.0).alias("x"))


def even_bounds(spark, sf):
    n = series.lengths(events(spark, sf), KEY)
    return n.select("k", F.posexplode(series.even_bounds(F.col("n"))).alias("i", "bound"))


def median_distance(spark, sf):
    rows = read(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), F.floor("c_acctbal").cast("double").alias("v"), "c_custkey")
    return ranks.median_pair_distance(rows, KEY, "v")


def segment_summary(spark, sf):
    out = views.segment_summary(_blocks(spark, sf), KEY, "v")
    return out.select("k", "seg_id", "length", F.round("mean", 4).alias("mean"), F.round("kurtosis", 6).alias("kurtosis"), F.round("overdispersion", 4).alias("overdispersion"))


# --- post-processing: change points where event_id leaves no rest ------------------------------------------------------


def _points(spark, sf, mod: int) -> DataFrame:
    return events(spark, sf).filter(f"event_id % {mod} = 0 AND t > 0").select("k", F.col("t").cast("long").alias("cp"))


def _sizes(spark, sf) -> DataFrame:
    return series.lengths(events(spark, sf), KEY)


POINTS = "c AS (SELECT k, t AS cp FROM e WHERE event_id % {a} = 0 AND t > 0), z AS (SELECT k, count(*) AS n FROM e GROUP BY k)"
ISLANDS = """g AS (SELECT k, cp, n, CASE WHEN cp - lag(cp) OVER w {far} 0.005 * n OR lag(cp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM c JOIN z USING (k) WINDOW w AS (PARTITION BY k ORDER BY cp)),
    i AS (SELECT k, cp, sum(new) OVER (PARTITION BY k ORDER BY cp) AS run FROM g)"""


def trim_open(spark, sf):
    return post.trim(_points(spark, sf, 37), _sizes(spark, sf), KEY, 0.1, closed=False)


def trim_closed(spark, sf):
    return post.trim(_points(spark, sf, 37), _sizes(spark, sf), KEY, 0.1, closed=True)


def merge_runs(spark, sf):
    return post.merge_runs(_points(spark, sf, 37), _sizes(spark, sf), KEY, 0.005)


def merge_pairs(spark, sf):
    return post.merge_pairs(_points(spark, sf, 37), _sizes(spark, sf), KEY, 0.005)


def min_length(spark, sf):
    return post.min_length(_points(spark, sf, 37), _sizes(spark, sf), KEY, 10)


def segment_lengths(spark, sf):
    return views.segment_lengths(segments_from_cps(spark, sf), KEY)


def detection_view(spark, sf):
    return views.detection_view(events(spark, sf), segments_from_cps(spark, sf), KEY, ["v"])


def segments_from_cps(spark, sf):
    return post.segments(_points(spark, sf, 37), _sizes(spark, sf), KEY)


def label_rows(spark, sf):
    return post.label(events(spark, sf), segments_from_cps(spark, sf), KEY).select("k", "t", "seg_id")


# --- metrics ----------------------------------------------------------------------------------------------------------


def _sides(spark, sf):
    return _points(spark, sf, 37), _points(spark, sf, 41), _sizes(spark, sf)


def hausdorff(spark, sf):
    return M.hausdorff_distance(*_sides(spark, sf), KEY)


def rand_index(spark, sf):
    return M.adjusted_rand_index(*_sides(spark, sf), KEY).select("k", F.round("rand_index", 9).alias("rand_index"), F.round("true_ari", 9).alias("true_ari"))


def nearest(spark, sf):
    true, pred, _ = _sides(spark, sf)
    return M.nearest(true, pred, KEY).select("k", "cp", "distance")


def tolerance_pairs(spark, sf):
    true, pred, _ = _sides(spark, sf)
    return M.tolerance_pairs(true, pred, KEY, 10)


def _spaced(spark, sf):
    """True points every 50 rows, predicted ones up to 9 rows later for two of three: no point has two partners."""
    rows = series.cut(events(spark, sf).select("k", "t"), "events")  # read by each side of each metric
    true = rows.filter("t % 50 = 25").select("k", F.col("t").alias("cp"))
    pred = true.filter("cp % 3 <> 0").select("k", (F.col("cp") + F.floor(F.col("cp") / 50) % 10).alias("cp"))
    return true, pred, series.lengths(rows, KEY)


def precision_recall(spark, sf):
    true, pred, n = _spaced(spark, sf)
    out = M.precision_recall(true, pred, n, KEY, 4)
    return out.select("k", "n_true", "n_pred", "tp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def f_beta(spark, sf):
    true, pred, n = _spaced(spark, sf)
    return M.f_beta_score(true, pred, n, KEY, 2.0, 6).select("k", F.round("f_beta", 9).alias("f_beta"), F.round("f0_5", 9).alias("f0_5"))


def margin_sweep(spark, sf):
    true, pred, n = _spaced(spark, sf)
    return M.margin_sweep(true, pred, n, KEY, (1, 5, 10)).select("k", "margin", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def annotation_error(spark, sf):
    out = M.annotation_error(*_spaced(spark, sf), KEY)
    return out.select("k", *[F.round(c, 9).alias(c) for c in ("error", "mae", "mse", "rmse", "median_ae", "max_error", "min_error", "mean_error", "std_error")], "n_matched")


def _notes(true: DataFrame) -> DataFrame:
    return true.withColumn("annotator_id", F.explode(F.array(F.lit(0), F.lit(1)))).filter("annotator_id = 0 OR cp % 4 <> 1")


def covering(spark, sf):
    true, pred, n = _spaced(spark, sf)
    notes = _notes(true)
    out = M.covering_metric(notes, notes.select("k", "annotator_id").distinct(), pred, KEY, 10)
    return out.select("k", *[F.round(c, 9).alias(c) for c in ("covering", "std_recall", "min_recall", "max_recall")], "n_annotators")


def evaluate_all(spark, sf):
    out = M.evaluate_all(*_spaced(spark, sf), KEY)
    return out.select("k", *[F.round(f"{a}.{b}", 9).alias(b) for a, b in (("point", "precision"), ("point", "recall"), ("point", "f1"), ("distance", "hausdorff"), ("annotation", "mae"), ("segmentation", "rand_index"))])


def unmatched(spark, sf):
    true, pred, _ = _spaced(spark, sf)
    return M.unmatched(true, M.matches(true, pred, KEY, 4), KEY, "true")


def annotator_view(spark, sf):
    return views.annotator_view(_notes(_spaced(spark, sf)[0]), KEY)


def union_of_annotators(spark, sf):
    return M.union_of_annotators(_notes(_spaced(spark, sf)[0]), KEY)


def metric_comparison(spark, sf):
    return views.metric_comparison(precision_recall(spark, sf), KEY, ["precision", "recall", "n_true"])


# --- views and sources ------------------------------------------------------------------------------------------------


def histogram50(spark, sf):
    return views.histogram(events(spark, sf), KEY, "v", 50).select("k", "bin", "count")


def auc(spark, sf):
    rows = read(spark, sf, "labels").join(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.lit("all").alias("k"), F.col("n_chars").cast("double").alias("score"), "toxic")
    return views.auc(rows, KEY, "score", "toxic").select("k", F.round("auc", 9).alias("auc"))


def generate(kind: str, **options):
    return lambda spark, sf: generators.generate(spark, kind, series=20, n=300, k=2, seed=7, **options).rows


def detect_generated(spark, sf):
    data = generators.generate(spark, "mean", series=20, n=300, k=2, seed=7)
    found = D.mean(data.rows, "series_id", "t", "v").change_points
    return M.precision_recall(data.truth, found, series.lengths(data.rows, ["series_id"]), ["series_id"])


def long_series(spark, sf):
    rows = read(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("at"), (F.col("l_quantity") + F.when(F.col("l_orderkey") % 3000 >= 1500, 30).otherwise(0)).alias("v"))
    return L.detect_long(rows.groupBy("at").agg(F.avg("v").alias("v")), "at", "v", chunk=5_000)


def _custom(segment) -> float:
    return float(((segment - segment.mean(0)) ** 2).sum()) / 200


def monthly(spark, sf) -> DataFrame:
    """(k, t, price, x1, x2, c): months of ``lineitem`` by return flag and line status."""
    month = F.date_trunc("month", F.to_date("l_shipdate"))
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k"), month.alias("m")).agg((F.sum(F.floor("l_extendedprice")) / F.count("*") / 1000).alias("price"), F.avg("l_quantity").alias("x1"), (F.avg("l_discount") * 100).alias("x2"), F.count("*").alias("c"))
    return series.index(rows, KEY, ["m"])


def regression(family: str, x=("x1", "x2"), **options):
    """Months with a planted change at row 15: of the slope's sign in a binary response (every seventh flipped), of the
    level in a count, of the level of a price."""

    def run(spark, sf):
        rows, late = monthly(spark, sf), F.col("t") >= 15
        up = (F.col("x1") > 25.5) != late
        y = {"binomial": F.when(F.col("t") % 7 == 3, ~up).otherwise(up).cast("double"), "poisson": (F.col("c") % 3 + F.when(late, 9).otherwise(0)).cast("double")}.get(family, F.col("price") + F.when(late, 40.0).otherwise(0.0))
        return D.detect(rows.select("k", "t", y.alias("y"), *x), "k", "t", "y", list(x), family=family, **options).raw_change_points

    return run


def garch_months(spark, sf):
    rows = months(spark, sf).select("k", "t", ((F.col("v") % 50 - 25) * F.when(F.col("t").between(30, 49), 8.0).otherwise(1.0)).alias("v"))
    return D.garch(rows, "k", "t", "v", order=(1, 1), beta=4.0).raw_change_points


def grid(spark, sf):
    return D.detect_grid(months(spark, sf), "k", "t", "v", [2.0, 10.0, 50.0])


QUERIES: dict = {
    "series_index": series_index, "prefix_stats": prefix_stats, "prefix_sums_long": prefix_sums_long, "first_diff": first_diff, "lag_matrix_ar": lag_matrix_ar, "lag_matrix_var": lag_matrix_var,
    "ordinal_rank": ordinal_rank, "presegment_buckets": presegment_buckets, "rice_variance": rice_variance, "sliding_sum": sliding_sum, "penalty_table": penalty_table,
    "segment_moments": segment_moments, "segment_cost_mean": segment_cost("mean"), "segment_cost_variance": segment_cost("variance"), "segment_cost_meanvariance": segment_cost("meanvariance"), "segment_energy": segment_energy, "ols_segment": ols_segment, "segment_summary": segment_summary, "residuals_mean": residuals_mean, "parameters_mean": parameters_mean, "summary_mean": summary_mean, "prefix_stats_products": prefix_stats_products, "rice_covariance": rice_covariance, "segment_moments_two": segment_moments_two, "whiten": whiten, "winsorise": winsorise, "even_bounds": even_bounds, "median_distance": median_distance,
    "pelt_mean": _detect("mean"), "pelt_mean_bic": _detect("mean", beta="BIC", cost_adjustment=None), "pelt_variance": _detect("variance", beta=1.0), "pelt_variance_plain": _detect("variance", beta=1.0, pruning="plain"), "pelt_lm_one": regression("lm", ("x1",)), "pelt_meanvariance": _detect("meanvariance"), "detect_mean": flagship,
    "pelt_rank": _detect("rank", beta=5.0), "pelt_rbf": _detect("rbf", beta=3.0), "pelt_custom": _detect("custom", beta=200.0, cost=_custom), "pelt_target": _detect("mean", target=2), "pelt_ar": _waves("ar", order=(1,)), "pelt_arma": _waves("arma", order=(1, 1)), "pelt_garch": garch_months,
    "pelt_var": lambda spark, sf: D.detect(months(spark, sf).withColumn("w", F.col("t") % 7 + F.col("v") / 10), "k", "t", ["v", "w"], family="var", order=(1,)).raw_change_points,
    "pelt_lm": regression("lm"), "pelt_binomial": regression("binomial", vanilla_percentage=1.0), "pelt_poisson": regression("poisson", vanilla_percentage=1.0), "pelt_lasso": regression("lasso", vanilla_percentage=1.0), "segd_binomial": regression("binomial", vanilla_percentage=0.0), "segd_poisson": regression("poisson", vanilla_percentage=0.5), "segd_lasso": regression("lasso", vanilla_percentage=0.0),
    "beta_grid": grid, "long_series": long_series,
    "trim_open": trim_open, "trim_closed": trim_closed, "merge_runs": merge_runs, "merge_pairs": merge_pairs, "min_length": min_length, "segments_from_cps": segments_from_cps, "label_rows": label_rows, "segment_lengths": segment_lengths, "detection_view": detection_view, "unmatched": unmatched, "annotator_view": annotator_view, "union_of_annotators": union_of_annotators, "metric_comparison": metric_comparison,
    "hausdorff": hausdorff, "rand_index": rand_index, "nearest": nearest, "tolerance_pairs": tolerance_pairs, "precision_recall": precision_recall, "f_beta": f_beta, "margin_sweep": margin_sweep, "annotation_error": annotation_error, "covering": covering, "evaluate_all": evaluate_all,
    "histogram50": histogram50, "auc": auc,
    "generate_mean": generate("mean"), "generate_variance": generate("variance"), "generate_regression": generate("regression"), "generate_arma": generate("arma"), "generate_glm": generate("glm"), "generate_garch": generate("garch"), "detect_generated": detect_generated,
}

W = "(PARTITION BY k ORDER BY t)"
BLOCKS = f"WITH {EVENTS}, b AS (SELECT *, (t // 100)::INTEGER AS seg_id FROM e)"
SIDES = f"WITH {EVENTS}, a AS (SELECT k, t AS cp FROM e WHERE event_id % 37 = 0 AND t > 0), b AS (SELECT k, t AS cp FROM e WHERE event_id % 41 = 0 AND t > 0), z AS (SELECT k, count(*) AS n FROM e GROUP BY k)"
SPACED = f"WITH {EVENTS}, a AS (SELECT k, t AS cp FROM e WHERE t % 50 = 25), b AS (SELECT k, cp + (cp // 50) % 10 AS cp FROM a WHERE cp % 3 <> 0), z AS (SELECT k, count(*) AS n FROM e GROUP BY k)"
#: Points are spaced so that every pair within the margin is a match.
RATIOS = "s AS (SELECT k, {m} AS margin, (SELECT count(*) FROM a WHERE a.k = z.k) AS n_true, (SELECT count(*) FROM b WHERE b.k = z.k) AS n_pred, (SELECT count(*) FROM a JOIN b USING (k) WHERE a.k = z.k AND abs(a.cp - b.cp) <= {m}) AS tp FROM z), pr AS (SELECT *, tp / n_pred AS p, tp / n_true AS r FROM s)"
SEGMENTS = "x AS (SELECT k, 0 AS s FROM z UNION SELECT k, cp FROM {c}), {name} AS (SELECT k, s, coalesce(lead(s) OVER (PARTITION BY k ORDER BY s), n) AS f FROM x JOIN z USING (k))"


def _noise_sql(beta: str, cost: str = MEAN_COST) -> str:
    return _dp(f"{MONTHS}, {NOISE}, y AS (SELECT e.k, t, v / sqrt(s2) AS x FROM e JOIN r USING (k))", "y", "x", "x * x", beta, cost)


def _spaced_ratio(margin: int, columns: str) -> str:
    return f"{SPACED}, {RATIOS.format(m=margin)} SELECT {columns} FROM pr"


MEAN = _pruned(f"{MONTHS}, {NOISE}, y AS (SELECT e.k, t, v / sqrt(s2) AS x FROM e JOIN r USING (k))", "y", ["x", "x * x"], "1.5 * ln(n)", f"((D2 - D1 * D1 / {LENGTH}) / 2 + ln({LENGTH}) / 2)", "ln(n) / 2") + f", {FINISHED}"
TWO = f"WITH {EVENTS}, e2 AS (SELECT *, (event_id % 1000)::DOUBLE AS w FROM e)"
#: Least squares on one predictor without intercept; the penalty is scaled by the noise of slopes of neighbouring pairs.
SLOPES = """h AS (SELECT *, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2, lead(y) OVER w AS y1, lead(y, 2) OVER w AS y2 FROM y WINDOW w AS (PARTITION BY k ORDER BY t)),
    h2 AS (SELECT k, x1, 1 / (x * x + x1 * x1) AS ga, 1 / (x1 * x1 + x2 * x2) AS gb, (x * y + x1 * y1) / (x * x + x1 * x1) AS ba, (x1 * y1 + x2 * y2) / (x1 * x1 + x2 * x2) AS bb FROM h WHERE x2 IS NOT NULL),
    s0 AS (SELECT k, avg((ba - bb) * (ba - bb) / (ga + gb - 2 * ga * x1 * x1 * gb)) AS s2 FROM h2 GROUP BY k)"""
ONE_SLOPE = f"CASE WHEN {LENGTH} < 2 THEN 0.0 ELSE (D3 - D2 * (D2 / D1)) / 2 END"


def _slope(before: str) -> str:
    return _pruned(f"{before}, {SLOPES}", "y", ["x * x", "x * y", "y * y"], "1.5 * ln(n) * s2", ONE_SLOPE, extra="JOIN s0 USING (k)")


def _grid_sql(beta: float) -> str:
    return _pruned(f"{MONTHS}, {NOISE}, y AS (SELECT e.k, t, v / sqrt(s2) AS x FROM e JOIN r USING (k))", "y", ["x", "x * x"], str(beta), f"((D2 - D1 * D1 / {LENGTH}) / 2 + ln({LENGTH}) / 2)", "ln(n) / 2") + f" SELECT k, {beta}::DOUBLE AS beta, cp FROM tr"


MONTHLY = "m AS (SELECT l_returnflag AS k, date_trunc('month', l_shipdate) AS m, sum(floor(l_extendedprice)) / count(*) / 1000 AS price, avg(l_quantity) AS x1 FROM lineitem GROUP BY ALL), y AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY m) - 1 AS t, x1 AS x, price + CASE WHEN row_number() OVER (PARTITION BY k ORDER BY m) - 1 >= 15 THEN 40.0 ELSE 0.0 END AS y FROM m)"
NOTES = "notes AS (SELECT k, cp, i AS annotator_id FROM a, (VALUES (0), (1)) v(i) WHERE i = 0 OR cp % 4 <> 1)"
PAIRS = "d AS (SELECT b.k, abs(a.cp - b.cp)::DOUBLE AS e, row_number() OVER (PARTITION BY b.k, b.cp ORDER BY abs(a.cp - b.cp)) AS i FROM a JOIN b USING (k)), er AS (SELECT k, avg(e) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, median(e) AS median_ae, max(e) AS max_error, min(e) AS min_error, stddev_pop(e) AS std_error, count(*) AS n_matched FROM d WHERE i = 1 GROUP BY k)"

SQL: dict = {
    "pelt_variance_plain": _pruned(f"{MONTHS}, y AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS x FROM e)", "y", ["x * x"], "1.0", f"({LENGTH} / 2.0 * ln(CASE WHEN D1 <= 0 THEN 1e-11 ELSE D1 END / {LENGTH}) + ln({LENGTH}) / 2)") + " SELECT k, cp FROM tr",
    "pelt_meanvariance": _pruned(MONTHS, "e", ["v", "v * v"], "2 * ln(n)", f"({LENGTH} / 2.0 * ln(CASE WHEN D2 - D1 * D1 / {LENGTH} <= 0 THEN 1e-11 ELSE D2 - D1 * D1 / {LENGTH} END / {LENGTH}) + ln({LENGTH}) / 2)", "ln(n) / 2") + " SELECT k, cp FROM tr",
    "pelt_rank": _pruned(f"{MONTHS}, y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v, t) - (count(*) OVER (PARTITION BY k) + 1) / 2 AS c FROM e), s0 AS (SELECT k, sum((c + 0.5) * (c + 0.5)) / count(*) * (1 + 1e-10) AS s FROM y GROUP BY k), y2 AS (SELECT k, t, c / sqrt(s) AS c FROM y JOIN s0 USING (k))", "y2", ["c"], "5.0", f"CASE WHEN {LENGTH} < 2 THEN 0.0 ELSE -(D1 * D1) / {LENGTH} END") + " SELECT k, cp FROM tr",
    "pelt_custom": _pruned(MONTHS, "e", ["v", "v * v"], "200.0", f"(D2 - D1 * D1 / {LENGTH}) / 200") + " SELECT k, cp FROM tr",
    "pelt_ar": _slope(f"{WAVES}, y AS (SELECT k, t - 1 AS t, v AS y, x FROM (SELECT *, lag(v) OVER (PARTITION BY k ORDER BY t) AS x FROM wv) WHERE t >= 1)") + " SELECT k, cp + 1 AS cp FROM tr",
    "pelt_lm_one": _slope(MONTHLY) + " SELECT k, cp FROM tr",
    "pelt_target": f"WITH {MONTHS}, {NOISE}, y AS (SELECT e.k, t + 1 AS t, sum(v / sqrt(s2)) OVER w AS s, sum(v * v / s2) OVER w AS q, count(*) OVER (PARTITION BY e.k) AS n FROM e JOIN r USING (k) WINDOW w AS (PARTITION BY e.k ORDER BY t)), b AS (SELECT i.k, i.t AS i, j.t AS j, (i.q - i.s * i.s / i.t + (j.q - i.q) - (j.s - i.s) * (j.s - i.s) / (j.t - i.t) + (f.q - j.q) - (f.s - j.s) * (f.s - j.s) / (f.n - j.t)) / 2 + (ln(i.t) + ln(j.t - i.t) + ln(f.n - j.t)) / 2 AS c FROM y i JOIN y j ON i.k = j.k AND i.t < j.t JOIN y f ON f.k = i.k AND f.t = f.n WHERE j.t < f.n), o AS (SELECT k, arg_min(i, c) AS i, arg_min(j, c) AS j FROM b GROUP BY k) SELECT k, unnest([i, j]) AS cp FROM o",
    "beta_grid": " UNION ALL ".join(f"SELECT * FROM ({_grid_sql(b)})" for b in (2.0, 10.0, 50.0)),
    "detect_mean": f"{MEAN} SELECT k, cp FROM f",
    "residuals_mean": f"{MEAN} SELECT k, t, seg_id, round(v - avg(v) OVER (PARTITION BY k, seg_id), 6) AS residual FROM sg",
    "summary_mean": f"{MEAN} SELECT k, (SELECT count(*) FROM f WHERE f.k = sz.k) AS n_change_points, 'mean' AS family FROM sz",
    "parameters_mean": f"{MEAN} SELECT k, seg_id, round(avg(v), 6) AS theta, round((sum(v * v / s2) - sum(v / sqrt(s2)) * sum(v / sqrt(s2)) / count(*)) / 2 + ln(count(*)) / 2, 5) AS cost FROM sg JOIN r USING (k) GROUP BY ALL",
    "prefix_stats_products": f"{TWO} SELECT k, t, sum(v) OVER w AS s_v, sum(w) OVER w AS s_w, sum(v * v) OVER w AS q_v_v, sum(v * w) OVER w AS q_v_w, sum(v * w) OVER w AS q_w_v, sum(w * w) OVER w AS q_w_w FROM e2 WINDOW w AS {W}",
    "rice_covariance": f"{TWO}, d AS (SELECT k, v - lag(v) OVER {W} AS a, w - lag(w) OVER {W} AS b FROM e2) SELECT k, round(sum(a * a) / (2 * (count(*) - 1)), 3) AS c_v_v, round(sum(a * b) / (2 * (count(*) - 1)), 3) AS c_v_w, round(sum(a * b) / (2 * (count(*) - 1)), 3) AS c_w_v, round(sum(b * b) / (2 * (count(*) - 1)), 3) AS c_w_w FROM d GROUP BY k",
    "segment_moments_two": f"{TWO} SELECT k, (t // 100)::INTEGER AS seg_id, count(*) AS length, round(avg(v), 4) AS mean_v, round(avg(w), 4) AS mean_w, round(covar_samp(v, w), 2) AS cov_v_w, round(var_samp(w), 2) AS cov_w_w FROM e2 GROUP BY ALL",
    "whiten": f"WITH {EVENTS}, {NOISE} SELECT k, t, round(v / sqrt(s2), 6) AS z FROM e JOIN r USING (k)",
    "winsorise": f"WITH {EVENTS} SELECT k, t, least(greatest(floor(v / 100) - 50, -20.0), 20.0) AS x FROM e",
    "even_bounds": f"WITH {EVENTS}, z AS (SELECT k, count(*) AS n FROM e GROUP BY k) SELECT k, i::INTEGER AS i, round(i * n / 10)::BIGINT AS bound FROM z, range(0, 11) r(i)",
    "median_distance": "WITH c AS (SELECT c_nationkey AS k, c_custkey, floor(c_acctbal) AS v FROM customer) SELECT a.k, median((a.v - b.v) * (a.v - b.v)) AS median_d2 FROM c a JOIN c b ON a.k = b.k AND a.c_custkey < b.c_custkey GROUP BY a.k",
    "min_length": f"""WITH RECURSIVE {EVENTS}, {POINTS.format(a=37)},
        st AS (
          SELECT k, list(cp ORDER BY cp) AS c, n, 0 AS round FROM c JOIN z USING (k) GROUP BY k, n
          UNION ALL
          SELECT k, [c[i] FOR i IN range(1, len(c) + 1) IF i <> CASE WHEN sz[f - 1] < sz[f + 1] THEN f - 1 ELSE f END], n, round + 1
          FROM (SELECT *, list_min([i FOR i IN range(2, len(sz)) IF sz[i] < 10]) AS f FROM (SELECT *, [list_extract(list_append(c, n), i) - CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END FOR i IN range(1, len(c) + 2)] AS sz FROM st))
          WHERE f IS NOT NULL
        )
        SELECT k, unnest(c) AS cp FROM (SELECT k, arg_max(c, round) AS c FROM st GROUP BY k)""",
    "segment_lengths": f"WITH {EVENTS}, {POINTS.format(a=37)}, {SEGMENTS.format(c='c', name='sg')} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INTEGER AS seg_id, f - s AS length FROM sg",
    "detection_view": f"WITH {EVENTS} SELECT k, t, v, (sum(CASE WHEN event_id % 37 = 0 AND t > 0 THEN 1 ELSE 0 END) OVER {W})::INTEGER AS seg_id, event_id % 37 = 0 AND t > 0 AS is_change FROM e",
    "unmatched": f"{SPACED} SELECT k, cp FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.k = a.k AND abs(a.cp - b.cp) <= 4)",
    "annotator_view": f"{SPACED}, {NOTES} SELECT k, cp, count(DISTINCT annotator_id) AS n_annotators FROM notes GROUP BY ALL",
    "union_of_annotators": f"{SPACED}, {NOTES} SELECT DISTINCT k, cp FROM notes",
    "metric_comparison": f"{SPACED}, {RATIOS.format(m=4)} SELECT k, 'Precision' AS metric, round(p, 9) AS value FROM pr UNION ALL SELECT k, 'Recall', round(r, 9) FROM pr UNION ALL SELECT k, 'N True', n_true::DOUBLE FROM pr",
    "annotation_error": f"{SPACED}, {PAIRS} SELECT k, {', '.join(f'round({x}, 9) AS {y}' for x, y in (('mae', 'error'), ('mae', 'mae'), ('mse', 'mse'), ('rmse', 'rmse'), ('median_ae', 'median_ae'), ('max_error', 'max_error'), ('min_error', 'min_error'), ('mae', 'mean_error'), ('std_error', 'std_error')))}, n_matched FROM er",
    "covering": f"{SPACED}, {NOTES}, h AS (SELECT n.k, annotator_id, count(DISTINCT n.cp) FILTER (b.cp IS NOT NULL) / count(DISTINCT n.cp) AS recall FROM notes n LEFT JOIN b ON b.k = n.k AND abs(n.cp - b.cp) <= 10 GROUP BY ALL) SELECT k, round(avg(recall), 9) AS covering, round(stddev_pop(recall), 9) AS std_recall, round(min(recall), 9) AS min_recall, round(max(recall), 9) AS max_recall, count(*) AS n_annotators FROM h GROUP BY k",
    "series_index": f"WITH {EVENTS} SELECT k, t, v, event_id FROM e",
    "prefix_stats": f"WITH {EVENTS} SELECT k, t, sum(v) OVER w AS s_v, sum(v * v) OVER w AS q FROM e WINDOW w AS {W}",
    "prefix_sums_long": "SELECT l_orderkey, l_linenumber, max(s) AS s FROM (SELECT *, sum(l_quantity) OVER (ORDER BY l_orderkey, l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS s FROM lineitem) GROUP BY ALL",
    "first_diff": f"WITH {EVENTS} SELECT k, t, v - lag(v) OVER {W} AS d FROM e",
    "lag_matrix_ar": f"WITH {EVENTS} SELECT * EXCLUDE (event_id) FROM (SELECT *, lag(v, 1) OVER w AS v_lag1, lag(v, 2) OVER w AS v_lag2 FROM e WINDOW w AS {W}) WHERE t >= 2",
    "lag_matrix_var": f"WITH {EVENTS} SELECT k, t, v, w, v_lag1, w_lag1 FROM (SELECT *, event_id::DOUBLE AS w, lag(v) OVER {W} AS v_lag1, lag(event_id::DOUBLE) OVER {W} AS w_lag1 FROM e) WHERE t >= 1",
    "ordinal_rank": f"WITH {EVENTS} SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY v, t) AS rank FROM e",
    "presegment_buckets": f"WITH {EVENTS} SELECT k, t, CASE WHEN n < 10 THEN 9 ELSE least(t // (n // 10), 9) END::INTEGER AS bucket FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM e)",
    "rice_variance": f"WITH {EVENTS}, {NOISE} SELECT k, round(s2, 4) AS rice_variance FROM r",
    "sliding_sum": f"WITH {EVENTS} SELECT k, t, sum(v) OVER (PARTITION BY k ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM e",
    "penalty_table": f"WITH {EVENTS}, z AS (SELECT k, count(*) AS n FROM e GROUP BY k) SELECT k, round(3 * ln(n) / 2, 6) AS mean_mbic, round(ln(n) / 2, 6) AS mean_bic, round(ln(n) / 2, 6) AS mean_mdl, round(3 * ln(n) / 2, 6) AS lm_mbic, round(ln(n), 6) AS lm_bic, round(3 * log2(n) / 2, 6) AS lm_mdl FROM z",
    "segment_moments": f"{BLOCKS} SELECT k, seg_id, count(*) AS length, round(avg(v), 4) AS mean_v, round(var_samp(v), 2) AS cov_v_v FROM b GROUP BY ALL",
    "segment_cost_mean": f"{BLOCKS} SELECT k, seg_id, round((sum(v * v) - sum(v) * sum(v) / count(*)) / 2, 3) AS cost FROM b GROUP BY ALL",
    "segment_cost_variance": f"{BLOCKS}, m AS (SELECT k, avg(v) AS c FROM e GROUP BY k) SELECT k, seg_id, round(count(*) / 2.0 * ln(greatest(sum((v - c) * (v - c)), 1e-11) / count(*)), 3) AS cost FROM b JOIN m USING (k) GROUP BY ALL",
    "segment_cost_meanvariance": f"{BLOCKS} SELECT k, seg_id, round(count(*) / 2.0 * ln(greatest(var_pop(v), 1e-11)), 3) AS cost FROM b GROUP BY ALL",
    "segment_energy": f"{BLOCKS} SELECT k, seg_id, round(avg(v * v), 2) AS energy FROM b GROUP BY ALL",
    "ols_segment": "SELECT l_returnflag AS k, month(l_shipdate)::INTEGER AS seg_id, round(sum(l_quantity * y) / sum(l_quantity * l_quantity), 6) AS slope, round((sum(y * y) - sum(l_quantity * y) * sum(l_quantity * y) / sum(l_quantity * l_quantity)) / 1e6, 2) AS rss_millions FROM (SELECT *, floor(l_extendedprice) AS y FROM lineitem) GROUP BY ALL",
    "segment_summary": f"{BLOCKS} SELECT k, seg_id, count(*) AS length, round(avg(v), 4) AS mean, round(kurtosis_pop(v), 6) AS kurtosis, round(var_pop(v) / avg(v), 4) AS overdispersion FROM b GROUP BY ALL",
    "pelt_mean": _noise_sql("(1.5 * ln(d.n))"),
    "pelt_mean_bic": _noise_sql("(0.5 * ln(d.n))", MEAN_COST.replace(f" + ln({LENGTH}) / 2", "")),
    "pelt_variance": _dp(f"{MONTHS}, y AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS x FROM e)", "y", "x", "x * x", "1.0", VARIANCE_COST),
    "trim_open": f"WITH {EVENTS}, {POINTS.format(a=37)} SELECT k, cp FROM c JOIN z USING (k) WHERE cp > 0.1 * n AND cp < (1 - 0.1) * n",
    "trim_closed": f"WITH {EVENTS}, {POINTS.format(a=37)} SELECT k, cp FROM c JOIN z USING (k) WHERE cp >= 0.1 * n AND cp <= (1 - 0.1) * n",
    "merge_runs": f"WITH {EVENTS}, {POINTS.format(a=37)}, {ISLANDS.format(far='>')} SELECT k, (min(cp) + max(cp)) // 2 AS cp FROM i GROUP BY k, run",
    "merge_pairs": f"WITH {EVENTS}, {POINTS.format(a=37)}, {ISLANDS.format(far='>=')}, o AS (SELECT *, row_number() OVER (PARTITION BY k, run ORDER BY cp) AS j, count(*) OVER (PARTITION BY k, run) AS m FROM i) SELECT k, sum(cp)::BIGINT // count(*) AS cp FROM o GROUP BY k, run, m, (j - 1) // 2 HAVING count(*) = 2 OR m = 1",
    "segments_from_cps": f"WITH {EVENTS}, {POINTS.format(a=37)}, {SEGMENTS.format(c='c', name='sg')} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INTEGER AS seg_id, s AS start, f AS \"end\" FROM sg",
    "label_rows": f"WITH {EVENTS} SELECT k, t, (sum(CASE WHEN event_id % 37 = 0 AND t > 0 THEN 1 ELSE 0 END) OVER {W})::INTEGER AS seg_id FROM e",
    "hausdorff": f"{SIDES}, d AS (SELECT a.k, a.cp AS x, b.cp AS y, abs(a.cp - b.cp) AS d FROM a JOIN b USING (k)), f AS (SELECT k, max(m)::DOUBLE AS forward FROM (SELECT k, x, min(d) AS m FROM d GROUP BY ALL) GROUP BY k), g AS (SELECT k, max(m)::DOUBLE AS backward FROM (SELECT k, y, min(d) AS m FROM d GROUP BY ALL) GROUP BY k) SELECT k, forward, backward, greatest(forward, backward) AS hausdorff FROM f JOIN g USING (k)",
    "rand_index": f"{SIDES}, {SEGMENTS.format(c='a', name='sa')}, {SEGMENTS.format(c='b', name='sb').replace('x AS', 'x2 AS').replace('FROM x JOIN', 'FROM x2 JOIN')}, o AS (SELECT sa.k, sa.f AS fa, sb.f AS fb, least(sa.f, sb.f) - greatest(sa.s, sb.s) AS w FROM sa JOIN sb ON sa.k = sb.k AND sa.s < sb.f AND sb.s < sa.f), u AS (SELECT k, sum(w * abs(fa - fb)) AS d, sum(w * (w - 1) / 2) AS ij FROM o GROUP BY k), i AS (SELECT k, sum((f - s) * (f - s - 1) / 2) AS i FROM sa GROUP BY k), j AS (SELECT k, sum((f - s) * (f - s - 1) / 2) AS j FROM sb GROUP BY k), q AS (SELECT k, n * (n - 1) / 2 AS n2 FROM z) SELECT k, round(1 - d / n2, 9) AS rand_index, round((ij - i * j / n2) / ((i + j) / 2 - i * j / n2), 9) AS true_ari FROM u JOIN i USING (k) JOIN j USING (k) JOIN q USING (k)",
    "nearest": f"{SIDES} SELECT a.k, a.cp, min(abs(a.cp - b.cp)) AS distance FROM a JOIN b USING (k) GROUP BY ALL",
    "tolerance_pairs": f"{SIDES} SELECT a.k, a.cp AS true_cp, b.cp AS pred_cp, abs(a.cp - b.cp) AS distance FROM a JOIN b USING (k) WHERE abs(a.cp - b.cp) <= 10",
    "precision_recall": _spaced_ratio(4, "k, n_true, n_pred, tp, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1"),
    "f_beta": _spaced_ratio(6, "k, round(5 * p * r / (4 * p + r), 9) AS f_beta, round(1.25 * p * r / (0.25 * p + r), 9) AS f0_5"),
    "margin_sweep": " UNION ALL ".join(f"SELECT * FROM ({_spaced_ratio(m, 'k, margin, round(p, 9) AS precision, round(r, 9) AS recall')})" for m in (1, 5, 10)),
    "histogram50": f"WITH {EVENTS}, l AS (SELECT k, min(v) AS lo, (max(v) - min(v)) / 50 AS w FROM e GROUP BY k) SELECT k, CASE WHEN w = 0 THEN 0 ELSE least(floor((v - lo) / w), 49) END::INTEGER AS bin, count(*) AS count FROM e JOIN l USING (k) GROUP BY ALL",
    "auc": "WITH x AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2 AS r FROM labels JOIN documents USING (doc_id)) SELECT 'all' AS k, round((sum(CASE WHEN toxic = 1 THEN r ELSE 0 END) - sum(toxic) * (sum(toxic) + 1) / 2) / (sum(toxic) * (count(*) - sum(toxic))), 9) AS auc FROM x",
}
SQL["evaluate_all"] = (
    f"SELECT k, precision, recall, f1, round(hausdorff, 9) AS hausdorff, mae, rand_index FROM ({_spaced_ratio(10, 'k, round(p, 9) AS precision, round(r, 9) AS recall, round(2 * p * r / (p + r), 9) AS f1')})"
    f" JOIN ({SQL['hausdorff'].replace(SIDES, SPACED)}) USING (k) JOIN (SELECT k, mae FROM ({SQL['annotation_error']})) USING (k) JOIN (SELECT k, rand_index FROM ({SQL['rand_index'].replace(SIDES, SPACED)})) USING (k)"
)
