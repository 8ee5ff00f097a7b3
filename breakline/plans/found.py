"""Post-processing and metrics on change points that detection found: those of a low penalty on the mean as the truth, those
of the mean and spread as predictions. Points of one side cross, tie and have several partners on the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import metrics as M
from ..operators import pairs, post, series, views
from ..sources import generators
from . import catalog, recursions
from .catalog import KEY, months

LOW = 0.5


def sides(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """True and predicted change points of the months by priority, and the series' lengths."""
    rows = months(spark, sf)
    true = D.detect(rows, "k", "t", "v", family="mean", beta=LOW).raw_change_points
    pred = D.detect(rows, "k", "t", "v", family="meanvariance").raw_change_points
    return series.cut(true, "true"), series.cut(pred, "pred"), series.lengths(rows, KEY)


def found_matches(spark, sf):
    true, pred, _ = sides(spark, sf)
    return M.matches(true, pred, KEY, 5)


def found_closest_pairs(spark, sf):
    true, pred, _ = sides(spark, sf)
    return pairs.closest_pairs(true, pred, KEY)


def found_precision_recall(spark, sf):
    out = M.precision_recall(*sides(spark, sf), KEY, 3)
    return out.select("k", "n_true", "n_pred", "tp", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


def found_margin_sweep(spark, sf):
    out = M.margin_sweep(*sides(spark, sf), KEY, (1, 2, 5, 10))
    return out.select("k", "margin", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


def found_annotation_error(spark, sf):
    out = M.annotation_error(*sides(spark, sf), KEY, "rmse")
    return out.select("k", *[F.round(c, 9).alias(c) for c in ("error", "mae", "median_ae", "max_error", "std_error")], "n_matched")


def found_hausdorff(spark, sf):
    return M.hausdorff_distance(*sides(spark, sf), KEY)


def found_rand_index(spark, sf):
    return M.adjusted_rand_index(*sides(spark, sf), KEY).select("k", F.round("rand_index", 9).alias("rand_index"), F.round("true_ari", 9).alias("true_ari"))


def found_unmatched(spark, sf):
    true, pred, _ = sides(spark, sf)
    return M.unmatched(true, M.matches(true, pred, KEY, 2), KEY, "true")


def found_nearest(spark, sf):
    true, pred, _ = sides(spark, sf)
    return M.nearest(true, pred, KEY).select("k", "cp", "distance")


def found_trimmed(spark, sf):
    true, _, n = sides(spark, sf)
    return post.trim(true, n, KEY, 0.1, closed=False)


def found_merged(spark, sf):
    true, _, n = sides(spark, sf)
    return post.merge_runs(true, n, KEY, 0.05)


def found_segments(spark, sf):
    true, _, n = sides(spark, sf)
    return post.segments(true, n, KEY)


def found_view(spark, sf):
    _, pred, n = sides(spark, sf)
    return views.detection_view(months(spark, sf), post.segments(pred, n, KEY), KEY, ["v"])


def found_noisy_annotations(spark, sf):
    """Four annotators who see nine of ten found points, some rows off."""
    true, _, _ = sides(spark, sf)
    return views.annotator_view(generators.annotation_noise(true, KEY, 4, 0.9, 2.0, 1), KEY)


QUERIES: dict = {f.__name__: f for f in (found_matches, found_closest_pairs, found_precision_recall, found_margin_sweep, found_annotation_error, found_hausdorff, found_rand_index, found_unmatched, found_nearest, found_trimmed, found_merged, found_segments, found_view, found_noisy_annotations)}

_TRUE = recursions.least(f"{catalog.MONTHS}, {catalog.NOISE}, y AS (SELECT e.k, t, v / sqrt(s2) AS v FROM e JOIN r USING (k))", recursions.priced("y", recursions.ONE, "(vv - v * v / m) / 2 + ln(m) / 2"), str(LOW))
SIDES = f"WITH RECURSIVE {catalog.MONTHS}, a AS ({_TRUE}), b AS ({recursions.SQL['pelt_meanvariance']}), z AS (SELECT k, count(*) AS n FROM e GROUP BY k)"
#: Greedy matching: the first of the pairs in order is taken, those that share a point with it go.
GREEDY = """, pq AS (SELECT k, list({{'d': abs(a.cp - b.cp), 'a': a.cp, 'b': b.cp}} ORDER BY abs(a.cp - b.cp), a.cp, b.cp) AS l FROM a JOIN b USING (k) {within} GROUP BY k),
    st AS (SELECT k, l, NULL::STRUCT(d BIGINT, a BIGINT, b BIGINT) AS x FROM pq UNION ALL SELECT k, [y FOR y IN l IF y.a <> l[1].a AND y.b <> l[1].b], l[1] FROM st WHERE len(l) > 0),
    m AS (SELECT k, x.a AS true_cp, x.b AS pred_cp, x.d AS distance FROM st WHERE x IS NOT NULL)"""


def _greedy(margin: int | None) -> str:
    return SIDES + GREEDY.format(within="" if margin is None else f"WHERE abs(a.cp - b.cp) <= {margin}")


def _ratios(margin: int) -> str:
    return _greedy(margin) + f", s AS (SELECT k, {margin} AS margin, (SELECT count(*) FROM a WHERE a.k = z.k) AS n_true, (SELECT count(*) FROM b WHERE b.k = z.k) AS n_pred, (SELECT count(*) FROM m WHERE m.k = z.k) AS tp FROM z), pr AS (SELECT *, CASE WHEN n_pred = 0 THEN 1.0 WHEN n_true = 0 THEN 0.0 ELSE tp / n_pred END AS p, CASE WHEN n_true = 0 THEN 1.0 WHEN n_pred = 0 THEN 0.0 ELSE tp / n_true END AS r FROM s)"


SQL: dict = {
    "found_matches": f"{_greedy(5)} SELECT * FROM m",
    "found_closest_pairs": f"{_greedy(None)} SELECT * FROM m",
    "found_precision_recall": f"{_ratios(3)} SELECT k, n_true, n_pred, tp, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9) AS f1 FROM pr",
    "found_margin_sweep": " UNION ALL ".join(f"SELECT * FROM ({_ratios(m)} SELECT k, margin, round(p, 9) AS precision, round(r, 9) AS recall FROM pr)" for m in (1, 2, 5, 10)),
    "found_annotation_error": f"{_greedy(None)} SELECT k, round(sqrt(avg(distance * distance)), 9) AS error, round(avg(distance), 9) AS mae, round(median(distance), 9) AS median_ae, max(distance)::DOUBLE AS max_error, round(stddev_pop(distance), 9) AS std_error, count(*) AS n_matched FROM m GROUP BY k",
    "found_hausdorff": catalog.SQL["hausdorff"].replace(catalog.SIDES, SIDES),
    "found_rand_index": catalog.SQL["rand_index"].replace(catalog.SIDES, SIDES),
    "found_unmatched": f"{_greedy(2)} SELECT k, cp FROM a WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.k = a.k AND m.true_cp = a.cp)",
    "found_nearest": catalog.SQL["nearest"].replace(catalog.SIDES, SIDES),
    "found_trimmed": f"{SIDES} SELECT k, cp FROM a JOIN z USING (k) WHERE cp > 0.1 * n AND cp < 0.9 * n",
    "found_merged": f"{SIDES}, g AS (SELECT k, cp, CASE WHEN cp - lag(cp) OVER w > 0.05 * n OR lag(cp) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a JOIN z USING (k) WINDOW w AS (PARTITION BY k ORDER BY cp)) SELECT k, (min(cp) + max(cp)) // 2 AS cp FROM (SELECT k, cp, sum(new) OVER (PARTITION BY k ORDER BY cp) AS run FROM g) GROUP BY k, run",
    "found_segments": f"{SIDES}, {catalog.SEGMENTS.format(c='a', name='sg')} SELECT k, (row_number() OVER (PARTITION BY k ORDER BY s) - 1)::INTEGER AS seg_id, s AS start, f AS \"end\" FROM sg",
    "found_view": f"{SIDES} SELECT e.k, e.t, e.v, (SELECT count(*) FROM b WHERE b.k = e.k AND b.cp <= e.t)::INTEGER AS seg_id, EXISTS (SELECT 1 FROM b WHERE b.k = e.k AND b.cp = e.t) AS is_change FROM e",
}
