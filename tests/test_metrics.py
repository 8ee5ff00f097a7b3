"""Metrics: documented values, every empty edge, and brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from breakline.operators import metrics as M
from breakline.operators import pairs

K = ["k"]


def sides(spark, **series):
    """name=(true, pred, n)"""
    t = spark.createDataFrame([(k, c) for k, (a, _, _) in series.items() for c in a], "k string, cp long")
    p = spark.createDataFrame([(k, c) for k, (_, b, _) in series.items() for c in b], "k string, cp long")
    return t, p, spark.createDataFrame([(k, n) for k, (_, _, n) in series.items()], "k string, n long")


def by_key(df):
    return {r["k"]: r for r in df.collect()}


def test_documented_values(spark):
    t, p, n = sides(spark, a=([100, 200, 300], [98, 205, 299, 350], 400), b=([100, 200, 300], [105, 200, 400], 500), c=([100, 200, 300], [98, 205, 295], 400), d=([100, 200], [100, 200], 300))
    pr = by_key(M.precision_recall(t, p, n, K))
    assert (pr["a"].precision, pr["a"].recall) == (0.75, 1.0)
    assert by_key(M.hausdorff_distance(t, p, n, K))["b"].hausdorff == 100
    assert by_key(M.annotation_error(t, p, n, K))["c"].mae == 4.0
    assert by_key(M.adjusted_rand_index(t, p, n, K))["d"].rand_index == 1.0


def test_empty_edges(spark):
    t, p, n = sides(spark, none=([], [], 50), no_true=([], [10], 50), no_pred=([10], [], 50))
    pr = by_key(M.precision_recall(t, p, n, K))
    assert [(pr[k].precision, pr[k].recall, pr[k].f1) for k in ("none", "no_true", "no_pred")] == [(1, 1, 1), (0, 1, 0), (1, 0, 0)]
    h = by_key(M.hausdorff_distance(t, p, n, K))
    assert h["none"].hausdorff == 0 and math.isinf(h["no_true"].hausdorff) and math.isinf(h["no_pred"].hausdorff)
    assert all(math.isnan(r.error) for r in M.annotation_error(t, p, n, K).collect())
    assert by_key(M.adjusted_rand_index(t, p, n, K))["none"].rand_index == 1
    for bad in (0, -1):
        with pytest.raises(ValueError):
            M.precision_recall(t, p, n, K, bad)
    with pytest.raises(ValueError):
        M.annotation_error(t, p, n, K, "nope")


def greedy(t, p, margin):
    pairs, out = sorted((abs(a - b), a, b) for a in t for b in p if abs(a - b) <= margin), []
    for d, a, b in pairs:
        if not any(a == x or b == y for _, x, y in out):
            out.append((d, a, b))
    return out


def test_against_brute_force(spark):
    rng = np.random.default_rng(0)
    series = {f"s{i}": (sorted(set(rng.integers(1, 200, rng.integers(1, 12)).tolist())), sorted(set(rng.integers(1, 200, rng.integers(1, 12)).tolist())), 200) for i in range(40)}
    t, p, n = sides(spark, **series)
    pr, h, ri, err = (by_key(f) for f in (M.precision_recall(t, p, n, K, 15), M.hausdorff_distance(t, p, n, K), M.adjusted_rand_index(t, p, n, K), M.annotation_error(t, p, n, K)))
    for k, (a, b, size) in series.items():
        assert pr[k].tp == len(greedy(a, b, 15))
        assert h[k].hausdorff == max(max(min(abs(x - y) for y in b) for x in a), max(min(abs(x - y) for x in a) for y in b))
        la, lb = (np.searchsorted(c, np.arange(size), "right") for c in (a, b))
        same_a, same_b = la[:, None] == la, lb[:, None] == lb
        agree = np.triu(same_a == same_b, 1).sum() / (size * (size - 1) / 2)
        ends = [(x, y) for x, y in zip(np.r_[a, size][la], np.r_[b, size][lb], strict=True)]
        want = 1 - sum(abs(x - y) for x, y in ends) / (size * (size - 1) / 2)
        assert abs(ri[k].rand_index - want) < 1e-9 and 0 <= agree <= 1
        distances = [d for d, _, _ in greedy(a, b, 10**6)]
        assert abs(err[k].rmse - np.sqrt(np.mean(np.square(distances)))) < 1e-9 and abs(err[k].median_ae - np.median(distances)) < 1e-9


@pytest.mark.parametrize("few", [0, 200_000])
@pytest.mark.parametrize("margin", [None, 1, 7, 60])
def test_closest_pairs_are_the_greedy_ones(spark, monkeypatch, few, margin):
    """Rounds of mutual choice and the heap, on random, dense, tied, nested and empty sides."""
    monkeypatch.setattr(pairs, "FEW", few)
    rng = np.random.default_rng(4)
    draw = lambda n, top: sorted(set(rng.integers(0, top, n).tolist()))
    series = {f"r{i}": (draw(15, 100), draw(rng.integers(1, 20), 100), 100) for i in range(25)}
    series |= {"nested": (list(range(0, 30)), list(range(31, 61)), 99), "ties": (list(range(0, 60, 4)), list(range(2, 62, 4)), 99), "same": ([5, 9], [5, 9], 99), "shrinking": ([0, 50, 80, 95], [30, 68, 89, 99], 99), "one": ([7], [], 9)}
    t, p, _ = sides(spark, **series)
    got = {k: [] for k in series}
    for r in pairs.closest_pairs(t, p, K, margin).collect():
        got[r.k].append((r.distance, r.true_cp, r.pred_cp))
    for k, (a, b, _) in series.items():
        assert sorted(got[k]) == sorted(greedy(a, b, 10**9 if margin is None else margin)), k


def test_a_million_points_of_one_series(spark):
    """Without a pair table: both sides of one series, true points every 7 rows, predicted ones around every 8."""
    t = spark.range(500_000).select(F.lit("a").alias("k"), (F.col("id") * 7).alias("cp"))
    p = spark.range(500_000).select(F.lit("a").alias("k"), (F.col("id") * 8 + F.pmod(F.xxhash64("id"), F.lit(5))).alias("cp"))
    got = pairs.closest_pairs(t, p, K, 3)
    n, d, least, a, b = got.agg(F.count("*"), F.max("distance"), F.min("distance"), F.countDistinct("true_cp"), F.countDistinct("pred_cp")).first()
    assert n == a == b and 300_000 < n < 437_501 and d == 3 and least == 0


def test_covering_and_all(spark):
    notes = spark.createDataFrame([("a", i, c) for i, s in enumerate(([100, 200], [98, 202], [102, 198])) for c in s], "k string, annotator_id long, cp long")
    pred, n = spark.createDataFrame([("a", 100), ("a", 200)], "k string, cp long"), spark.createDataFrame([("a", 300)], "k string, n long")
    who = notes.select("k", "annotator_id").distinct().union(spark.createDataFrame([("a", 9)], "k string, id long"))
    out = M.covering_metric(notes, who, pred, K, 5).first()
    assert out.covering == 1.0 and out.n_annotators == 4
    row = M.evaluate_all(notes, pred, n, K).first()
    assert row.covering.covering == 1.0 and row.summary.startswith("precision")


def test_validation_raises(spark):
    n = spark.createDataFrame([("a", 50)], "k string, n long")
    for bad in ([5, 5], [60], [None]):
        cps = spark.createDataFrame([("a", c) for c in bad], "k string, cp long")
        with pytest.raises(Exception, match="change point"):
            M.validated(cps, n, K).collect()
    assert M.validated(spark.createDataFrame([("a", 5), ("a", 9)], "k string, cp long"), n, K).count() == 2


def test_best_beta_and_sweep(spark):
    t, p, n = sides(spark, a=([50], [49, 80], 100))
    grid = spark.createDataFrame([("a", 1.0, 49), ("a", 1.0, 80), ("a", 5.0, 50)], "k string, beta double, cp long")
    assert M.best_beta(grid, t, n, K).first().beta == 5.0
    assert M.margin_sweep(t, p, n, K, (1, 5)).count() == 2
