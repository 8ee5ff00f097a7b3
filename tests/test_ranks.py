"""Ranks, areas and medians of pair distances against brute force."""

from itertools import combinations

import numpy as np
import pytest

from breakline.operators import ranks


@pytest.mark.parametrize("listed", [64, 0])
def test_median_pair_distance(spark, monkeypatch, listed):
    """Whole numbers with ties, fractions, huge and tiny values, series of one row and of equal rows, nulls and NaNs."""
    if not listed:
        monkeypatch.setattr(ranks, "LISTED", 1)
    rng = np.random.default_rng(2)
    series = {"ints": rng.integers(0, 12, 150).astype(float), "floats": rng.normal(0, 1, 130), "even": rng.integers(-500, 500, 64).astype(float), "wide": np.r_[rng.normal(0, 1e-3, 60), rng.normal(1e7, 1, 60)], "equal": np.full(9, 3.0), "one": np.array([5.0]), "two": np.array([1.0, 4.5]), "mostly": np.r_[np.full(50, 2.0), 9.0, 11.0]}
    rows = [(k, float(v)) for k, x in series.items() for v in x] + [("ints", None), ("two", float("nan")), ("none", None), (None, 1.0), (None, 4.0)]
    got = {r.k: r.median_d2 for r in ranks.median_pair_distance(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert set(got) == {*series, None} and got["one"] is None and got[None] == 9.0
    for k, x in series.items():
        if len(x) > 1:
            want = np.median([(a - b) ** 2 for a, b in combinations(x, 2)])
            assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-18), k


def test_rank_long_and_auc(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{k % 3}" if k % 7 else None, float(rng.integers(0, 9)), k, int(rng.integers(0, 2))) for k in range(400)] + [("pure", 1.0, 1000, 1), ("pure", 2.0, 1001, 1)]
    df = spark.createDataFrame(rows, "k string, v double, t long, y int")
    got = {(r.k, r.t): r["rank"] for r in ranks.ordinal_rank_long(df, "v", ["t"], ["k"]).collect()}
    every = {r.t: r["rank"] for r in ranks.ordinal_rank_long(df, "v", ["t"]).collect()}
    assert every == {t: i + 1 for i, (_, t) in enumerate(sorted((v, t) for _, v, t, _ in rows))}
    area = {r.k: r.auc for r in ranks.auc(df, ["k"], "v", "y").collect()}
    for k in {r[0] for r in rows}:
        own = sorted((v, t, y) for s, v, t, y in rows if s == k)
        assert all(got[k, t] == i + 1 for i, (_, t, _) in enumerate(own))
        pos, neg = [v for v, _, y in own if y], [v for v, _, y in own if not y]
        assert area[k] == (pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])) if pos and neg else None)


def test_squared_distances_of_several_columns(spark):
    from breakline.operators.series import squared_distances

    rng = np.random.default_rng(5)
    series = {"a": rng.normal(size=(30, 2)), "b": rng.normal(size=(8, 2))}
    df = spark.createDataFrame([(k, t, [float(v) for v in r]) for k, x in series.items() for t, r in enumerate(x)], "k string, t long, f array<double>")
    for r in squared_distances(df, ["k"], "f").collect():
        assert r.median_d2 == pytest.approx(np.median([((a - b) ** 2).sum() for a, b in combinations(series[r.k], 2)]))
