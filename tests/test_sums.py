"""Fits, noise and whitening from sums against the fits that hold the rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from breakline.functions import costs, fits, sequential
from breakline.operators import detect as D
from breakline.operators import small
from breakline.operators.newton import glm_by_segment
from breakline.operators.series import index, index_long
from breakline.plans import catalog, sums


def table(spark, series, columns):
    """Rows (k, t, columns) of arrays by key."""
    return spark.createDataFrame([(k, t, *map(float, r)) for k, x in series.items() for t, r in enumerate(x)], "k string, t long, " + ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("family", ["binomial", "poisson"])
def test_newton_by_aggregates_equals_fits(spark, family):
    rng, series = np.random.default_rng(3), {}
    for i in range(6):
        x = rng.normal(size=(80 + i, 2))
        u = x @ rng.normal(size=2) + 0.3
        y = rng.random(len(x)) < 1 / (1 + np.exp(-u)) if family == "binomial" else rng.poisson(np.exp(u))
        series[f"s{i}" if i else None] = np.column_stack([y, x])
    series["flat"] = np.column_stack([np.ones(9), rng.normal(size=(9, 2))])  # one class: no optimum of the logit
    got = {r.k: r for r in glm_by_segment(table(spark, series, ["y", "a", "b"]), ["k"], "y", ["a", "b"], family).collect()}
    assert set(got) == set(series)
    for k, x in series.items():
        z = np.column_stack([np.ones(len(x)), x[:, 1:]])
        theta, loss = fits.glm(family, z, x[:, 0])
        assert got[k].loss <= loss + 1e-8
        if k != "flat":
            for _ in range(3):
                theta, loss = fits.glm(family, z, x[:, 0], theta)
            np.testing.assert_allclose(got[k].theta, theta, atol=1e-6)
            assert abs(got[k].loss - loss) < 1e-8


def test_parameters_and_residuals_of_logit_segments(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 1))
    y = rng.random(120) < 1 / (1 + np.exp(-np.where(np.arange(120) < 60, 3, -3) * x[:, 0]))
    d = D.logistic_regression(table(spark, {"a": np.column_stack([y, x])}, ["y", "x"]), "k", "t", "y", ["x"], vanilla_percentage=1.0)
    cuts = [0, *sorted(r.cp for r in d.change_points.collect()), 120]
    own = {r.seg_id: r for r in d.parameters().collect()}
    left = {r.t: r for r in d.residuals().collect()}
    assert len(cuts) > 2 and len(own) == len(cuts) - 1 and len(left) == 120
    for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        z = np.column_stack([np.ones(b - a), x[a:b]])
        assert own[s].cost <= fits.glm("binomial", z, y[a:b].astype(float))[1] + 1e-8
        for t in range(a, b):
            mean = 1 / (1 + np.exp(-np.clip(z[t - a] @ own[s].theta, -30, 30)))
            assert left[t].seg_id == s and left[t].residual == pytest.approx(y[t] - mean, abs=1e-9)


@pytest.mark.parametrize("p", [1, 2, 3])
def test_sliding_noise_equals_loop(spark, p):
    rng, series = np.random.default_rng(p), {}
    for k, n in (("a", 60), (None, 25), ("short", p), ("one", 1)):
        x = rng.normal(size=(n, p))
        series[k] = np.column_stack([x @ np.arange(1, p + 1) + rng.normal(size=n), x])
    series["repeats"] = np.column_stack([rng.normal(size=12), np.ones((12, p))])
    names = [f"x{i}" for i in range(p)]
    got = {r.k: r.noise for r in small.regression_noise(table(spark, series, ["y", *names]), ["k"], "y", names).collect()}
    for k, x in series.items():
        if k != "repeats" or p == 1:
            assert got[k] == pytest.approx(float(costs.noise(x[:, 0], x[:, 1:])[0, 0]), rel=1e-6), k


def test_lasso_noise_equals_fits(spark):
    rng, series = np.random.default_rng(5), {}
    for k, n in (("a", 200), (None, 73), ("few", 7), ("tiny", 2)):
        x = rng.normal(size=(n, 4))
        series[k] = np.column_stack([2 * x[:, 0] - x[:, 2] + rng.normal(size=n), x])
    series["zero"] = np.zeros((40, 5))
    got = {r.k: r for r in small.lasso_noise(table(spark, series, ["y", "a", "b", "c", "d"]), ["k"], "y", ["a", "b", "c", "d"]).collect()}
    for k, x in series.items():
        sigma, active = sequential.lasso_noise(x[:, 0], x[:, 1:], 10)
        assert got[k].sigma == pytest.approx(sigma, rel=1e-6) and got[k].active == pytest.approx(active), k


def test_whitening_of_several_columns(spark):
    rng = np.random.default_rng(6)
    series = {"a": rng.normal(size=(50, 3)) @ rng.normal(size=(3, 3)), None: rng.normal(size=(9, 3)), "one": np.ones((1, 3)), "same": np.repeat(rng.normal(size=(20, 1)), 3, 1)}
    got = small.whiten_columns(table(spark, series, ["x", "y", "z"]), ["k"], ["x", "y", "z"]).collect()
    for k, x in series.items():
        want = x @ np.linalg.cholesky(np.linalg.inv(costs.rice(x)))
        own = [[r.z_x, r.z_y, r.z_z] for r in sorted((r for r in got if r.k == k), key=lambda r: r.t)]
        np.testing.assert_allclose(own, want, rtol=1e-4 if k == "same" else 1e-8, atol=1e-9)


@pytest.mark.parametrize("family", ["mean", "variance", "meanvariance"])
@pytest.mark.parametrize("adjust", ["MBIC", "MDL", None])
def test_parameters_of_several_columns_come_from_sums(spark, family, adjust):
    """Each segment as the recursion prices it: the series' noise or mean, the segment's sums."""
    rng = np.random.default_rng(8)
    series = {k: np.r_[rng.normal(0, 1, (40, 2)), rng.normal(9, 4, (40, 2))] for k in ("a", "b")}
    d = D.detect(table(spark, series, ["x", "y"]), "k", "t", ["x", "y"], family=family, cost_adjustment=adjust)
    cps, own = d.change_points.collect(), d.parameters().collect()
    for k, x in series.items():
        cuts = [0, *sorted(r.cp for r in cps if r.k == k), 80]
        cost = costs.Moment(x, family, None)
        rows = sorted((r for r in own if r.k == k), key=lambda r: r.seg_id)
        assert len(rows) == len(cuts) - 1 >= 2
        for r, a, b in zip(rows, cuts, cuts[1:], strict=False):
            p = {"mean": 2, "variance": 4, "meanvariance": 6}[family]
            want = (cost.raw(np.array([a]), b)[0] + (p * np.log(b - a) / 2 if adjust else 0)) * (np.log2(np.e) if adjust == "MDL" else 1)
            assert r.cost == pytest.approx(want, rel=1e-8)
            np.testing.assert_allclose(r.theta[:2] if family != "variance" else np.reshape(r.theta, (2, 2)), x[a:b].mean(0) if family != "variance" else np.cov(x[a:b].T), atol=1e-9)


def test_regression_noise_in_runs_of_rows(spark, monkeypatch):
    """Runs of a few rows give what the whole series gives, at their borders too."""
    rng = np.random.default_rng(8)
    series = {k: np.column_stack([rng.normal(size=n), rng.normal(size=(n, 2))]) for k, n in (("a", 101), (None, 40), ("c", 3))}
    monkeypatch.setattr(small, "RUN", 5)
    got = {r.k: r.noise for r in small.regression_noise(table(spark, series, ["y", "a", "b"]), ["k"], "y", ["a", "b"]).collect()}
    for k, x in series.items():
        np.testing.assert_allclose(got[k], costs.noise(x[:, 0], x[:, 1:])[0, 0], rtol=1e-6)


def test_lines_and_events_are_numbered_without_a_window_over_a_series(spark, sf):
    for rows in (sums.lines(spark, sf), catalog.events(spark, sf)):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "row_number" in plan and all("_part" in line for line in plan.splitlines() if "row_number" in line)
        want = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"), F.countDistinct("t").alias("d")).collect()
        assert all((r.a, r.z, r.d) == (0, r.n - 1, r.n) for r in want)


def test_index_of_long_series_equals_the_window(spark):
    rows = spark.createDataFrame([(k, (i * 37) % 101) for k, n in (("a", 60), (None, 30), ("b", 1)) for i in range(n)], "k string, v long")
    assert sorted(map(str, index_long(rows, ["k"], ["v"]).collect())) == sorted(map(str, index(rows, ["k"], ["v"]).collect()))
