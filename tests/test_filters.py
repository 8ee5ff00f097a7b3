"""Recursive filters by an affine scan against a plain loop."""

import numpy as np
import pytest

from breakline.functions import fits
from breakline.operators import filters


@pytest.mark.parametrize("feed,back,const", [([1.0], [0.5], 0.0), ([1.0, -0.3, 0.2], [-0.4, 0.1, 0.05], 0.7), ([0.0, 0.2], [0.7], 0.1), ([1.0, -0.5], [], 0.0)])
def test_filter_equals_loop(feed, back, const):
    f, rng = filters.Filter(feed, back, const), np.random.default_rng(1)
    x, state = rng.normal(size=337), rng.normal(size=len(back) + len(feed) - 1)
    s, past = list(state[: len(back)][::-1]), list(state[len(back) :][::-1])
    for v in x:
        past.append(v)
        s.append(const + sum(c * past[-1 - k] for k, c in enumerate(feed)) + sum(c * s[-1 - j] for j, c in enumerate(back)))
    out, after = f.run(x, state)
    np.testing.assert_allclose(out, s[len(back) :], atol=1e-12)
    one, middle = f.run(x[:100], state)
    two, end = f.run(x[100:], middle)
    np.testing.assert_allclose(np.r_[one, two], out, atol=1e-12)
    np.testing.assert_allclose(end, after, atol=1e-12)
    zero = f.run(x, np.zeros_like(state))[1]
    np.testing.assert_allclose(zero + np.linalg.matrix_power(f.step, len(x)) @ state, after, atol=1e-12)


@pytest.mark.parametrize("parts", ["2", "13"])
def test_residuals_and_variances_of_many_series(spark, parts):
    """Series that span several ranges, and ranges of several series, null keys too."""
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(size=700), "b": rng.normal(size=3), "c": rng.normal(size=1), None: rng.normal(size=150)}
    rows = [(k, t, float(v), 5) for k, x in series.items() for t, v in enumerate(x)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.createDataFrame(rows, "k string, t long, v double, part int")
    e = filters.arma_residuals(df, ["k"], ["t"], "v", [0.5, -0.2], [0.4]).collect()
    h = filters.garch_variances(df, ["k"], ["t"], "v", 0.1, [0.2, 0.1], [0.5]).collect()
    one = filters.arma_residuals(df.filter("k = 'a'"), [], ["t"], "v", [], [0.3, 0.2]).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(e) == len(h) == len(rows)
    for k, x in series.items():
        own = [r.residual for r in sorted((r for r in e if r.k == k), key=lambda r: r.t)]
        np.testing.assert_allclose(own, fits.arma_residuals(x[None], np.array([[0.5, -0.2]]), np.array([[0.4]]))[0], atol=1e-10)
        own = [r.variance for r in sorted((r for r in h if r.k == k), key=lambda r: r.t)]
        np.testing.assert_allclose(own, fits.garch_variances(x * x, np.array([[0.1, 0.2, 0.1, 0.5]]), 2, 1)[0], atol=1e-10)
    np.testing.assert_allclose([r.residual for r in sorted(one, key=lambda r: r.t)], fits.arma_residuals(series["a"][None], np.zeros((1, 0)), np.array([[0.3, 0.2]]))[0], atol=1e-10)
    assert filters.arma_residuals(df.filter("false"), ["k"], ["t"], "v", [0.1], [0.1]).collect() == []
