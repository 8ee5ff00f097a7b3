"""Change points: documented results, brute-force recursion, and properties."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from breakline.functions import costs, fits, penalty
from breakline.functions.partition import calibrate, partition, partition_blocks
from breakline.operators import detect as D
from breakline.operators import long as L
from breakline.operators import post
from breakline.operators.detect import Spec
from breakline.sources import generators
from breakline.sources.frames import from_matrix


def draws(seed, *parts):
    np.random.seed(seed)
    return np.concatenate([np.random.normal(m, s, n) for m, s, n in parts])


def unpruned(n, beta, cost):
    total, back = [-beta], [0]
    for end in range(1, n + 1):
        values = total[:end] + cost(np.arange(end), end) + beta
        back.append(int(np.argmin(values)))
        total.append(values[back[-1]])
    out, at = [], n
    while at > 0:
        at = back[at]
        if at:
            out.append(at)
    return out[::-1]


def test_documented_mean():
    assert Spec("mean").solve(draws(42, (0, 1, 100), (5, 1, 100), (2, 1, 100))[:, None]) == [100, 200]


def test_documented_variance():
    assert Spec("variance").solve(draws(42, (0, 0.5, 100), (0, 2.5, 100), (0, 0.5, 100))[:, None]) == [100, 200]


def test_one_change_in_one_and_three_columns():
    assert Spec("mean").solve(draws(42, (0, 1, 300), (5, 1, 400))[:, None]) == [300]
    np.random.seed(42)
    x = np.concatenate([np.random.multivariate_normal(np.zeros(3), np.eye(3), 300), np.random.multivariate_normal(np.full(3, 5), np.eye(3), 400)])
    assert Spec("mean").solve(x) == [300] and Spec("meanvariance").solve(x) == [300]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 60))
def test_pruned_equals_unpruned(seed, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 1)) + rng.integers(0, 2) * 4 * (np.arange(n) > n // 2)[:, None]
    cost = costs.Moment(x, "mean")
    beta = penalty.penalty("MBIC", 1, n)
    assert partition(n, beta, cost, known=True) == unpruned(n, beta, cost)


@settings(max_examples=15, deadline=None)
@given(st.integers(0, 10_000))
def test_linear_costs_equal_refits(seed):
    rng = np.random.default_rng(seed)
    x, y = rng.normal(size=(30, 2)), rng.normal(size=30)
    got = costs.Linear(y, x)(np.arange(28), 30)
    want = [fits.ols(x[a:], y[a:])[1] / 2 if 30 - a >= 3 else 0.0 for a in range(28)]
    np.testing.assert_allclose(got, want, atol=1e-8)


@settings(max_examples=90, deadline=None)
@given(st.integers(0, 10_000), st.sampled_from([1, 2, 3]), st.sampled_from(["mean", "variance", "meanvariance"]), st.sampled_from(["MBIC", "MDL", None]), st.sampled_from([0.5, 2.0, 8.0, None]))
def test_exact_pruning_loses_nothing(seed, d, kind, adjust, beta):
    """Small penalties, where the length terms decide, and the default; segments too short for a determinant."""
    rng = np.random.default_rng(seed)
    x = (rng.normal(0, 1, (45, d)) * rng.choice([1, 3], (45, 1))).round(3)
    cost = costs.Moment(x, kind, adjust)
    beta = penalty.penalty("MBIC", cost.p, 45) if beta is None else beta
    price = lambda cps: sum(cost(np.array([a]), b)[0] for a, b in zip([0, *cps], [*cps, 45], strict=True)) + beta * len(cps)
    found = partition(45, beta, cost, slack=cost.slack, known=True, least=cost.least)
    assert price(found) <= price(unpruned(45, beta, cost)) + 1e-9


def test_one_row_is_no_segment_of_its_own():
    """Plain noise with one change of spread: a row alone used to cost less than any penalty."""
    x = draws(3, (0, 1, 40), (0, 6, 40))[:, None]
    assert all(abs(c - 40) < 6 for c in Spec("meanvariance").solve(x)) and len(Spec("meanvariance").solve(x)) <= 2
    assert len(Spec("meanvariance", short="floor").solve(x)) > 70
    with pytest.raises(ValueError):
        Spec(short="none")


def test_plain_pruning_is_an_option(spark):
    with pytest.raises(ValueError):
        D.Spec(pruning="none")
    assert D.Spec(pruning="plain").solve(draws(1, (0, 1, 40), (9, 1, 40)).reshape(-1, 1)) == [40]


def test_rank_is_invariant_under_monotone_maps(spark):
    x = draws(3, (0, 1, 60), (3, 1, 60))
    one, two = (D.rank(from_matrix(spark, v), "series_id", "t", "v0", beta=10.0).raw_change_points.collect() for v in (x, np.exp(x)))
    assert one == two and one[0]["cp"] == 60


def test_autoregression_shifts_and_recovers(spark):
    np.random.seed(100)
    parts = []
    for phi in (0.8, -0.7):
        y = np.zeros(150)
        for t in range(1, 150):
            y[t] = phi * y[t - 1] + np.random.normal(0, 0.8)
        parts.append(y)
    d = D.ar(from_matrix(spark, np.concatenate(parts)), "series_id", "t", "v0", order=(1,))
    assert [r.cp for r in d.change_points.collect()] == [150]
    theta = [r.theta[0] for r in d.parameters().orderBy("seg_id").collect()]
    assert theta[0] > 0.6 and theta[1] < -0.6


def logistic(seed=42):
    np.random.seed(seed)
    z = np.random.randn(500, 2)
    u = np.r_[z[:250] @ [2, 3], z[250:] @ [-1, 2]]
    return np.c_[(np.random.rand(500) < 1 / (1 + np.exp(-u))).astype(float), z]


def test_logistic_by_sequential_gradients():
    cps = Spec("binomial").solve(logistic())
    assert len(cps) == 1 and 200 < cps[0] < 300


def test_poisson_and_lasso():
    np.random.seed(42)
    z = np.random.randn(500, 2)
    y = np.random.poisson(np.exp(np.r_[z[:250] @ [0.5, 0.8], z[250:] @ [-0.3, 1.2]]))
    assert any(150 < c < 350 for c in Spec("poisson", vanilla_percentage=0.0).solve(np.c_[y, z].astype(float)))
    np.random.seed(42)
    z = np.random.randn(300, 10)
    y = np.r_[z[:150, 0] + z[:150, 1], -z[150:, 3] + z[150:, 4]] + 0.3 * np.random.randn(300)
    assert any(130 < c < 170 for c in Spec("lasso", vanilla_percentage=0.0).solve(np.c_[y, z]))


def test_glm_fit_matches_gradient_condition():
    data = logistic()
    x, y = np.c_[np.ones(500), data[:, 1:]], data[:, 0]
    theta, _ = fits.glm("binomial", x, y)
    assert np.abs(x.T @ (y - 1 / (1 + np.exp(-x @ theta)))).max() < 0.05


def test_arma_and_garch_fits():
    rng = np.random.default_rng(1)
    e = rng.normal(size=800)
    y = np.zeros(800)
    for t in range(1, 800):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.3 * e[t - 1]
    theta = fits.arma(y, 1, 1)
    assert abs(theta[0] - 0.6) < 0.12 and abs(theta[1] - 0.3) < 0.15
    y, s = np.zeros(2000), 1.0
    for t in range(2000):
        y[t] = rng.normal() * np.sqrt(s)
        s = 0.2 + 0.2 * y[t] ** 2 + 0.6 * s
    theta, loss = fits.garch(y, 1, 1)
    assert abs(theta[1:].sum() - 0.8) < 0.15
    truth = np.array([[0.2, 0.2, 0.6]])
    v = fits.garch_variances(y * y, truth, 1, 1)[0]
    assert loss < 0.5 * (np.log(2 * np.pi * v) + y * y / v).sum() + 0.5


def test_kernel_custom_and_target():
    x = draws(3, (0, 1, 100), (3, 1, 100))[:, None]
    found = Spec("rbf", beta=5.0).solve(x)
    assert len(found) == 1 and abs(found[0] - 100) <= 2
    found = Spec("custom", beta=20.0, cost=lambda s: float(((s - s.mean()) ** 2).sum())).solve(x)
    assert len(found) == 1 and abs(found[0] - 100) <= 2
    assert len(Spec("mean", target=1).solve(x)) == 1
    assert calibrate(lambda b: [1, 2], 5)[0] == 0.0


@pytest.mark.parametrize("pairs", [4_000_000, 50_000])
@pytest.mark.parametrize("kind", ["real", "tied"])
def test_kernel_bandwidth_of_a_long_series(monkeypatch, pairs, kind):
    monkeypatch.setattr(costs, "PAIRS", pairs)
    x = np.random.default_rng(4).normal(size=(2300, 2)) * (1, 3)
    x = np.round(x) if kind == "tied" else x

    def brute(z):
        return np.median(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1)[np.triu_indices(len(z), 1)])

    assert np.isclose(costs.median_distance(x), brute(x), rtol=1e-12)
    assert np.isclose(costs.median_distance(x, most=700), brute(x[np.random.default_rng(0).choice(len(x), 700, replace=False)]), rtol=1e-12)


def test_grouped_equals_single_and_order_of_rows_does_not_matter(spark):
    data = generators.generate(spark, "mean", series=6, n=200, k=2, seed=3)
    together = {(r.series_id, r.cp) for r in D.mean(data.rows.orderBy("v"), "series_id", "t", "v").change_points.collect()}
    alone = {(i, r.cp) for i in range(2) for r in D.mean(data.rows.filter(f"series_id = {i}"), "series_id", "t", "v").change_points.collect()}
    assert {x for x in together if x[0] < 2} == alone and together


def test_bad_arguments_and_values(spark):
    for options in ({"family": "nope"}, {"beta": "AIC"}, {"family": "ar"}, {"family": "arma", "order": (1,)}, {"family": "custom"}, {"trim": 0.7}):
        with pytest.raises(ValueError):
            Spec(**options)
    with pytest.raises(ValueError):
        from_matrix(spark, np.zeros((2, 2, 2)))
    with pytest.raises(Exception, match="null, NaN"):
        D.mean(from_matrix(spark, [1.0, float("nan"), 2.0]), "series_id", "t", "v0").change_points.collect()


def merge_slowly(cps, limit, closed):
    runs = []
    for c in sorted(set(cps)):
        if runs and (c - runs[-1][-1] <= limit if closed else c - runs[-1][-1] < limit):
            runs[-1].append(c)
        else:
            runs.append([c])
    if closed:
        return [(r[0] + r[-1]) // 2 for r in runs]
    return [(a + b) // 2 for r in runs if len(r) > 1 for a, b in zip(r[::2], r[1::2], strict=False)] + [r[0] for r in runs if len(r) == 1]


def test_merging(spark):
    rng = np.random.default_rng(0)
    sets = {i: sorted(set(rng.integers(20, 980, rng.integers(1, 25)).tolist())) for i in range(40)} | {99: [100, 105, 110]}
    cps = spark.createDataFrame([(i, c) for i, s in sets.items() for c in s], "k long, cp long")
    n = spark.createDataFrame([(i, 1000) for i in sets], "k long, n long")
    for merge, closed in ((post.merge_runs, True), (post.merge_pairs, False)):
        got = {}
        for r in merge(cps, n, ["k"], 0.02).collect():
            got.setdefault(r.k, []).append(r.cp)
        for i, s in sets.items():
            assert sorted(got.get(i, [])) == sorted(merge_slowly(s, 20, closed)), (i, s)


def test_least_length_merges_into_the_shorter_neighbour():
    assert post.enforce([40, 45], 100, 10) == [45]
    assert post.enforce([60, 65], 100, 10) == [60]
    assert post.enforce([], 100, 10) == []


def test_segments_and_parameters(spark):
    x = draws(42, (0, 1, 100), (5, 1, 100), (2, 1, 100))
    d = D.mean(from_matrix(spark, x), "series_id", "t", "v0")
    assert [(r.start, r.end) for r in d.segments.orderBy("seg_id").collect()] == [(0, 100), (100, 200), (200, 300)]
    theta = [r.theta[0] for r in d.parameters().orderBy("seg_id").collect()]
    np.testing.assert_allclose(theta, [x[:100].mean(), x[100:200].mean(), x[200:].mean()])
    res = np.array([r.residual for r in d.residuals().orderBy("t").collect()])
    np.testing.assert_allclose(res[100:200], x[100:200] - x[100:200].mean())


def test_long_series_finds_planted_changes(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, 6000) + 3 * (np.arange(6000) >= 2500) - 2 * (np.arange(6000) >= 4400)
    found = sorted(r.cp for r in L.detect_long(from_matrix(spark, x), "t", "v0", chunk=1000).collect())
    assert len(found) == 2 and abs(found[0] - 2500) <= 3 and abs(found[1] - 4400) <= 3


def test_generators_repeat_and_validate(spark):
    a, b = (generators.generate(spark, "arma", series=2, n=80, k=1, seed=5).rows.orderBy("series_id", "t").collect() for _ in range(2))
    assert a == b and len(a) == 160
    for kind in generators.KINDS:
        data = generators.generate(spark, kind, series=2, n=120, k=2, seed=1)
        assert data.rows.count() == 240 and data.truth.count() == 4 and data.info.count() == 2
    with pytest.raises(ValueError):
        generators.generate(spark, "nope")
    noisy = generators.annotation_noise(generators.generate(spark, "mean", n=200, k=3).truth, ["series_id"], 4, 1.0, 0.0)
    assert noisy.groupBy("annotator_id").count().filter("count = 3").count() == 4


def test_sql_table_function(spark):
    from breakline.functions.sql import register

    register(spark)
    from_matrix(spark, draws(42, (0, 1, 100), (5, 1, 100))).selectExpr("series_id AS k", "t", "v0 AS v").createOrReplaceTempView("obs")
    rows = spark.sql("SELECT * FROM change_points(TABLE(obs) PARTITION BY k ORDER BY (t), 'mean')").collect()
    assert [r.cp for r in rows] == [100]
    assert abs(spark.sql("SELECT penalty_bic(2, 100) AS p").first().p - np.log(100)) < 1e-9


def test_polymorphic_table_function(spark):
    """Two keys of different types, two value columns, options by name: what ``detect`` finds."""
    from breakline.functions.sql import register

    register(spark)
    rng = np.random.default_rng(4)
    rows = [(s, i, t, float(rng.normal(5 * (t >= 30 + 10 * i), 1 + 3 * (t >= 50))), float(rng.normal()), 9) for s in ("a", "b") for i in (1, 2) for t in range(80)]
    df = spark.createDataFrame(rows, "shop string, item int, day long, sold double, price double, extra int")
    df.repartition(3).createOrReplaceTempView("shops")
    for family, values, more, options in (("mean", "sold, price", "", {}), ("variance", "sold", ", beta => 4.0, trim => 0.0", {"beta": 4.0}), ("ar", "sold", ", order => '1'", {"order": (1,)}), ("rank", "sold, price", ", beta => 6", {"beta": 6.0}), ("meanvariance", "sold", ", beta => 'BIC', pruning => 'plain'", {"beta": "BIC", "pruning": "plain"})):
        got = spark.sql(f"SELECT * FROM detect_changes(TABLE(shops), series => 'shop, item', sort => 'day', value => '{values}', family => '{family}'{more})")
        assert [f.dataType.simpleString() for f in got.schema] == ["string", "int", "bigint"]
        want = D.detect(df, ["shop", "item"], "day", values.split(", "), family=family, **options).raw_change_points
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())), family
    with pytest.raises(Exception, match="no column"):
        spark.sql("SELECT * FROM detect_changes(TABLE(shops), series => 'nope', sort => 'day', value => 'sold')").collect()


def test_custom_gradients_equal_the_built_in_family():
    """A logit cost given as functions finds what the sequential logit family finds."""

    def logit(rows, theta):
        u = np.clip(np.column_stack([np.ones(len(rows)), rows[:, 1:]]) @ theta, -500, 500)
        return float((np.logaddexp(0, u) - rows[:, 0] * u).sum())

    def gradient(rows, theta):
        z = np.r_[1.0, rows[-1, 1:]]
        return -(rows[-1, 0] - 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))) * z

    def hessian(rows, theta):
        z = np.r_[1.0, rows[-1, 1:]]
        mu = 1 / (1 + np.exp(-np.clip(z @ theta, -500, 500)))
        return mu * (1 - mu) * np.outer(z, z)

    x = logistic()[100:400]
    own = Spec("custom", cost=logit, cost_gradient=gradient, cost_hessian=hessian, p=3, beta=8.0).solve(x)
    assert own == Spec("binomial", vanilla_percentage=0.0, beta=8.0).solve(x) and own
    with pytest.raises(ValueError):
        Spec("custom", cost=logit, cost_gradient=gradient, p=3)


def test_online(spark, tmp_path):
    from breakline.streaming.online import online_mean

    x = draws(42, (0, 1, 150), (5, 1, 150))
    for i in range(3):
        from_matrix(spark, x[i * 100 : (i + 1) * 100]).selectExpr("series_id AS k", f"t + {i * 100} AS t", "v0 AS v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "k string, t long, v double"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = online_mean(stream, "k", "t", "v", beta=10.0).writeStream.format("memory").queryName("online").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    found = spark.sql("SELECT position FROM online").collect()
    assert len(found) == 1 and abs(found[0].position - 150) <= 3


@pytest.mark.parametrize("family", ["lm", "var", "rbf", "rank", "binomial", "poisson", "lasso", "mgaussian"])
def test_pruning_of_the_other_families_loses_nothing(family):
    """The sum of costs that the recursion finds against the recursion without pruning, at small and default penalties."""
    from breakline.functions import sequential

    for seed in range(3):
        rng = np.random.default_rng(seed)
        n = 50
        x = rng.normal(size=(n, 2))
        u = x @ [1.5, -1.0] * np.where(np.arange(n) < 25, 1, -1)
        y = {"binomial": (rng.random(n) < 1 / (1 + np.exp(-2 * u))).astype(float), "poisson": rng.poisson(np.exp(np.clip(u, -2, 2))).astype(float)}.get(family, u + 0.3 * rng.normal(size=n))
        walk = np.cumsum(rng.normal(size=(n + 1, 2)), 0) * 0.3
        lagged = np.column_stack([walk[1:], walk[:-1]])
        make, first, newest = {
            "lm": (lambda: costs.Linear(y, x), 1, 1), "var": (lambda: costs.Linear(lagged[:, :2], lagged[:, 2:], costs.noise(lagged[:, :2], lagged[:, 2:])), 1, 1),
            "rbf": (lambda: costs.Kernel(np.column_stack([u])), 1, 1), "rank": (lambda: costs.Rank(np.argsort(np.argsort(x, 0), 0) + 1.0), 1, 1), "binomial": (lambda: costs.regression("binomial", y, x), 1, 1), "poisson": (lambda: costs.regression("poisson", y, x), 1, 1),
            "lasso": (lambda: costs.lasso(y, x, sequential.lasso_noise(y, x)[0], 0.05), 2, 2), "mgaussian": (lambda: costs.Linear(x, np.ones((n, 1)), costs.noise(x, np.ones((n, 1)))), 1, 1),
        }[family]
        for beta in (1.0, 6.0):
            short = {"var": 3, "mgaussian": 2, "rank": 3, "rbf": 2}.get(family, 1)
            found, every = partition(n, beta, make(), first=first, newest=newest, least=short), unpruned_of(n, beta, make(), first, newest)
            fresh = lambda a, b: make()(np.array([a]), b)[0]  # noqa: B023, E731
            price = lambda cps: sum(fresh(a, b) for a, b in zip([0, *cps], [*cps, n], strict=True)) + beta * len(cps)  # noqa: B023, E731
            assert price(found) <= price(every) + 1e-3, (seed, beta, found, every)


def unpruned_of(n, beta, cost, first, newest):
    """The recursion over all starts, with the rule for the newest one."""
    total, back = np.full(n + 1, np.inf), np.zeros(n + 1, int)
    total[0] = -beta
    for end in range(first, n + 1):
        starts = np.array([s for s in range(end) if s <= end - newest and (s == 0 or s >= first)])
        value = total[starts] + cost(starts, end) + beta
        total[end], back[end] = np.nanmin(value), starts[int(np.nanargmin(value))]
    out, at = [], n
    while at > 0:
        at = int(back[at])
        if at:
            out.append(at)
    return out[::-1]


BLOCK_COSTS = {
    "mean": lambda x: costs.Moment(x, "mean"), "variance": lambda x: costs.Moment(x, "variance"), "meanvariance": lambda x: costs.Moment(x, "meanvariance"),
    "floor": lambda x: costs.Moment(x, "meanvariance", None, short="floor"), "rank": lambda x: costs.Rank(np.argsort(np.argsort(x[:, 0], kind="stable"), kind="stable")[:, None] + 1.0),
    "slope": lambda x: costs.Linear(x[:, 0], 1.0 + np.arange(len(x))[:, None] % 5),
}


@pytest.mark.parametrize("family", BLOCK_COSTS)
@pytest.mark.parametrize("kind", ("normal", "skewed whole", "repeated"))
def test_blocks_equal_the_recursion_without_pruning(family, kind):
    for seed, n in enumerate((2, 3, 40, 1500)):
        rng = np.random.default_rng(seed)
        x = rng.normal(size=n) + 3 * (np.arange(n) // 97 % 2) if kind == "normal" else np.floor(100 * rng.exponential(20, n))
        x = np.repeat(x, 7)[:n, None] if kind == "repeated" else x[:, None]
        cost, known = BLOCK_COSTS[family](x), family not in ("rank", "slope")
        for beta in (1.0, 12.0, 30.0):
            assert partition_blocks(n, beta, cost, known) == partition(n, beta, cost, slack=lambda start, end: np.inf, known=known)


@pytest.mark.parametrize("family", ("mean", "meanvariance", "rank"))
def test_long_series_without_changes_is_not_quadratic(monkeypatch, family):
    """Prices of segments in the recursion: few for each row, where no start can be pruned."""
    priced, n = [], 20_000
    kind = costs.Rank if family == "rank" else costs.Moment
    for name in ("pairs", "under", "__call__"):
        real = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, s, e, real=real: [out := real(self, s, e), priced.append(np.size(out))][0])
    x = np.random.default_rng(0).normal(size=n)
    assert Spec(family=family, beta=40.0).solve((x if family != "rank" else np.argsort(np.argsort(x)) + 1.0)[:, None]) == []
    assert sum(priced) < 600 * n
