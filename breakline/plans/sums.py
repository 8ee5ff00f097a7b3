"""Queries of the fits and noise estimates that come from sums: no series' rows meet in a task."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import series, small
from ..operators.newton import glm_by_segment
from .catalog import EVENTS, KEY, _two, monthly, read


def regression_noise(*x: str):
    return lambda spark, sf: small.regression_noise(monthly(spark, sf).select("k", "t", "price", *x), KEY, "price", list(x)).select("k", F.round("noise", 4).alias("noise"))


def lines(spark, sf):
    """(k, t, y, x1, x2): all lines by flag in order of position; whole numbers."""
    rows = read(spark, sf, "lineitem").select(F.col("l_returnflag").alias("k"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("double").alias("x1"), F.round(F.col("l_discount") * 100).cast("double").alias("x2"), F.floor(F.col("l_extendedprice") / 1000).cast("double").alias("y"))
    return series.index_long(rows, KEY, ["l_orderkey", "l_linenumber", "l_partkey", "x1", "x2", "y"]).select("k", "t", "y", "x1", "x2")


def regression_noise_of_lines(spark, sf):
    return small.regression_noise(lines(spark, sf), KEY, "y", ["x1"]).select("k", F.round("noise", 4).alias("noise"))


def lasso_noise(spark, sf):
    """Over all lines by flag."""
    return small.lasso_noise(lines(spark, sf), KEY, "y", ["x1", "x2"]).select("k", F.round("sigma", 6).alias("sigma"), F.round("active", 6).alias("active"))


def parameters(family: str):
    """Coefficients of three runs of all lines by flag, found by Newton steps over sums."""
    def run(spark, sf):
        rows = lines(spark, sf)
        y = (F.col("y") > 20).cast("double") if family == "binomial" else F.least("y", F.lit(60.0))
        own = rows.select("k", (F.col("t") % 3).cast("int").alias("seg_id"), y.alias("y"), ((F.col("x1") - 25) / 10).alias("a"), ((F.col("x2") - 5) / 3).alias("b"))
        out = glm_by_segment(series.cut(own, "rows"), ["k", "seg_id"], "y", ["a", "b"], family)
        return out.select("k", "seg_id", *[F.round(F.col("theta")[i], 6).alias(f"theta{i}") for i in range(3)], F.round("loss", 3).alias("loss"))

    return run


def parameters_binomial_months(spark, sf):
    """Detection, then the coefficients of each found segment."""
    rows, late = monthly(spark, sf), F.col("t") >= 15
    up = (F.col("x1") > 25.5) != late
    y = F.when(F.col("t") % 7 == 3, ~up).otherwise(up).cast("double")
    d = D.logistic_regression(rows.select("k", "t", y.alias("y"), "x1", "x2"), "k", "t", "y", ["x1", "x2"])
    return d.parameters().select("k", "seg_id", F.size("theta").alias("n_theta"), F.round("cost", 3).alias("cost"))


def whiten_two(spark, sf):
    return small.whiten_columns(_two(spark, sf), KEY, ["v", "w"]).select("k", "t", F.round("z_v", 6).alias("z_v"), F.round("z_w", 6).alias("z_w"))


QUERIES: dict = {"regression_noise_one": regression_noise("x1"), "regression_noise_two": regression_noise("x1", "x2"), "regression_noise_of_lines": regression_noise_of_lines, "lasso_noise": lasso_noise, "parameters_binomial": parameters("binomial"), "parameters_poisson": parameters("poisson"), "parameters_binomial_months": parameters_binomial_months, "whiten_two": whiten_two}

#: (k, t, y, x1, x2) of the two sources.
MONTHLY = "y AS (SELECT l_returnflag AS k, row_number() OVER (PARTITION BY l_returnflag ORDER BY date_trunc('month', l_shipdate)) - 1 AS t, sum(floor(l_extendedprice)) / count(*) / 1000 AS y, avg(l_quantity) AS x1, avg(l_discount) * 100 AS x2 FROM lineitem GROUP BY l_returnflag, date_trunc('month', l_shipdate))"
LINES = "y0 AS (SELECT l_returnflag AS k, l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE AS x1, round(l_discount * 100)::DOUBLE AS x2, floor(l_extendedprice / 1000)::DOUBLE AS y FROM lineitem), y AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY l_orderkey, l_linenumber, l_partkey, x1, x2, y) - 1 AS t FROM y0)"


def noise_of(p: int, digits: int | None = None) -> str:
    """(k, noise) of table ``y``: blocks of p + 1 rows and their neighbours, solved in closed form for one or two columns."""
    x = [f"x{i + 1}" for i in range(p)]
    grams = [(i, j) for i in range(p) for j in range(i, p)]
    sums = ", ".join([f"sum({x[i]} * {x[j]}) OVER {f} AS {f}g{i}{j}" for f in "am" for i, j in grams] + [f"sum({x[i]} * y) OVER a AS ac{i}" for i in range(p)])
    nexts = ", ".join([f"lead(ag{i}{j}) OVER w AS bg{i}{j}" for i, j in grams] + [f"lead(ac{i}) OVER w AS bc{i}" for i in range(p)])
    det = {s: f"{s}g00" if p == 1 else f"({s}g00 * {s}g11 - {s}g01 * {s}g01)" for s in "ab"}
    inv = {s: [[f"(1 / {det[s]})"]] if p == 1 else [[f"({s}g11 / {det[s]})", f"(-{s}g01 / {det[s]})"], [f"(-{s}g01 / {det[s]})", f"({s}g00 / {det[s]})"]] for s in "ab"}
    slope = {s: ["(" + " + ".join(f"{inv[s][i][j]} * {s}c{j}" for j in range(p)) + ")" for i in range(p)] for s in "ab"}
    middle = lambda j, k: f"mg{min(j, k)}{max(j, k)}"
    crossed = " + ".join(f"{inv['a'][i][j]} * {middle(j, k)} * {inv['b'][k][i]}" for i, j, k in product(range(p), repeat=3))
    between = " + ".join(inv[s][i][i] for s in "ab" for i in range(p)) + f" - 2 * ({crossed})"
    apart = " + ".join(f"({slope['a'][i]} - {slope['b'][i]}) * ({slope['a'][i]} - {slope['b'][i]})" for i in range(p))
    w = "PARTITION BY k ORDER BY t"
    noise = "avg(e) FILTER (isfinite(e))"
    return f"""WITH g AS (SELECT k, t, {sums}, lead(t, {p + 1}) OVER w AS ahead FROM y WINDOW w AS ({w}), a AS ({w} ROWS BETWEEN CURRENT ROW AND {p} FOLLOWING), m AS ({w} ROWS BETWEEN 1 FOLLOWING AND {p} FOLLOWING)),
        h AS (SELECT *, {nexts} FROM g WINDOW w AS ({w})), e AS (SELECT k, ({apart}) / ({between}) AS e FROM h WHERE ahead IS NOT NULL)
        SELECT k, {noise if digits is None else f"round({noise}, {digits})"} AS noise FROM e GROUP BY k"""


def _noise_sql(source: str, p: int) -> str:
    return f"WITH {source}, found AS ({noise_of(p, 4)}) SELECT * FROM found"


SQL: dict = {
    "regression_noise_one": _noise_sql(MONTHLY, 1),
    "regression_noise_two": _noise_sql(MONTHLY, 2),
    "regression_noise_of_lines": _noise_sql(LINES, 1),
    "whiten_two": f"""WITH {EVENTS}, e2 AS (SELECT *, (event_id % 1000)::DOUBLE AS w FROM e),
        r AS (SELECT k, sum(a * a) / (2 * (count(*) - 1)) AS p, sum(a * b) / (2 * (count(*) - 1)) AS q, sum(b * b) / (2 * (count(*) - 1)) AS s FROM (SELECT k, v - lag(v) OVER x AS a, w - lag(w) OVER x AS b FROM e2 WINDOW x AS (PARTITION BY k ORDER BY t)) GROUP BY k),
        i AS (SELECT k, s / (p * s - q * q) AS a, -q / (p * s - q * q) AS b, p / (p * s - q * q) AS c FROM r)
        SELECT e2.k, t, round(v * sqrt(a) + w * b / sqrt(a), 6) AS z_v, round(w * sqrt(c - b * b / a), 6) AS z_w FROM e2 JOIN i USING (k)""",
}
