"""Detection in one and two columns, and the unpruned recursion in SQL that it equals.

The SQL prices every segment of a series first (``pc``: k, s, e, n, cost for rows [s, e)) and runs the plain recursion over
the prices, so it knows nothing of pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect as D
from ..operators import series
from . import catalog, sums

#: The least sum of prices plus {beta} for each change point; {beta} may use n.
LEAST = """li AS (SELECT k, e, any_value(n) AS n, list(cost ORDER BY s) AS cl FROM pc GROUP BY k, e),
    dp AS (
      SELECT k, 0::BIGINT AS e, [-({beta})::DOUBLE] AS FF, [0::BIGINT] AS R, ({beta})::DOUBLE AS beta, n FROM (SELECT DISTINCT k, n FROM li) {extra}
      UNION ALL
      SELECT k, e, list_append(FF, list_min(c) + beta), list_append(R, list_position(c, list_min(c)) - 1), beta, n
      FROM (SELECT dp.k, li.e, FF, R, beta, dp.n, [FF[j + 1] + cl[j + 1] FOR j IN range(0, li.e)] AS c FROM dp JOIN li ON li.k = dp.k AND li.e = dp.e + 1)
    ),
    tr AS (SELECT k, R[n + 1] AS cp, R FROM dp WHERE e = n AND R[n + 1] > 0 UNION ALL SELECT k, R[cp + 1], R FROM tr WHERE R[cp + 1] > 0)
    SELECT k, cp FROM tr"""


def least(before: str, prices: str, beta: str, extra: str = "") -> str:
    return f"WITH RECURSIVE {before}, {prices}, " + LEAST.format(beta=beta, extra=extra)


def priced(src: str, sums: dict[str, str], cost: str, wide: int = 0, short: int = 1) -> str:
    """The relations ``ps`` (prefix sums of ``src``) and ``pc``: ``cost`` over the sums' differences, length ``m`` and the
    length ``l`` of what is summed, which for fewer than ``short`` rows reaches ``wide`` rows further on both sides."""
    running = ", ".join(f"sum({x}) OVER w AS {name}" for name, x in sums.items())
    zero = ", ".join(f"0.0::DOUBLE AS {name}" for name in sums)
    apart = ", ".join(f"b.{name} - a.{name} AS {name}" for name in sums)
    return f"""ps AS (SELECT k, t + 1 AS e, {running} FROM {src} WINDOW w AS (PARTITION BY k ORDER BY t) UNION ALL SELECT DISTINCT k, 0, {zero} FROM {src}),
    nn AS (SELECT k, max(e) AS n FROM ps GROUP BY k),
    sg AS (SELECT k, n, s, e, CASE WHEN e - s < {short} THEN greatest(s - {wide}, 0) ELSE s END AS a, CASE WHEN e - s < {short} THEN least(e + {wide}, n) ELSE e END AS b FROM nn, range(0, n) x(s), range(1, n + 1) y(e) WHERE s < e),
    pc AS (SELECT k, n, s, e, {cost} AS cost FROM (SELECT sg.k, sg.n, sg.s, sg.e, sg.e - sg.s AS m, sg.b - sg.a AS l, {apart} FROM sg JOIN ps a ON a.k = sg.k AND a.e = sg.a JOIN ps b ON b.k = sg.k AND b.e = sg.b))"""


def pair_months(spark, sf) -> DataFrame:
    """(k, t, v, w): months by priority; two numbers drawn from orders, eight times as spread and 2,000 higher in months
    30 to 49."""
    rows = catalog.read(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("k"), F.date_format("o_orderdate", "yyyy-MM").alias("m")).agg((F.floor(F.sum(F.floor("o_totalprice")) / F.count("*")) % 997).alias("v0"), (F.floor(F.sum("o_orderkey") / F.count("*")) % 991).alias("w0"))
    inside = F.col("t").between(30, 49)
    turned = lambda c: (F.col(c) * F.when(inside, 8.0).otherwise(1.0) + F.when(inside, 2000.0).otherwise(0.0)).cast("double")
    return series.index(rows, catalog.KEY, ["m"]).select("k", "t", turned("v0").alias("v"), turned("w0").alias("w"))


PAIR_MONTHS = """m0 AS (SELECT o_orderpriority AS k, strftime(o_orderdate, '%Y-%m') AS m, floor(sum(floor(o_totalprice)::BIGINT) / count(*)) % 997 AS v0, floor(sum(o_orderkey) / count(*)) % 991 AS w0 FROM orders GROUP BY ALL),
    m1 AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY m) - 1 AS t, v0, w0 FROM m0),
    e AS (SELECT k, t, (v0 * f + g)::DOUBLE AS v, (w0 * f + g)::DOUBLE AS w FROM (SELECT *, CASE WHEN t BETWEEN 30 AND 49 THEN 8 ELSE 1 END AS f, CASE WHEN t BETWEEN 30 AND 49 THEN 2000 ELSE 0 END AS g FROM m1))"""


def pair_detect(family: str, **options):
    return lambda spark, sf: D.detect(pair_months(spark, sf), "k", "t", ["v", "w"], family=family, **options).raw_change_points


def shifted_events(spark, sf) -> DataFrame:
    """(k, t, v): all events by type, 4,000 cents higher in rows 600 to 999 and twice as far from 5,000 in rows 1400 to 1699."""
    rows, t = catalog.events(spark, sf), F.col("t")
    v = F.col("v") + F.when(t.between(600, 999), 4000.0).otherwise(0.0)
    return rows.select("k", "t", F.when(t.between(1400, 1699), 2 * v - 5000.0).otherwise(v).alias("v"))


SHIFTED = catalog.EVENTS.replace("e AS", "e0 AS", 1) + ", e1 AS (SELECT k, t, v + CASE WHEN t BETWEEN 600 AND 999 THEN 4000.0 ELSE 0.0 END AS v FROM e0), e AS (SELECT k, t, CASE WHEN t BETWEEN 1400 AND 1699 THEN 2 * v - 5000.0 ELSE v END AS v FROM e1)"


def event_detect(family: str, **options):
    return lambda spark, sf: D.detect(shifted_events(spark, sf), "k", "t", "v", family=family, **options).raw_change_points


QUERIES: dict = {
    "mean_of_events": event_detect("mean"),
    "meanvariance_of_events": event_detect("meanvariance"),
    "rank_of_events": event_detect("rank", beta=20.0),
    "pelt_mean_two": pair_detect("mean"),
    "pelt_variance_two": pair_detect("variance"),
    "pelt_meanvariance_two": pair_detect("meanvariance"),
    "pelt_rank_two": pair_detect("rank", beta=8.0),
    "pelt_meanvariance_floor": catalog._detect("meanvariance", short="floor"),
    "pelt_mgaussian": pair_detect("mgaussian", p_response=2),
    "pelt_ma": catalog._waves("arma", order=(0, 1)),
}

PAIR = {"v": "v", "w": "w", "vv": "v * v", "vw": "v * w", "ww": "w * w"}
CENTRED = "y AS (SELECT k, t, v - avg(v) OVER (PARTITION BY k) AS v, w - avg(w) OVER (PARTITION BY k) AS w FROM e)"
#: Rows times the upper triangular factor of the inverse noise covariance have the same squared lengths as whitened rows.
NOISE_TWO = """r AS (SELECT k, sum(a * a) / (2 * (count(*) - 1)) AS aa, sum(a * b) / (2 * (count(*) - 1)) AS ab, sum(b * b) / (2 * (count(*) - 1)) AS bb FROM (SELECT k, v - lag(v) OVER x AS a, w - lag(w) OVER x AS b FROM e WINDOW x AS (PARTITION BY k ORDER BY t)) GROUP BY k),
    y AS (SELECT e.k, t, v / sqrt(aa) AS v, (w - v * ab / aa) / sqrt(bb - ab * ab / aa) AS w FROM e JOIN r USING (k))"""
RANKS = """q0 AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY v, t) - (count(*) OVER (PARTITION BY k) + 1) / 2 AS v, row_number() OVER (PARTITION BY k ORDER BY w, t) - (count(*) OVER (PARTITION BY k) + 1) / 2 AS w FROM e),
    q1 AS (SELECT k, sum((v + 0.5) * (v + 0.5)) / count(*) AS a, sum((v + 0.5) * (w + 0.5)) / count(*) AS b, sum((w + 0.5) * (w + 0.5)) / count(*) AS c FROM q0 GROUP BY k),
    q2 AS (SELECT k, a + 1e-10 * (a + c) / 2 AS a, b, c + 1e-10 * (a + c) / 2 AS c FROM q1)"""
#: Floor of a determinant or a variance (fixed value).
FLOOR = "1e-11"
ONE = {"v": "v", "vv": "v * v"}
SPREAD = f"(m / 2.0 * ln(CASE WHEN vv - v * v / l <= 0 THEN {FLOOR} ELSE vv - v * v / l END / l) + ln(m) / 2)"

ONE_RANKS = "q0 AS (SELECT k, t, row_number() OVER (PARTITION BY k ORDER BY v, t) - (count(*) OVER (PARTITION BY k) + 1) / 2 AS r FROM e), q1 AS (SELECT k, sum((r + 0.5) * (r + 0.5)) / count(*) * (1 + 1e-10) AS a FROM q0 GROUP BY k), y AS (SELECT k, t, r / sqrt(a) AS v FROM q0 JOIN q1 USING (k))"

SQL: dict = {
    "mean_of_events": least(f"{SHIFTED}, {catalog.NOISE}, y AS (SELECT e.k, t, v / sqrt(s2) AS v FROM e JOIN r USING (k))", priced("y", ONE, "(vv - v * v / m) / 2 + ln(m) / 2"), "1.5 * ln(n)"),
    "meanvariance_of_events": least(SHIFTED, priced("e", ONE, SPREAD, 1, 2), "2 * ln(n)"),
    "rank_of_events": least(f"{SHIFTED}, {ONE_RANKS}", priced("y", {"v": "v"}, "CASE WHEN m < 2 THEN 0.0 ELSE -v * v / m END"), "20.0"),
    "pelt_mean_two": least(f"{PAIR_MONTHS}, {NOISE_TWO}", priced("y", PAIR, "(vv + ww - (v * v + w * w) / m) / 2 + ln(m) / 2"), "2 * ln(n)"),
    "pelt_variance_two": least(f"{PAIR_MONTHS}, {CENTRED}", priced("y", PAIR, f"m / 2.0 * ln(greatest((vv / l) * (ww / l) - (vw / l) * (vw / l), {FLOOR})) + ln(m) / 2", 2, 2), "3 * ln(n)"),
    "pelt_meanvariance_two": least(f"{PAIR_MONTHS}, {CENTRED}", priced("y", PAIR, f"m / 2.0 * ln(greatest((vv - v * v / l) / l * ((ww - w * w / l) / l) - (vw - v * w / l) / l * ((vw - v * w / l) / l), {FLOOR})) + ln(m) / 2", 2, 3), "4 * ln(n)"),
    "pelt_meanvariance": least(catalog.MONTHS, priced("e", ONE, SPREAD, 1, 2), "2 * ln(n)"),
    "pelt_meanvariance_floor": least(catalog.MONTHS, priced("e", ONE, SPREAD), "2 * ln(n)"),
}
#: The rank's quadratic form needs the series' matrix beside the sums.
SQL["pelt_rank_two"] = least(f"{PAIR_MONTHS}, {RANKS}", priced("q0", {"v": "v", "w": "w"}, "CASE WHEN m < 3 THEN 0.0 ELSE -(v * v * cc - 2 * v * w * cb + w * w * ca) / (m * (ca * cc - cb * cb)) END").replace("b.w - a.w AS w FROM sg", "b.w - a.w AS w, q2.a AS ca, q2.b AS cb, q2.c AS cc FROM sg JOIN q2 ON q2.k = sg.k"), "8.0")

#: Least squares on two predictors; the penalty is scaled by the noise of slopes of neighbouring blocks.
_PLANTED = sums.MONTHLY.replace("sum(floor(l_extendedprice)) / count(*) / 1000 AS y", "sum(floor(l_extendedprice)) / count(*) / 1000 + CASE WHEN row_number() OVER (PARTITION BY l_returnflag ORDER BY date_trunc('month', l_shipdate)) - 1 >= 15 THEN 40.0 ELSE 0.0 END AS y")
_GRAM = {"xx": "x1 * x1", "xz": "x1 * x2", "zz": "x2 * x2", "xc": "x1 * y", "zc": "x2 * y", "yy": "y * y"}
SQL["pelt_lm"] = least(f"{_PLANTED}, s0 AS ({sums.noise_of(2)})", priced("y", _GRAM, "CASE WHEN m < 3 THEN 0.0 ELSE (yy - (zz * xc * xc - 2 * xz * xc * zc + xx * zc * zc) / (xx * zz - xz * xz)) / 2 END"), "2 * ln(n) * noise", "JOIN s0 USING (k)")
