"""Evaluation of detected against true change points: joins and aggregates on long tables.

``true`` and ``pred`` are (keys, cp); ``sizes`` is (keys, n) and names the series, so empty sides show up. Change points
are checked by ``validated``. Greedy one-to-one matching is in ``pairs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .pairs import closest_pairs

MARGINS = (1, 2, 5, 10, 20, 50, 100)


def validated(cps: DataFrame, sizes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``cps``; the plan raises on a null, a duplicate, one outside [0, n], or one out of order by column ``order``."""
    w = Window.partitionBy(*keys).orderBy("cp")
    again = F.lag("cp").over(w) == F.col("cp")
    checked = cps.join(sizes, keys, "left").withColumn("_again", again)
    bad = F.when(F.col("cp").isNull(), "a change point is null").when(F.col("_again"), "a change point is repeated").when((F.col("cp") < 0) | (F.col("cp") > F.col("n")), "a change point is outside its series")
    if order:
        checked = checked.withColumn("_back", F.lag("cp").over(Window.partitionBy(*keys).orderBy(order)) > F.col("cp"))
        bad = bad.when(F.col("_back"), "change points are not sorted")
    return checked.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(True)).select(*cps.columns)


def _check_margin(margin: float) -> None:
    if margin <= 0:
        raise ValueError("margin must be positive")


def tolerance_pairs(true: DataFrame, pred: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """(keys, true_cp, pred_cp, distance) within the margin. Both sides are dealt by (keys, bucket of the margin's
    width), a true point to its bucket and both neighbours, so the band join is an equi-join."""
    width = F.lit(int(margin) + 1)
    t = true.select(*keys, F.col("cp").alias("true_cp"), F.explode(F.sequence(F.floor(F.col("cp") / width) - 1, F.floor(F.col("cp") / width) + 1)).alias("_b"))
    p = pred.select(*keys, F.col("cp").alias("pred_cp"), F.floor(F.col("cp") / width).alias("_b"))
    distance = F.abs(F.col("true_cp") - F.col("pred_cp"))
    return t.join(p, [*keys, "_b"]).filter(distance <= margin).select(*keys, "true_cp", "pred_cp", distance.alias("distance"))


def matches(true: DataFrame, pred: DataFrame, keys: list[str], margin: float) -> DataFrame:
    """(keys, true_cp, pred_cp, distance): one-to-one, nearest first, ties by position."""
    _check_margin(margin)
    return closest_pairs(true, pred, keys, margin)


def unmatched(cps: DataFrame, matched: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Change points of one side ("true" or "pred") that no match took."""
    return cps.join(matched.select(*keys, F.col(f"{side}_cp").alias("cp")), [*keys, "cp"], "left_anti")


def _counts(sizes: DataFrame, keys: list[str], **tables: DataFrame) -> DataFrame:
    out = sizes.select(*keys, "n")
    for name, t in tables.items():
        out = out.join(t.groupBy(*keys).agg(F.count("*").alias(name)), keys, "left")
    return out.select(*keys, "n", *[F.coalesce(k, F.lit(0)).alias(k) for k in tables])


def _ratios(counts: DataFrame) -> DataFrame:
    none_true, none_pred = F.col("n_true") == 0, F.col("n_pred") == 0
    p = F.when(none_pred, 1.0).when(none_true, 0.0).otherwise(F.col("tp") / F.greatest("n_pred", F.lit(1)))
    r = F.when(none_true, 1.0).when(none_pred, 0.0).otherwise(F.col("tp") / F.greatest("n_true", F.lit(1)))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f_beta("precision", "recall", 1.0))


def f_beta(p: str, r: str, beta: float) -> Column:
    b = beta * beta
    return F.when(F.col(p) + F.col(r) == 0, 0.0).otherwise((1 + b) * F.col(p) * F.col(r) / (b * F.col(p) + F.col(r)))


def precision_recall(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str], margin: float = 10) -> DataFrame:
    """(keys, n_true, n_pred, tp, fp, fn, precision, recall, f1)."""
    m = matches(true, pred, keys, margin)
    out = _ratios(_counts(sizes, keys, n_true=true, n_pred=pred, tp=m))
    return out.select(*keys, "n_true", "n_pred", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_true") - F.col("tp")).alias("fn"), "precision", "recall", "f1")


def f_beta_score(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str], beta: float = 1.0, margin: float = 10) -> DataFrame:
    """(keys, precision, recall, f_beta, f1, f2, f0_5)."""
    out = precision_recall(true, pred, sizes, keys, margin)
    return out.select(*keys, "precision", "recall", f_beta("precision", "recall", beta).alias("f_beta"), "f1", f_beta("precision", "recall", 2.0).alias("f2"), f_beta("precision", "recall", 0.5).alias("f0_5"))


def nearest(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cp, near, distance): nearest change point of ``b`` to each of ``a``, the smaller of two. Both sides run
    in one order per series, the last and next ``b`` flowing past each ``a``: no pairs are made."""
    both = a.select(*keys, "cp", F.lit(True).alias("_own")).union(b.select(*keys, "cp", F.lit(False)))
    w = Window.partitionBy(*keys).orderBy("cp")
    other = F.when(~F.col("_own"), F.col("cp"))
    before = F.last(other, True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    after = F.last(other, True).over(Window.partitionBy(*keys).orderBy(F.desc("cp")).rangeBetween(Window.unboundedPreceding, 0))  # a frame towards the end would be read anew for each row
    placed = both.select(*keys, "cp", "_own", before.alias("_b"), after.alias("_a")).filter("_own")
    near = F.when(F.col("_b").isNull(), F.col("_a")).when(F.col("_a").isNull() | (F.col("cp") - F.col("_b") <= F.col("_a") - F.col("cp")), F.col("_b")).otherwise(F.col("_a"))
    return placed.select(*keys, "cp", near.alias("near")).filter("near IS NOT NULL").withColumn("distance", F.abs(F.col("cp") - F.col("near")))


def hausdorff_distance(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, forward, backward, hausdorff): both sides empty 0, one empty infinite."""
    one = lambda a, b, name: nearest(a, b, keys).groupBy(*keys).agg(F.max("distance").cast("double").alias(name))
    out = _counts(sizes, keys, n_true=true, n_pred=pred).join(one(true, pred, "forward"), keys, "left").join(one(pred, true, "backward"), keys, "left")
    none = F.when((F.col("n_true") == 0) & (F.col("n_pred") == 0), 0.0).otherwise(float("inf"))
    fill = lambda c: F.coalesce(F.col(c), none)
    return out.select(*keys, fill("forward").alias("forward"), fill("backward").alias("backward"), F.greatest(fill("forward"), fill("backward")).alias("hausdorff"))


METHODS = ("mae", "mse", "rmse", "median_ae")


def annotation_error(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str], method: str = "mae") -> DataFrame:
    """(keys, error, mae, mse, rmse, median_ae, max_error, min_error, mean_error, std_error, n_matched): closest pairs
    are taken until one side is used up. NaN without pairs."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    taken = closest_pairs(true, pred, keys).select(*keys, F.col("distance").cast("double").alias("e"))
    e = F.col("e")
    stats = taken.groupBy(*keys).agg(F.avg(e).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.percentile(e, F.lit(0.5)).alias("median_ae"), F.max(e).alias("max_error"), F.min(e).alias("min_error"), F.avg(e).alias("mean_error"), F.stddev_pop(e).alias("std_error"), F.count("*").alias("n_matched"))
    out = sizes.select(*keys).join(stats, keys, "left")
    names = ["mae", "mse", "rmse", "median_ae", "max_error", "min_error", "mean_error", "std_error"]
    nan = lambda c: F.coalesce(F.col(c), F.lit(float("nan")))
    return out.select(*keys, nan(method).alias("error"), *[nan(c).alias(c) for c in names], F.coalesce("n_matched", F.lit(0)).alias("n_matched"))


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a_end, b_end, overlap) of the segments of two partitions that meet: the common refinement's pieces, from
    one ordered pass over both sides' borders instead of an interval join."""
    marks = a.select(*keys, F.col("start").alias("at"), F.col("end").alias("_ea"), F.lit(None).cast("long").alias("_eb")).union(b.select(*keys, "start", F.lit(None).cast("long"), "end"))
    at = marks.groupBy(*keys, "at").agg(F.max("_ea").alias("_ea"), F.max("_eb").alias("_eb"))
    w = Window.partitionBy(*keys).orderBy("at")
    flow = w.rowsBetween(Window.unboundedPreceding, 0)
    filled = at.select(*keys, "at", F.last("_ea", True).over(flow).alias("a_end"), F.last("_eb", True).over(flow).alias("b_end"))
    return filled.select(*keys, "a_end", "b_end", (F.least("a_end", "b_end") - F.col("at")).alias("overlap")).filter("overlap > 0")


def adjusted_rand_index(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rand_index, ari, disagreement, true_ari): ``ari`` repeats the unadjusted index; ``true_ari`` is adjusted.
    A series of one row agrees with itself."""
    from .post import segments

    a, b = segments(true, sizes, keys), segments(pred, sizes, keys)
    pieces = overlaps(a, b, keys)
    choose = lambda c: c * (c - 1) / 2
    n2 = choose(F.col("n"))
    sums = pieces.groupBy(*keys).agg(F.sum(F.col("overlap") * F.abs(F.col("a_end") - F.col("b_end"))).alias("_d"), F.sum(choose(F.col("overlap"))).alias("_ij"))
    side = lambda s, name: s.groupBy(*keys).agg(F.sum(choose(F.col("end") - F.col("start"))).alias(name))
    out = sizes.join(sums, keys).join(side(a, "_i"), keys).join(side(b, "_j"), keys)
    expected = F.col("_i") * F.col("_j") / n2
    most = (F.col("_i") + F.col("_j")) / 2
    rand = F.when(F.col("n") < 2, 1.0).otherwise(1 - F.col("_d") / n2)
    adjusted = F.when((F.col("n") < 2) | (most == expected), 1.0).otherwise((F.col("_ij") - expected) / (most - expected))
    return out.select(*keys, rand.alias("rand_index"), rand.alias("ari"), F.when(F.col("n") < 2, 0.0).otherwise(F.col("_d") / n2).alias("disagreement"), adjusted.alias("true_ari"))


def covering_metric(annotations: DataFrame, annotators: DataFrame, pred: DataFrame, keys: list[str], margin: float = 10) -> DataFrame:
    """(keys, covering, std_recall, min_recall, max_recall, n_annotators): recall of each annotator's change points.
    ``annotators`` is (keys, annotator_id) and names those without any, whose recall is 1."""
    _check_margin(margin)
    both = [*keys, "annotator_id"]
    spread = annotators.join(pred, keys).select(*both, "cp")
    m = matches(annotations, spread, both, margin)
    n = annotators.join(annotations.groupBy(*both).agg(F.count("*").alias("n_true")), both, "left").join(m.groupBy(*both).agg(F.count("*").alias("tp")), both, "left")
    recall = n.select(*both, F.when(F.coalesce("n_true", F.lit(0)) == 0, 1.0).otherwise(F.coalesce("tp", F.lit(0)) / F.col("n_true")).alias("recall"))
    return recall.groupBy(*keys).agg(F.avg("recall").alias("covering"), F.stddev_pop("recall").alias("std_recall"), F.min("recall").alias("min_recall"), F.max("recall").alias("max_recall"), F.count("*").alias("n_annotators"))


def union_of_annotators(annotations: DataFrame, keys: list[str]) -> DataFrame:
    return annotations.select(*keys, "cp").distinct()


def margin_sweep(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str], margins=MARGINS) -> DataFrame:
    """(keys, margin, precision, recall, f1): points are matched once, for the largest margin. Pairs are taken nearest
    first, so the matches of a smaller margin are those of the larger one that it holds."""
    for m in margins:
        _check_margin(m)
    every, own = F.array(*[F.lit(int(m)) for m in margins]), [*keys, "margin"]
    pairs = matches(true, pred, keys, max(margins)).withColumn("margin", F.explode(every)).filter("distance <= margin")
    spread = lambda df: df.withColumn("margin", F.explode(every))
    out = _ratios(_counts(spread(sizes), own, n_true=spread(true), n_pred=spread(pred), tp=pairs))
    return out.select(*own, "precision", "recall", "f1")


def evaluate_all(true: DataFrame, pred: DataFrame, sizes: DataFrame, keys: list[str], margin: float = 10, annotators: DataFrame | None = None) -> DataFrame:
    """One row per series with all metrics as structs and a text summary. With an ``annotator_id`` in ``true`` the
    points of all annotators are joined for the other metrics, and each one's recall makes the covering."""
    many = "annotator_id" in true.columns
    flat = union_of_annotators(true, keys) if many else true
    pack = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    parts = [pack(precision_recall(flat, pred, sizes, keys, margin), "point"), pack(f_beta_score(flat, pred, sizes, keys, 1.0, margin), "f_scores"), pack(hausdorff_distance(flat, pred, sizes, keys), "distance"), pack(annotation_error(flat, pred, sizes, keys), "annotation"), pack(adjusted_rand_index(flat, pred, sizes, keys), "segmentation")]
    if many:
        who = true.select(*keys, "annotator_id").distinct() if annotators is None else annotators
        parts.append(pack(covering_metric(true, who, pred, keys, margin), "covering"))
    out = sizes.select(*keys)
    for p in parts:
        out = out.join(p, keys, "left")
    text = F.format_string("precision %.3f, recall %.3f, F1 %.3f, Hausdorff %.1f, MAE %.3f, Rand index %.3f", "point.precision", "point.recall", "point.f1", "distance.hausdorff", "annotation.mae", "segmentation.rand_index")
    return out.withColumn("summary", text)


def best_beta(grid: DataFrame, true: DataFrame, sizes: DataFrame, keys: list[str], margin: float = 10) -> DataFrame:
    """(keys, beta, f1): of a grid of penalties (keys, beta, cp), the one with the best F1, the smallest of equals."""
    betas = grid.select("beta").distinct()
    own = [*keys, "beta"]
    score = precision_recall(true.crossJoin(F.broadcast(betas)), grid, sizes.crossJoin(F.broadcast(betas)), own, margin)  # a few penalties
    return score.groupBy(*keys).agg(F.max_by(F.struct("beta", "f1"), F.struct("f1", -F.col("beta"))).alias("x")).select(*keys, "x.beta", "x.f1")
