"""Scores per group, ranking metrics, thresholds.

All metrics start from counts per distinct score, so ties share one step and the rows are
shuffled once with map-side combination. Running totals over the scores are cut into blocks
of equal size, so that a table with as many scores as rows is not sorted by one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators.ordered import EVEN, Series, last_rows, running, salted_join, with_scalar
from sensorloom.operators.quantiles import exact_quantiles

EPS = 1e-8


def group_probability(df: DataFrame, keys: Sequence[str], p: str, method: str = "noisyor", r_date: str | None = None,
                      date: str | None = None, decay: float = 0.05) -> DataFrame:
    """Probability of a group from its rows: noisy-or, mean, max, or a mean weighted by age."""
    x = F.col(p)
    if method == "mean":
        out = F.avg(x)
    elif method == "max":
        out = F.max(x)
    elif method == "wavg":
        w = F.exp(-F.lit(decay) * F.greatest(F.datediff(F.col(r_date), F.col(date)), F.lit(0)))
        w = F.when(x.isNotNull(), w)
        out = F.sum(w * x) / F.nullif(F.sum(w), F.lit(0.0))
    else:
        sure = F.max(F.when(x >= 1.0, 1).otherwise(0)) == 1
        out = F.when(sure, F.lit(1.0)).otherwise(F.lit(1.0) - F.exp(F.sum(F.when(x < 1.0, F.log1p(-x)))))
    return df.groupBy(*keys).agg(out.alias("probability"))


def smoothed_prior(df: DataFrame, train: DataFrame, base: str, label: str, m: float = 20.0) -> DataFrame:
    """(positives + m * g) / max(1, n + m) per base on the training rows, g where a base is unseen."""
    g = train.agg(F.avg(label).alias("g")).scalar()
    table = train.groupBy(base).agg(F.sum(label).alias("__s"), F.count(label).alias("__n"))
    prior = (F.coalesce("__s", F.lit(0)) + F.lit(m) * F.col("__g")) / F.greatest(F.lit(1.0), F.coalesce("__n", F.lit(0)) + F.lit(m))
    return with_scalar(salted_join(df, table, [base]), __g=g).select(*df.columns, prior.alias("prior"))


def base_rate(df: DataFrame, train: DataFrame, base: str, label: str) -> DataFrame:
    """Positive rate of the base on the training rows, the overall rate where it is unseen."""
    g = train.agg(F.avg(label).alias("g")).scalar()
    table = train.groupBy(base).agg(F.avg(label).alias("__rate"))
    return salted_join(df, table, [base]).select(*df.columns, F.coalesce("__rate", g).alias("rate"))


def clean_scores(df: DataFrame, score: str, label: str) -> DataFrame:
    """Rows with a label; missing scores 0.5, all scores in [0, 1]."""
    s = F.when(F.col(score).isNull() | F.isnan(score), F.lit(0.5)).otherwise(F.col(score))
    return df.filter(F.col(label).isNotNull()).withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(1.0), s)))


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and positives per distinct score."""
    return df.groupBy(*by, F.col(score).alias("score")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def ranking_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """True and false positives at each distinct score as threshold, with the totals."""
    counts = score_counts(df, score, label, by)
    # Falling scores, NaN above all and null below.
    down = [F.when(F.col("score").isNull(), 2).when(F.isnan("score"), 0).otherwise(1), F.when(~F.isnan("score"), -F.col("score"))]
    curve = running(counts, Series(list(by), down, EVEN), {"tp": F.col("pos"), "seen": F.col("n")})
    totals = counts.agg(F.struct(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("steps")).alias("t"))
    if by:
        totals = counts.groupBy(*by).agg(F.struct(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("steps")).alias("t"))
        curve = curve.join(totals, list(by))
    else:
        curve = with_scalar(curve, t=totals.scalar())
    t = F.col("t")
    return curve.select(*by, "score", "n", "pos", "tp", (F.col("seen") - F.col("tp")).alias("fp"),
                        t["p"].alias("total_pos"), (t["n"] - t["p"]).alias("total_neg"), t["steps"].alias("steps"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))


def _rates(tp: str = "tp", fp: str = "fp", p: str = "total_pos") -> dict[str, Column]:
    prec = _ratio(F.col(tp), F.col(tp) + F.col(fp))
    rec = _ratio(F.col(tp), F.col(p))
    return {"precision": prec, "recall": rec}


def ranking_metrics(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve and average precision (step sum); 0.5 and the prevalence for a
    single class or a constant score."""
    curve = ranking_curve(df, score, label, by)
    neg = F.col("n") - F.col("pos")
    area = F.sum(neg * (F.col("tp") - F.col("pos") / F.lit(2.0)))
    step = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    p, n, steps = F.max("total_pos"), F.max("total_neg"), F.max("steps")
    flat = (p == 0) | (n == 0) | (steps == 1)
    return curve.groupBy(*by).agg(
        F.when(flat, F.lit(0.5)).otherwise(area / F.nullif(p * n, F.lit(0))).alias("roc_auc"),
        F.when(flat, p / (p + n)).otherwise(step / F.nullif(p, F.lit(0))).alias("average_precision"),
        p.alias("positives"), n.alias("negatives"))


def best_f1_on_curve(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Observed score with the highest F1, the lowest such score on a tie."""
    curve = ranking_curve(df, score, label, by).select("*", *[e.alias(n) for n, e in _rates().items()])
    f1 = F.lit(2.0) * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(EPS))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("score")).alias("s")))
    return curve.groupBy(*by).agg(best.alias("b")).select(*by, (-F.col("b.s")).alias("threshold"), F.col("b.f1").alias("f1"))


def median_threshold(per_fold: DataFrame) -> DataFrame:
    """Median of the thresholds of a few folds."""
    return per_fold.agg(F.percentile("threshold", 0.5).alias("threshold"))


def confusion(df: DataFrame, score: str, label: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Counts and derived metrics at a threshold; a zero denominator gives 0."""
    rows = clean_scores(df, score, label)
    hit, y = F.col(score) >= (threshold if isinstance(threshold, Column) else F.lit(threshold)), F.col(label) == 1
    c = rows.groupBy(*by).agg(
        F.count(F.when(hit & y, 1)).alias("tp"), F.count(F.when(hit & ~y, 1)).alias("fp"),
        F.count(F.when(~hit & ~y, 1)).alias("tn"), F.count(F.when(~hit & y, 1)).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    rec, spec = _ratio(tp, tp + fn), _ratio(tn, tn + fp)
    return c.select(
        *by, "tp", "fp", "tn", "fn", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"), rec.alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        spec.alias("specificity"), _ratio(tn, tn + fn).alias("npv"), ((rec + spec) / F.lit(2.0)).alias("balanced_accuracy"))


def grid_stats(df: DataFrame, score: str, label: str, lowest: Column, highest: Column, size: int) -> DataFrame:
    """Confusion counts at ``size`` evenly spaced thresholds.

    Each distinct score goes to the highest threshold it reaches; counts are then summed from
    the top over the grid cells. The grid is never joined with the scores.
    """
    lo, hi = F.col("__lo"), F.col("__hi")
    step = (hi - lo) / F.lit(float(size - 1))
    def threshold(j: Column) -> Column:
        return F.when(j == size - 1, hi).otherwise(lo + j * step)
    # The quotient may be off by one at a threshold; the comparison itself decides.
    guess = F.floor((F.col("score") - lo) / F.nullif(step, F.lit(0.0)))
    cell = F.lit(None).cast("long")
    for shift in (-1, 0, 1):
        j = F.least(F.greatest(guess + shift, F.lit(0)), F.lit(size - 1))
        cell = F.when(F.col("score") >= threshold(j), j).otherwise(cell)
    counts = with_scalar(score_counts(df, score, label), __lo=lowest, __hi=highest)
    # Scores below the grid get cell -1: they count in the totals only.
    cells = counts.select(F.coalesce(cell, F.lit(-1)).alias("j"), "n", "pos").groupBy("j").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    grid = df.sparkSession.range(-1, size).withColumnRenamed("id", "j").join(cells, "j", "left")
    # A fixed number of cells, so one task is enough.
    top = Window.orderBy(F.desc("j")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy()
    n, pos = F.coalesce("n", F.lit(0)), F.coalesce("pos", F.lit(0))
    s = grid.select("j", F.sum(pos).over(top).alias("tp"), F.sum(n).over(top).alias("hits"), F.sum(pos).over(whole).alias("p"), F.sum(n).over(whole).alias("all"))
    s = with_scalar(s.filter("j >= 0"), __lo=lowest, __hi=highest)
    return _stats(s.select("j", threshold(F.col("j")).alias("t"), "tp", (F.col("hits") - F.col("tp")).alias("fp"), "p", "all"))


def _stats(s: DataFrame) -> DataFrame:
    """From tp, fp, p, all to the rates of one threshold."""
    tp, fp = F.col("tp"), F.col("fp")
    out = s.withColumns({"fn": F.col("p") - tp, "tn": F.col("all") - F.col("p") - fp,
                         "precision": _ratio(tp, tp + fp), "recall": _ratio(tp, F.col("p")),
                         "fpr": _ratio(fp, F.col("all") - F.col("p")), "pos_rate": _ratio(tp + fp, F.col("all"))})
    pr, rc = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.when(pr + rc > 0, F.lit(2.0) * pr * rc / (pr + rc + F.lit(EPS))).otherwise(F.lit(0.0)))


def score_range(df: DataFrame, score: str) -> tuple[Column, Column]:
    b = df.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("b")).scalar()
    return b["lo"], b["hi"]


def _first(stats: DataFrame, *ranks: Column) -> DataFrame:
    """The row that is smallest by ``ranks``, the lowest threshold on a tie."""
    return stats.orderBy(*ranks, "j").limit(1)


def pick_threshold(df: DataFrame, score: str, label: str, policy: str = "f1", target_pos_rate: float | None = None,
                   target_value: float | None = None, fp_cost: float | None = None, fn_cost: float | None = None,
                   grid_size: int = 401, min_pos_rate: float | None = None, max_pos_rate: float | None = None) -> DataFrame:
    """One row: the threshold chosen by the policy over an even grid of the score range, its
    F1, precision, recall and positive rate. A positive-rate band, if given, moves the choice to
    the grid point nearest to the band."""
    lo, hi = score_range(df, score)
    stats = grid_stats(df, score, label, lo, hi, grid_size)
    if policy == "f1":
        best = _first(stats, F.desc("f1"))
        if target_pos_rate is not None:
            peak = stats.agg(F.max("f1").alias("m")).scalar()
            best = _first(stats.filter(F.col("f1") >= F.lit(0.9) * peak), F.abs(F.col("pos_rate") - F.lit(target_pos_rate)))
    elif policy == "youden":
        best = _first(stats, F.desc(F.col("recall") - F.col("fpr")))
    elif policy == "quantile":
        if target_pos_rate is None:
            raise ValueError("the quantile policy needs target_pos_rate")
        t = exact_quantiles(df, [], {"t": F.col(score)}, {"": 1.0 - target_pos_rate}).select("t").scalar()
        hit = F.col(score) >= t
        at = df.agg(F.count(F.when(hit & (F.col(label) == 1), 1)).alias("tp"), F.count(F.when(hit & (F.col(label) == 0), 1)).alias("fp"),
                    F.count(F.when(F.col(label) == 1, 1)).alias("p"), F.count(F.lit(1)).alias("all"))
        best = _stats(at.select(F.lit(-1).cast("long").alias("j"), t.alias("t"), "tp", "fp", "p", "all"))
    elif policy in ("precision_at", "recall_at"):
        if target_value is None:
            raise ValueError(f"the {policy} policy needs target_value")
        fixed, free = ("precision", "recall") if policy == "precision_at" else ("recall", "precision")
        reached = F.col(fixed) >= target_value
        best = _first(stats, F.desc(reached), F.desc(F.when(reached, F.col(free)).otherwise(F.col(fixed))))
    elif policy == "cost":
        if fp_cost is None or fn_cost is None:
            raise ValueError("the cost policy needs fp_cost and fn_cost")
        best = _first(stats, F.col("fp") * F.lit(float(fp_cost)) + F.col("fn") * F.lit(float(fn_cost)))
    else:
        raise ValueError(f"unknown policy {policy}")
    if min_pos_rate is not None or max_pos_rate is not None:
        low, high = F.lit(min_pos_rate or 0.0), F.lit(1.0 if max_pos_rate is None else max_pos_rate)
        miss = F.greatest(low - F.col("pos_rate"), F.lit(0.0)) + F.greatest(F.col("pos_rate") - high, F.lit(0.0))
        inside = best.filter(miss == 0).withColumn("__o", F.lit(0))
        near = _first(stats, miss).withColumn("__o", F.lit(1))
        best = inside.unionByName(near).orderBy("__o").limit(1).drop("__o")
    best = with_scalar(best, __lo=lo, __hi=hi)
    flat = F.col("__lo") == F.col("__hi")
    cols = {"t": F.col("__hi"), "f1": F.lit(0.0), "precision": F.lit(0.0), "recall": F.lit(0.0), "pos_rate": F.lit(1.0)}
    return best.select(*[F.when(flat, v).otherwise(F.col(c)).alias("threshold" if c == "t" else c) for c, v in cols.items()])


def grid_f1(df: DataFrame, score: str, label: str) -> DataFrame:
    """F1 at 0.01, 0.02 ... 0.99."""
    s = grid_stats(df, score, label, F.lit(0.01), F.lit(0.99), 99)
    tp = F.col("tp")
    return s.select(F.round("t", 2).alias("threshold"), _ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def recall_threshold(df: DataFrame, score: str, label: str, target: float = 0.70, by: Sequence[str] = (),
                     min_pos: int = 0) -> DataFrame:
    """One observed score below the highest that still reaches the recall, per group with
    enough positives."""
    curve = ranking_curve(df, score, label, by)
    reached = curve.filter((F.col("total_pos") >= max(min_pos, 1)) & (F.col("tp") / F.col("total_pos") >= target))
    if not by:
        reached = reached.withColumn("__all", F.lit(0))
    top = last_rows(reached, list(by) or ["__all"], [F.desc("score")], 2)
    return top.groupBy(*by).agg(F.min("score").alias("threshold"))


def per_base_threshold(df: DataFrame, score: str, label: str, base: str, target: float = 0.70, min_pos: int = 5) -> DataFrame:
    """Threshold per base, the global one for a base with too few positives, 0.5 without any."""
    world = F.coalesce(recall_threshold(df, score, label, target).select("threshold").scalar(), F.lit(0.5))
    own = recall_threshold(df, score, label, target, [base], min_pos)
    return df.select(base).distinct().join(own, base, "left").select(base, F.coalesce("threshold", world).alias("threshold"))


def positive_rate_table(df: DataFrame, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Rows at or above each threshold, in one pass."""
    one = df.agg(F.count(F.lit(1)).alias("n"), F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.count(F.when(F.col(score) >= t, 1)).alias("above")) for t in thresholds]).alias("rows"))
    return one.select("n", F.inline("rows")).select("threshold", "above", (F.col("above") / F.col("n")).alias("share"))


def score_summary(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    """Min, mean, median, max and share at or above the threshold."""
    median = exact_quantiles(df, [], {"m": F.col(score)}, {"": 0.5}).select("m").scalar()
    return df.agg(F.min(score).alias("min"), F.avg(score).alias("mean"), F.max(score).alias("max"),
                  F.avg((F.col(score) >= threshold).cast("double")).alias("positive_share")).withColumn("median", median)
