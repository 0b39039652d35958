"""Models with a Spark ML counterpart, calibration, contributions, scoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.operators import svm
from sensorloom.operators.evaluate import best_f1_on_curve, ranking_metrics
from sensorloom.operators.ordered import Series, carry_forward, even_blocks, with_scalar
from sensorloom.operators.quantiles import bisected, exact_quantiles
from sensorloom.operators.resample import balanced_class_weight
from sensorloom.operators.splits import group_kfold
from sensorloom.session import cut_lineage, written


def _stages(features: Sequence[str], scale: bool) -> list:
    out = [VectorAssembler(inputCols=list(features), outputCol="__raw" if scale else "features")]
    if scale:
        out.append(StandardScaler(inputCol="__raw", outputCol="features", withMean=True, withStd=True))
    return out


def _fit(stages: list, rows: DataFrame) -> PipelineModel:
    """Fit on checkpointed training rows: iterations start from files, with a short lineage,
    and a lost executor costs a re-read and not the whole assembly."""
    return Pipeline(stages=stages).fit(cut_lineage(rows))


def linear_svm(train: DataFrame, features: Sequence[str], label: str, c: float = 1.0, rounds: int = 60) -> svm.SquaredHinge:
    """Scaled, class-balanced linear SVM with the squared hinge."""
    return svm.fit(train, features, label, [(c, svm.NO_FOLD)], rounds=rounds)[0]


def margin_score(model: svm.SquaredHinge, df: DataFrame) -> DataFrame:
    """Logistic of the SVM margin as ``score``."""
    return df.select("*", (F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin()))).alias("score"))


def probability_score(model, df: DataFrame) -> DataFrame:
    """Probability of class 1 as ``score``."""
    return model.transform(df).select(*df.columns, vector_to_array("probability")[1].alias("score"))


def svm_grid(train: DataFrame, features: Sequence[str], label: str, group: Sequence[str],
             cs: Sequence[float] = (0.25, 0.5, 1.0, 2.0, 5.0, 10.0, 20.0), folds: int = 3, rounds: int = 60) -> DataFrame:
    """Mean average precision and median best-F1 threshold of each penalty over group folds.

    All penalties and folds are fitted in the same passes; a row is scored by the machines that did not see its fold, and all of
    them are ranked in one job. ``rounds`` and ``converged`` tell how the fits ended.
    """
    folded = written(group_kfold(train, group, folds).select(svm.raw(features).alias("__x"), label, "fold"), "folded")
    fits = svm.fit(folded, features, label, [(c, k) for c in cs for k in range(folds)], "fold", rounds, "__x")
    scored = svm.fold_margins(folded.filter(F.col(label).isNotNull()), fits, "fold", ["fold", label], "__x")
    scored = scored.select("fold", label, "c", (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("margin")))).alias("score"))
    scored = written(scored, "fold-scores")  # ranked twice
    by = ["c", "fold"]
    both = ranking_metrics(scored, "score", label, by).join(best_f1_on_curve(scored, "score", label, by), by)
    ends = train.sparkSession.createDataFrame(
        [(float(c), max(m.rounds for m in fits if m.c == c), all(m.converged for m in fits if m.c == c)) for c in cs], "c double, rounds int, converged boolean")
    return both.groupBy("c").agg(F.avg("average_precision").alias("average_precision"), F.percentile("threshold", 0.5).alias("threshold")).join(ends, "c")


def boosted_trees(train: DataFrame, validation: DataFrame, features: Sequence[str], label: str, weight: str | None = None,
                  rounds: int = 50, depth: int = 4, step: float = 0.1, seed: int = 42) -> PipelineModel:
    """Weighted gradient-boosted trees, stopped early on the validation rows."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = train.withColumn("__val", F.lit(False)).unionByName(validation.withColumn("__val", F.lit(True)), allowMissingColumns=True)
    rows = rows.withColumn("__w", F.coalesce(w, F.lit(1.0)))
    gbt = GBTClassifier(featuresCol="features", labelCol=label, weightCol="__w", validationIndicatorCol="__val", maxIter=rounds,
                        maxDepth=depth, stepSize=step, subsamplingRate=0.9, seed=seed)
    return _fit([*_stages(features, False), gbt], rows)


def logistic_baseline(train: DataFrame, features: Sequence[str], label: str) -> PipelineModel:
    """Class-balanced logistic regression."""
    lr = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", maxIter=100)
    return _fit([*_stages(features, True), lr], balanced_class_weight(train.select(*features, label), label))


def isotonic_global(calibration: DataFrame, df: DataFrame, score: str, label: str) -> DataFrame:
    """Isotonic calibration fitted on ``calibration``, as ``calibrated``; constant beyond its range."""
    model = IsotonicRegression(featuresCol=score, labelCol=label, predictionCol="calibrated").fit(
        calibration.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias(label)))
    return model.transform(df)


def pool_adjacent(lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, n: np.ndarray) -> list[tuple[float, float, float, float]]:
    """Pool neighbours until the means no longer decrease."""
    out: list[list[float]] = []
    for a, b, p, w in zip(lo, hi, pos, n):
        out.append([a, b, p, w])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            a1, _, p1, w1 = out[-2]
            _, b2, p2, w2 = out.pop()
            out[-1] = [a1, b2, p1 + p2, w1 + w2]
    return [tuple(x) for x in out]


def isotonic_pools(calibration: DataFrame, base: str, score: str, label: str, min_pos: int = 5) -> DataFrame:
    """Isotonic pools (base, lo, hi, value) for the bases with enough positives.

    Scores are counted first; pooling runs per (base, score block) and then per base on what is
    left, which gives the same pools. What is left has strictly rising shares; shares with small
    counts repeat, so n rows leave in the order of n^(2/3) pools at most per block.
    """
    counts = calibration.groupBy(base, F.col(score).cast("double").alias("lo")).agg(
        F.sum(F.col(label).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("n"))
    enough = counts.groupBy(base).agg(F.sum("pos").alias("p")).filter(F.col("p") >= min_pos).select(base)
    rows = even_blocks(counts.join(enough, base).select(base, "lo", F.col("lo").alias("hi"), "pos", "n"), [base, "lo"], blocks=256)
    kind = dict(calibration.dtypes)[base]

    def pool(pdf: pd.DataFrame) -> pd.DataFrame:
        s = pdf.sort_values("lo")
        pools = pool_adjacent(*(s[c].to_numpy() for c in ("lo", "hi", "pos", "n")))
        out = pd.DataFrame(pools, columns=["lo", "hi", "pos", "n"])
        out.insert(0, base, s[base].iloc[0])
        return out

    schema = f"`{base}` {kind}, lo double, hi double, pos double, n double"
    first = rows.groupBy(base, "__block").applyInPandas(pool, schema)
    return first.groupBy(base).applyInPandas(pool, schema).select(base, "lo", "hi", (F.col("pos") / F.col("n")).alias("value"))


def apply_pools(df: DataFrame, pools: DataFrame, base: str, score: str, name: str = "calibrated") -> DataFrame:
    """Calibrated score: the pool's value inside a pool, linear between two pools, the end
    values beyond; the score itself for a base without pools.

    Distinct scores and pool ends are merged into one order and the neighbours carried over.
    """
    pools = cut_lineage(pools)  # read several times below
    asks = df.select(base, F.col(score).cast("double").alias("x")).filter("x IS NOT NULL").distinct()
    knots = pools.select(base, F.inline(F.array(F.struct(F.col("lo").alias("x"), F.col("value").alias("v")), F.struct(F.col("hi").alias("x"), F.col("value").alias("v"))))).distinct()
    merged = asks.select(base, "x", F.lit(None).cast("double").alias("v"), F.lit(True).alias("ask")).unionByName(knots.withColumn("ask", F.lit(False)))
    merged = merged.groupBy(base, "x").agg(F.max("v").alias("v"), F.max("ask").alias("ask"))
    knot = F.when(F.col("v").isNotNull(), F.struct("x", "v"))
    series = Series([base], ["x"], F.col("__cut"))
    both = carry_forward(even_blocks(merged.withColumns({"left": knot, "right": knot}), [base, "x"], "__cut"), series, {"left": F.col("left")})
    both = carry_forward(both, series, {"right": F.col("right")}, backward=True)
    l, r = F.col("left"), F.col("right")
    between = l["v"] + (r["v"] - l["v"]) * F.coalesce((F.col("x") - l["x"]) / F.nullif(r["x"] - l["x"], F.lit(0.0)), F.lit(0.0))
    value = F.when(l.isNull(), r["v"]).when(r.isNull(), l["v"]).otherwise(between)
    table = both.filter("ask").select(base, F.col("x").alias("__x"), value.alias("__v"))
    joined = df.withColumn("__x", F.col(score).cast("double")).join(table, [base, "__x"], "left")
    return joined.select(*df.columns, F.coalesce("__v", F.col(score).cast("double")).alias(name))


def linear_contributions(df: DataFrame, coefficients: dict[str, float], means: Column | None = None, suffix: str = "_shap") -> DataFrame:
    """coefficient * (x - mean) per feature; the mean over ``df`` unless given as a struct."""
    if means is None:
        means = df.agg(F.struct(*[F.avg(c).alias(c) for c in coefficients]).alias("m")).scalar()
    shares = [(F.lit(float(w)) * (F.col(c) - F.col("__m")[c])).alias(c + suffix) for c, w in coefficients.items()]
    return with_scalar(df, __m=means).select(*df.columns, *shares)


def contribution_ranking(contributions: DataFrame, features: Sequence[str], suffix: str = "_shap") -> DataFrame:
    """Mean absolute contribution per feature, largest first."""
    wide = contributions.agg(*[F.avg(F.abs(c + suffix)).alias(c) for c in features])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("impact")) for c in features]))).orderBy(F.desc("impact"), "feature")


def risk_ranges(contributions: DataFrame, features: Sequence[str], suffix: str = "_shap") -> DataFrame:
    """Range of a feature over the rows where it raises the score."""
    aggs = [fn(F.when(F.col(c + suffix) > 0, F.col(c).cast("double"))).alias(f"{n}_{c}") for c in features for n, fn in (("lo", F.min), ("hi", F.max))]
    return contributions.agg(*aggs).select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi")) for c in features])))


def mutual_information(df: DataFrame, features: Sequence[str], label: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature with the label, over quantile bins (natural logarithm)."""
    probs = {f"_{i}": i / bins for i in range(1, bins)}
    q = exact_quantiles(df, [], {c: F.col(c) for c in features}, probs).first()  # one row of cuts
    def cell(c: str) -> Column:
        return bisected(F.col(c), [cut for i in range(1, bins) if (cut := q[f"{c}_{i}"]) is not None], strict=True)
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), cell(c).alias("bin")) for c in features])
    cells = df.select(F.col(label).alias("y"), F.explode(pairs).alias("p")).groupBy("p.feature", "p.bin", "y").agg(F.count(F.lit(1)).alias("n"))
    # At most features x bins x classes rows from here on.
    def total(*by: str) -> Column:
        return F.sum("n").over(Window.partitionBy("feature", *by))
    j = cells.select("feature", "n", total("bin").alias("nx"), total("y").alias("ny"), total().alias("nt"))
    n, nt = F.col("n"), F.col("nt")
    return j.groupBy("feature").agg(F.sum(n / nt * F.log(n * nt / (F.col("nx") * F.col("ny")))).alias("mi"))


def keep_by_information(mi: DataFrame, features: Sequence[str], blocks: Sequence[str] = ("_last", "_mean"), share: float = 0.8) -> list[str]:
    """Best share of the features by the mean of their blocks' information; one row per feature is read."""
    scores = {row["feature"]: row["mi"] for row in mi.collect()}
    mean = {f: sum(scores.get(f + b, 0.0) for b in blocks) / len(blocks) for f in features}
    count = max(1, math.ceil(len(features) * share))
    best = set(sorted(features, key=lambda f: (-mean[f], f))[:count])
    return [f for f in features if f in best]


def label_scores(scored: DataFrame, score: str, threshold: float | Column) -> DataFrame:
    """Predicted label at a threshold."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return scored.withColumn("predicted", (F.col(score) >= t).cast("int"))
