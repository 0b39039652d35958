"""Group probabilities, priors, ranking metrics and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import evaluate
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query

rnd, r = B.rnd, B.r

# Probabilities for the group formulas: event value over 50, with exact ones and nulls among them.
PROB = f"""WITH {B.DAYS}, p AS (SELECT section, d, DATE '2024-01-31' AS r_date,
 CASE WHEN event_id % 97 = 0 THEN 1.0::DOUBLE WHEN event_id % 13 = 0 THEN NULL ELSE least(value / 500.0::DOUBLE, 1.0::DOUBLE) END AS p FROM days)"""


def probabilities(spark, sf):
    p = F.when(F.col("event_id") % 97 == 0, F.lit(1.0)).when(F.col("event_id") % 13 != 0, F.least(F.col("value") / 500.0, F.lit(1.0)))
    return B.days(spark, sf).select("section", "d", F.lit("2024-01-31").cast("date").alias("r_date"), p.alias("p"))


def _named(fn_name: str, operators: str, sql: str | None):
    """Register a query made by a factory under its own name."""
    def wrap(fn):
        fn.__name__ = fn_name
        return query(operators, sql)(fn)
    return wrap


for _method, _sql in {
    "noisyor": "CASE WHEN max(CASE WHEN p >= 1 THEN 1 ELSE 0 END) = 1 THEN 1.0::DOUBLE ELSE 1 - product(1 - p) END",
    "mean": "avg(p)", "max": "max(p)",
    "wavg": "sum(exp(-0.05::DOUBLE * greatest(r_date - d, 0)) * p) / sum(CASE WHEN p IS NOT NULL THEN exp(-0.05::DOUBLE * greatest(r_date - d, 0)) END)",
}.items():
    def _make(method=_method):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            out = evaluate.group_probability(probabilities(spark, sf), ["section", "d"], "p", method, "r_date", "d")
            return out.withColumn("probability", rnd("probability", 6))
        return run
    _named(f"group_probability_{_method}", "D15", PROB + f" SELECT section, d, {r(_sql, 6)} AS probability FROM p GROUP BY section, d")(_make())

TRAIN = "r_date < DATE '1998-01-01' AND base % 7 <> 2"


@query("D16 C12", f"""WITH {B.CONTEXTS}, g AS (SELECT avg(label) AS g FROM contexts WHERE {TRAIN}), b AS (SELECT base, sum(label) AS s, count(*) AS n FROM contexts WHERE {TRAIN} GROUP BY base)
SELECT key, {r('(coalesce(s, 0) + 20.0::DOUBLE * g) / greatest(1.0, coalesce(n, 0) + 20.0::DOUBLE)', 6)} AS prior FROM contexts LEFT JOIN b USING (base), g""")
def smoothed_prior(spark: SparkSession, sf: str) -> DataFrame:
    c = B.contexts(spark, sf).select("key", "base", "r_date", "label")
    return evaluate.smoothed_prior(c, c.filter(TRAIN), "base", "label").select("key", rnd("prior", 6).alias("prior"))


@query("D17", f"WITH {B.CONTEXTS}, b AS (SELECT base, avg(label) AS rate FROM contexts WHERE {TRAIN} GROUP BY base) SELECT key, {r(f'coalesce(rate, (SELECT avg(label) FROM contexts WHERE {TRAIN}))', 6)} AS rate FROM contexts LEFT JOIN b USING (base)")
def base_rate(spark: SparkSession, sf: str) -> DataFrame:
    c = B.contexts(spark, sf).select("key", "base", "r_date", "label")
    return evaluate.base_rate(c, c.filter(TRAIN), "base", "label").select("key", rnd("rate", 6).alias("rate"))


CURVE = f"""WITH {B.SCORES}, counts AS (SELECT {{by}} score, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM scores GROUP BY ALL),
curve AS (SELECT *, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(n - pos) OVER w AS BIGINT) AS fp, CAST(sum(pos) OVER t AS BIGINT) AS total_pos, CAST(sum(n - pos) OVER t AS BIGINT) AS total_neg
 FROM counts WINDOW w AS ({{part}} ORDER BY score DESC), t AS ({{part}}))"""
ALL = CURVE.format(by="", part="")
PER = CURVE.format(by="base,", part="PARTITION BY base")
AUC = f"{r('sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / (max(total_pos)::DOUBLE * max(total_neg))', 6)} AS roc_auc, {r('sum(pos * tp::DOUBLE / (tp + fp)) / max(total_pos)', 6)} AS average_precision, max(total_pos) AS positives, max(total_neg) AS negatives"


@query("E11", ALL + f" SELECT {r('score', 6)} AS score, n, pos, tp, fp, total_pos, total_neg, CAST((SELECT count(*) FROM counts) AS BIGINT) AS steps FROM curve")
def running_positives(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.ranking_curve(B.scores(spark, sf), "score", "label").withColumn("score", rnd("score", 6))


@query("L2 E11", ALL + f" SELECT {AUC} FROM curve")
def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.ranking_metrics(B.scores(spark, sf), "score", "label")
    return out.withColumns({c: rnd(c, 6) for c in ("roc_auc", "average_precision")})


@query("L2 E11", PER + f" SELECT base, {AUC} FROM curve GROUP BY base")
def ranking_metrics_per_base(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.ranking_metrics(B.scores(spark, sf), "score", "label", ["base"])
    return out.withColumns({c: rnd(c, 6) for c in ("roc_auc", "average_precision")})


F1 = """, f AS (SELECT *, 2.0::DOUBLE * (tp / (tp + fp)) * (tp / total_pos) / ((tp / (tp + fp)) + (tp / total_pos) + 1e-8) AS f1 FROM (SELECT * REPLACE (CAST(tp AS DOUBLE) AS tp) FROM curve))"""


@query("L3", ALL + F1 + f" SELECT {r('score', 6)} AS threshold, {r('f1', 6)} AS f1 FROM f ORDER BY f.f1 DESC, score LIMIT 1")
def best_f1_on_curve(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.best_f1_on_curve(B.scores(spark, sf), "score", "label")
    return out.select(rnd("threshold", 6).alias("threshold"), rnd("f1", 6).alias("f1"))


@query("L3", CURVE.format(by="mapped % 5 AS fold,", part="PARTITION BY fold") + F1 + f", b AS (SELECT fold, score, row_number() OVER (PARTITION BY fold ORDER BY f1 DESC, score) AS k FROM f) SELECT {r('median(score)', 6)} AS threshold FROM b WHERE k = 1")
def median_fold_threshold(spark: SparkSession, sf: str) -> DataFrame:
    df = B.scores(spark, sf).withColumn("fold", F.col("mapped") % 5)
    out = evaluate.median_threshold(evaluate.best_f1_on_curve(df, "score", "label", ["fold"]))
    return out.select(rnd("threshold", 6).alias("threshold"))


_CONF = f"""WITH {B.SCORES}, s AS (SELECT base, label, CASE WHEN score IS NULL THEN 0.5 ELSE greatest(0.0, least(1.0, score)) END AS score FROM (SELECT base, CASE WHEN ok % 11 <> 0 THEN label END AS label, CASE WHEN ok % 17 <> 0 THEN score * 1.2 END AS score FROM scores) WHERE label IS NOT NULL),
c AS (SELECT count(*) FILTER (score >= 0.45 AND label = 1) AS tp, count(*) FILTER (score >= 0.45 AND label = 0) AS fp, count(*) FILTER (score < 0.45 AND label = 0) AS tn, count(*) FILTER (score < 0.45 AND label = 1) AS fn FROM s)
SELECT tp, fp, tn, fn, {r('(tp + tn)::DOUBLE / (tp + fp + tn + fn)', 6)} AS accuracy, {r('tp::DOUBLE / (tp + fp)', 6)} AS precision, {r('tp::DOUBLE / (tp + fn)', 6)} AS recall, {r('2.0::DOUBLE * tp / (2 * tp + fp + fn)', 6)} AS f1,
 {r('tn::DOUBLE / (tn + fp)', 6)} AS specificity, {r('tn::DOUBLE / (tn + fn)', 6)} AS npv, {r('(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2', 6)} AS balanced_accuracy FROM c"""


@query("L1", _CONF)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    df = B.scores(spark, sf).select("base", F.when(F.col("ok") % 11 != 0, F.col("label")).alias("label"),
                                    F.when(F.col("ok") % 17 != 0, F.col("score") * 1.2).alias("score"))
    out = evaluate.confusion(df, "score", "label", 0.45)
    return out.select("tp", "fp", "tn", "fn", *[rnd(c, 6).alias(c) for c in out.columns[4:]])


GRID = f"""WITH {B.SCORES}, counts AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY score), lim AS (SELECT min(score) AS lo, max(score) AS hi, sum(pos) AS p, sum(n) AS total FROM counts),
grid AS (SELECT j, CASE WHEN j = 400 THEN hi ELSE lo + j * ((hi - lo) / 400.0::DOUBLE) END AS t, p, total FROM range(401) g(j), lim),
hits AS (SELECT j, t, CAST(p AS DOUBLE) AS p, CAST(total AS DOUBLE) AS total, CAST(sum(pos) AS DOUBLE) AS tp, CAST(sum(n - pos) AS DOUBLE) AS fp FROM grid JOIN counts ON score >= t GROUP BY ALL),
s0 AS (SELECT *, tp / (tp + fp) AS precision, tp / p AS recall, fp / (total - p) AS fpr, (tp + fp) / total AS pos_rate, p - tp AS fn FROM hits),
s AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0::DOUBLE * precision * recall / (precision + recall + 1e-8) ELSE 0 END AS f1 FROM s0)"""
PICK = f" SELECT {r('t', 6)} AS threshold, {r('s.f1', 6)} AS f1, {r('s.precision', 6)} AS precision, {r('s.recall', 6)} AS recall, {r('s.pos_rate', 6)} AS pos_rate FROM s"

for _name, _args, _tail in [
    ("f1", {}, " ORDER BY s.f1 DESC, j LIMIT 1"),
    ("f1_rate", {"policy": "f1", "target_pos_rate": 0.5}, " WHERE s.f1 >= 0.9::DOUBLE * (SELECT max(f1) FROM s) ORDER BY abs(s.pos_rate - 0.5), j LIMIT 1"),
    ("youden", {}, " ORDER BY s.recall - s.fpr DESC, j LIMIT 1"),
    ("precision_at", {"target_value": 0.335}, " ORDER BY s.precision >= 0.335 DESC, CASE WHEN s.precision >= 0.335 THEN s.recall ELSE s.precision END DESC, j LIMIT 1"),
    ("recall_at", {"target_value": 0.8}, " ORDER BY s.recall >= 0.8 DESC, CASE WHEN s.recall >= 0.8 THEN s.precision ELSE s.recall END DESC, j LIMIT 1"),
    ("cost", {"fp_cost": 1.0, "fn_cost": 1.9}, " ORDER BY fp * 1.0 + fn * 1.9::DOUBLE, j LIMIT 1"),
    ("band", {"policy": "f1", "min_pos_rate": 0.2, "max_pos_rate": 0.3}, " ORDER BY greatest(0.2 - s.pos_rate, 0) + greatest(s.pos_rate - 0.3, 0), j LIMIT 1"),
]:
    def _make(name=_name, args=_args):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            kw = {"policy": name, **args}
            out = evaluate.pick_threshold(B.scores(spark, sf), "score", "label", **kw)
            return out.select(*[rnd(c, 6).alias(c) for c in out.columns])
        return run
    _named(f"threshold_{_name}", "L4", GRID + PICK + _tail)(_make())


@query("L4", f"""WITH {B.SCORES}, q AS (SELECT quantile_cont(score, 1.0::DOUBLE - 0.35::DOUBLE) AS t FROM scores),
h AS (SELECT t, count(*) FILTER (score >= t AND label = 1)::DOUBLE AS tp, count(*) FILTER (score >= t AND label = 0)::DOUBLE AS fp, count(*) FILTER (label = 1)::DOUBLE AS p, count(*)::DOUBLE AS total FROM scores, q GROUP BY t)
SELECT {r('t', 6)} AS threshold, {r('2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-8)', 6)} AS f1, {r('tp / (tp + fp)', 6)} AS precision, {r('tp / p', 6)} AS recall, {r('(tp + fp) / total', 6)} AS pos_rate FROM h""")
def threshold_quantile(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.pick_threshold(B.scores(spark, sf), "score", "label", "quantile", target_pos_rate=0.35)
    return out.select(*[rnd(c, 6).alias(c) for c in out.columns])


@query("L5", f"""WITH {B.SCORES}, counts AS (SELECT score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY score), t AS (SELECT CASE WHEN j = 98 THEN 0.99::DOUBLE ELSE 0.01::DOUBLE + j * ((0.99::DOUBLE - 0.01::DOUBLE) / 98.0::DOUBLE) END AS t FROM range(99) g(j)),
h AS (SELECT t, sum(CASE WHEN score >= t THEN pos ELSE 0 END) AS tp, sum(CASE WHEN score >= t THEN n - pos ELSE 0 END) AS fp, sum(CASE WHEN score < t THEN pos ELSE 0 END) AS fn FROM t, counts GROUP BY t)
SELECT round(t, 2) AS threshold, {r('coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)', 6)} AS f1 FROM h""")
def grid_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.grid_f1(B.scores(spark, sf), "score", "label").withColumn("f1", rnd("f1", 6))


@query("L6", ALL + f", k AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS i FROM curve WHERE tp / total_pos::DOUBLE >= 0.7) SELECT {r('min(score)', 6)} AS threshold FROM k WHERE i <= 2")
def recall_target(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.recall_threshold(B.scores(spark, sf), "score", "label", 0.7).select(rnd("threshold", 6).alias("threshold"))


@query("L7 C12", f"""WITH {B.SCORES}, x AS (SELECT base, score, CASE WHEN base % 3 = 0 THEN label ELSE CASE WHEN ok % 40 = 0 THEN label ELSE 0 END END AS label FROM scores),
c AS (SELECT base, score, count(*) AS n, sum(label) AS pos FROM x GROUP BY ALL), cb AS (SELECT *, sum(pos) OVER (PARTITION BY base ORDER BY score DESC) AS tp, sum(pos) OVER (PARTITION BY base) AS tot FROM c),
g AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(pos) OVER () AS tot FROM (SELECT score, sum(pos) AS pos FROM c GROUP BY score)),
gt AS (SELECT min(score) AS t FROM (SELECT score FROM g WHERE tp / tot::DOUBLE >= 0.7 ORDER BY score DESC LIMIT 2)),
bt AS (SELECT base, min(score) AS t FROM (SELECT base, score, row_number() OVER (PARTITION BY base ORDER BY score DESC) AS i FROM cb WHERE tot >= 5 AND tp / tot::DOUBLE >= 0.7) WHERE i <= 2 GROUP BY base)
SELECT base, {r('coalesce(bt.t, gt.t)', 6)} AS threshold FROM (SELECT DISTINCT base FROM x) LEFT JOIN bt USING (base), gt""")
def per_base_threshold(spark: SparkSession, sf: str) -> DataFrame:
    y = F.when((F.col("base") % 3 == 0) | (F.col("ok") % 40 == 0), F.col("label")).otherwise(0)
    df = B.scores(spark, sf).select("base", "score", y.alias("label"))
    return evaluate.per_base_threshold(df, "score", "label", "base").select("base", rnd("threshold", 6).alias("threshold"))


@query("L8", f"WITH {B.SCORES} SELECT t AS threshold, count(*) FILTER (score >= t) AS above, {r('(count(*) FILTER (score >= t))::DOUBLE / count(*)', 6)} AS share FROM scores, (VALUES (0.1::DOUBLE), (0.3), (0.5), (0.7)) v(t) GROUP BY t")
def positive_rate_table(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.positive_rate_table(B.scores(spark, sf), "score", [0.1, 0.3, 0.5, 0.7]).withColumn("share", rnd("share", 6))


@query("L9", f"WITH {B.SCORES} SELECT {r('min(score)', 6)} AS min, {r('avg(score)', 6)} AS mean, {r('median(score)', 6)} AS median, {r('max(score)', 6)} AS max, {r('avg(CASE WHEN score >= 0.5 THEN 1.0 ELSE 0.0 END)', 6)} AS positive_share FROM scores")
def score_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = evaluate.score_summary(B.scores(spark, sf), "score")
    return out.select(*[rnd(c, 6).alias(c) for c in out.columns])
