"""Metrics, thresholds, drift, statistics and models on small frames with known answers."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.functions.probability import f_upper, t_two_sided
from sensorloom.operators import drift, evaluate, models, quality
from sensorloom.operators.ordered import Series


def scored(spark, pairs):
    return spark.createDataFrame([(float(s), y) for s, y in pairs], "score double, y int")


def test_ranking_with_ties(spark):
    m = evaluate.ranking_metrics(scored(spark, [(0.9, 1), (0.5, 1), (0.5, 0), (0.1, 0)]), "score", "y").first()
    assert m.roc_auc == pytest.approx(0.875) and m.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)
    m = evaluate.ranking_metrics(scored(spark, [(0.5, 1), (0.5, 0), (0.5, 0)]), "score", "y").first()
    assert (m.roc_auc, m.average_precision) == (0.5, pytest.approx(1 / 3))
    m = evaluate.ranking_metrics(scored(spark, [(0.5, 1), (0.7, 1)]), "score", "y").first()
    assert (m.roc_auc, m.average_precision) == (0.5, 1.0)


def test_thresholds(spark):
    df = scored(spark, [(0.1, 0), (0.4, 1), (0.6, 0), (0.8, 1), (0.9, 1)])
    assert evaluate.best_f1_on_curve(df, "score", "y").first().threshold == 0.4
    # Recall of 0.6 is reached down from 0.8; one observed score lower is 0.6.
    assert evaluate.recall_threshold(df, "score", "y", 0.6).first().threshold == 0.6
    flat = evaluate.pick_threshold(scored(spark, [(0.3, 1), (0.3, 0)]), "score", "y").first()
    assert tuple(flat) == (0.3, 0.0, 0.0, 0.0, 1.0)
    band = evaluate.pick_threshold(df, "score", "y", "youden", min_pos_rate=0.5).first()
    assert band.pos_rate >= 0.5
    with pytest.raises(ValueError):
        evaluate.pick_threshold(df, "score", "y", "quantile")


def test_confusion_of_nothing(spark):
    c = evaluate.confusion(scored(spark, [(0.1, 0), (0.2, 0)]), "score", "y", 0.5).first()
    assert (c.tn, c.precision, c.recall, c.f1, c.accuracy) == (2, 0.0, 0.0, 0.0, 1.0)


def test_noisy_or(spark):
    df = spark.createDataFrame([("a", 0.5), ("a", 0.5), ("b", 1.0), ("b", 0.2), ("c", 0.0), ("d", None), ("d", 0.3)], "k string, p double")
    got = {r.k: r.probability for r in evaluate.group_probability(df, ["k"], "p").collect()}
    assert got == {"a": pytest.approx(0.75), "b": 1.0, "c": 0.0, "d": pytest.approx(0.3)}


def test_p_values():
    assert t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert t_two_sided(1.96, 1e6) == pytest.approx(0.0499958, abs=1e-5)
    assert f_upper(4.0, 1, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert f_upper(3.0, 2, 20) == pytest.approx(0.0725, abs=1e-3)
    assert math.isnan(t_two_sided(float("nan"), 3)) and t_two_sided(float("inf"), 3) == 0.0


def test_null_runs(spark):
    values = [None, None, 1.0, None, 2.0, 3.0, None, None, None]
    df = spark.createDataFrame([(i // 3, i, v, None) for i, v in enumerate(values)], "d int, i int, x double, z double")
    got = {r.column: r for r in quality.missing_runs(df, ["x", "z"], Series([], ["d", "i"])).collect()}
    assert (got["x"].max_run, got["x"].runs, got["x"].avg_run) == (3, 3, 2.0)
    assert (got["z"].max_run, got["z"].runs) == (9, 1)


def test_em_prior(spark):
    rng = random.Random(3)
    probs = [round(rng.random() * 0.5, 2) for _ in range(400)]
    got, pi = drift.em_prior_shift(scored(spark, [(p, 0) for p in probs]), "score", 0.4)
    q = 0.4
    for _ in range(50):
        new = sum(p * q / (p * q + (1 - p) * (1 - q) + 1e-9) for p in probs) / len(probs)
        if abs(new - q) < 1e-6:
            break
        q = new
    assert pi == pytest.approx(q, abs=1e-9)
    assert got.agg(F.min("adjusted")).first()[0] >= 1e-6


def test_coral_moves_the_moments(spark):
    rng = np.random.default_rng(0)
    src = spark.createDataFrame((rng.normal(size=(500, 2)) @ [[1, 0.5], [0, 1]]).tolist(), "a double, b double")
    dst = spark.createDataFrame((rng.normal(size=(500, 2)) * 3 + 7).tolist(), "a double, b double")
    mean, cov = drift._moments(drift.coral(src, dst, ["a", "b"]), ["a", "b"])
    want_mean, want_cov = drift._moments(dst, ["a", "b"])
    assert mean == pytest.approx(want_mean) and cov.flatten() == pytest.approx(want_cov.flatten(), abs=0.05)


def test_nearest_distance_is_exact(spark):
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(120, 4)) * [1, 5, 0.1, 2], rng.normal(size=(80, 4)) * [1, 5, 0.1, 2]
    a[0], a[1] = b[3], [500.0, -900.0, 3.0, 1.0]
    left = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(a)], "id int, w double, x double, y double, z double")
    right = spark.createDataFrame([tuple(map(float, r)) for r in b] * 2, "w double, x double, y double, z double")
    got = {r.id: r.distance for r in drift.nearest_distance(left, right, ["id"], ["w", "x", "y", "z"]).collect()}
    want = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)).min(1)
    assert [got[i] for i in range(120)] == pytest.approx(want.tolist(), abs=1e-9)


def test_isotonic_interpolates(spark):
    cal = spark.createDataFrame([("a", s, y) for s, y in zip((0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7), (0, 1, 0, 1, 1, 1, 1))] + [("b", 0.5, 1)], "b string, s double, y int")
    pools = models.isotonic_pools(cal, "b", "s", "y", 5)
    assert {r.b for r in pools.collect()} == {"a"}
    ask = spark.createDataFrame([("a", 0.0), ("a", 0.15), ("a", 0.25), ("a", 0.35), ("a", 2.0), ("b", 0.4)], "b string, s double")
    got = {(r.b, r.s): r.calibrated for r in models.apply_pools(ask, pools, "b", "s").collect()}
    assert got[("a", 0.0)] == 0.0 and got[("a", 2.0)] == 1.0 and got[("b", 0.4)] == 0.4
    assert got[("a", 0.15)] == pytest.approx(0.25) and got[("a", 0.25)] == 0.5 and got[("a", 0.35)] == pytest.approx(0.75)


def test_models_beat_chance(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    rows = [(i, float(p), float(q), int(p + q > 0), i % 7) for i, (p, q) in enumerate(x)]
    df = spark.createDataFrame(rows, "id int, p double, q double, y int, g int")
    train, test = df.filter("id % 3 <> 0"), df.filter("id % 3 = 0")
    svm = models.margin_score(models.linear_svm(train, ["p", "q"], "y", rounds=10), test)
    lr = models.probability_score(models.logistic_baseline(train, ["p", "q"], "y"), test)
    gbt = models.probability_score(models.boosted_trees(train, test, ["p", "q"], "y", rounds=3), test)
    for out in (svm, lr, gbt):
        assert evaluate.ranking_metrics(out, "score", "y").first().roc_auc > 0.85


def test_drift_prune(spark):
    a = spark.createDataFrame([(float(i), float(i)) for i in range(100)], "same double, moved double")
    b = spark.createDataFrame([(float(i), float(i) + 90) for i in range(100)], "same double, moved double")
    table = drift.drift_table(a, b, ["same", "moved"])
    assert drift.drift_prune(a, table, ["same", "moved"]).columns == ["same"]


def test_information_keeps_the_best():
    class Frame:
        def collect(self):
            return [{"feature": "a_last", "mi": 0.1}, {"feature": "a_mean", "mi": 0.3}, {"feature": "b_last", "mi": 0.0}, {"feature": "b_mean", "mi": 0.0}]
    assert models.keep_by_information(Frame(), ["b", "a"], share=0.5) == ["a"]
