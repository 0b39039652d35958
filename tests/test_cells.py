"""Quantiles of a whole table, and cells between their cuts, cost one pass and a bisection per value."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import drift, models
from sensorloom.operators.quantiles import bisected, exact_quantiles


def plan(df):
    return df._jdf.queryExecution().toString()


def numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), float(k), None if k == 3 else float(k % 4)) for x, k in zip(rng.normal(size=3000), rng.integers(0, 50, 3000))]
    return rows + [(math.nan, 1.0, None), (None, None, -0.0)]


def test_overall_quantiles_need_no_join(spark):
    rows = numbers(spark)
    df = spark.createDataFrame(rows, "x double, k double, s double").repartition(5)
    probs = {f"_{i}": p for i, p in enumerate([1.0, 0.0, 0.5, *[j / 20 for j in range(21)]])}
    out = exact_quantiles(df, [], {c: F.col(c) for c in "xks"}, probs)
    assert "__salt" not in plan(out)  # every row met its brackets by a join before
    got = out.first()
    for i, c in enumerate("xks"):
        real = [r[i] for r in rows if r[i] is not None and not math.isnan(r[i])]
        assert [got[c + s] for s in probs] == pytest.approx(list(np.quantile(real, list(probs.values()))), abs=1e-12)
    empty = exact_quantiles(df.filter("x < -99"), [], {"x": F.col("x"), "k": F.col("k")}, probs).collect()
    assert len(empty) == 1 and empty[0]["x_0"] is None


def test_bisected(spark):
    xs = [None, math.nan, math.inf, -math.inf, -1.0, 0.0, 0.5, 1.0, 2.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    cuts = [1.0, 0.0, 1.0]
    got = df.select("x", bisected(F.col("x"), cuts).alias("upto"), bisected(F.col("x"), cuts, strict=True).alias("below")).collect()
    assert [r.upto for r in got] == [0, 3, 3, 0, 0, 1, 1, 3, 3] and [r.below for r in got] == [0, 3, 3, 0, 0, 0, 1, 1, 3]
    assert bisected(F.col("x"), []) is not None and {r[0] for r in df.select(bisected(F.col("x"), [])).collect()} == {0}


def test_psi_and_information_compare_by_bisection(spark):
    rows = numbers(spark)
    df = spark.createDataFrame([(*r, i % 2 if i % 7 else None) for i, r in enumerate(rows)], "x double, k double, s double, y int")
    out = drift.psi(df, df.filter("k < 30"), ["x", "k", "s"])
    assert plan(out).count(">=") < 40 and {r.feature for r in out.collect()} == {"x", "k", "s"}
    k = np.array([r[1] for r in rows if r[1] is not None])
    cuts = np.unique(np.quantile(k, [i / 20 for i in range(21)]))
    e, a = (np.histogram(v, cuts)[0] for v in (k, k[k < 30]))
    er, ar = (np.maximum(n / n.sum(), drift.FLOOR) for n in (e, a))
    assert {r.feature: r.psi for r in out.collect()}["k"] == pytest.approx(((ar - er) * np.log(ar / er)).sum())
    mi = models.mutual_information(df, ["x", "k"], "y")
    assert plan(mi).count(" > ") < 18 and all(r.mi >= 0 for r in mi.collect())
