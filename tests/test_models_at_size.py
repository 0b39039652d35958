"""Model queries: no stage is too much code to compile, and only what a model needs is written."""

import math

import numpy as np

from sensorloom.operators import models, sequences, svm
from sensorloom.plans import q_models as Q

def plan(df):
    return df._jdf.queryExecution().toString()

def test_steps_are_listed_without_an_aggregate(spark):
    rows = [(k, d, None if d == 1 else float(10 * (k or 0) + d)) for k in (1, 2, None) for d in range(6 if k else 2)] + [(2, 3, 23.0)]
    padded = sequences.last_n_padded(spark.createDataFrame(rows, "key int, d int, v double"), ["key"], "d", None, ["d"], ["v"], 4)
    assert "ObjectHashAggregate" not in plan(padded)
    got = {r["key"]: (r["n_real"], [(s["pos"], s["is_pad"], s["v"]) for s in r["steps"]]) for r in padded.collect()}
    assert got[1] == (4, [(i + 1, False, 12.0 + i) for i in range(4)])
    assert got[2] == (4, [(1, False, 23.0), (2, False, 23.0), (3, False, 24.0), (4, False, 25.0)])
    assert got[None] == (2, [(1, True, 0.0), (2, True, 0.0), (3, False, 0.0), (4, False, None)])


def test_model_rows_keep_sequences_nested(spark, sf):
    df, _, _ = Q.model_rows(spark, sf)
    assert "steps" in plan(df) and "t30_qty" in df.columns  # columns are laid out by the reader

def test_logistic_fit_writes_what_it_uses(spark, monkeypatch):
    seen = []
    cut = models.cut_lineage
    monkeypatch.setattr(models, "cut_lineage", lambda df: seen.append(df.columns) or cut(df))
    rows = [(float(i % 7), float(i % 3), i % 2, "x") for i in range(40)]
    models.logistic_baseline(spark.createDataFrame(rows, "p double, other double, y int, word string"), ["p"], "y")
    assert seen == [["p", "y", "weight"]]

def test_margins_of_folds(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2)).round(3)
    x[5, 0], x[7, 1] = math.nan, math.nan
    rows = [(i, float(a) if i != 9 else None, float(b), int(a + b > 0), None if i == 11 else i % 3) for i, (a, b) in enumerate(x)]
    df = spark.createDataFrame(rows, "i int, p double, q double, y int, fold int")
    fits = svm.fit(df, ["p", "q"], "y", [(c, k) for c in (0.5, 2.0) for k in range(3)], "fold")
    assert all(m.converged for m in fits)
    got = {(r["i"], r["c"]): r["margin"] for r in svm.fold_margins(df, fits, "fold", ["i"]).collect()}
    want = {}
    for m in fits:
        for r in df.filter(f"fold = {m.fold}").select("i", m.margin().alias("m")).collect():
            want[r["i"], m.c] = r["m"]
    assert got == want and len(got) == 2 * 59

def test_no_wide_aggregate(spark):
    df = spark.createDataFrame([(float(i), float(-i), math.nan if i == 2 else 1.0, i % 2) for i in range(12)], "a double, b double, c double, y int")
    model = models.linear_svm(df, ["a", "b", "c"], "y")
    out = svm.optimality(model, df, "y")
    assert out.count() == 4 and max(r["gradient"] for r in out.collect()) < 1e-9
    assert plan(out).count("sum(") < 40  # the sums are one column, whatever the number of features
