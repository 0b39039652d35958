"""Quantiles per group: small groups are sorted, large ones bracketed, with the same results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.operators import quantiles, sequences


def rows(spark):
    rng = np.random.default_rng(5)
    out = [(None if k == 3 else k, float(v)) for k in range(6) for v in rng.integers(0, 12, 400 if k == 0 else 9)]
    out += [(7, None), (8, float("nan")), (9, None), (9, 2.0)]
    return out, spark.createDataFrame(out, "k int, v double")


@pytest.mark.parametrize("small", [0, 50, 1 << 16])
def test_either_path(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "SMALL", small)
    plain, df = rows(spark)
    probs = {"_5": 0.05, "_50": 0.5, "_95": 0.95, "_100": 1.0}
    got = {r["k"]: r for r in quantiles.exact_quantiles(df, ["k"], {"v": F.col("v"), "w": -F.col("v")}, probs, {"v_50": "above"}).collect()}
    assert set(got) == {0, 1, 2, None, 4, 5, 9}
    for k, r in got.items():
        values = np.array([v for a, v in plain if a == k and v is not None])
        for name, p in probs.items():
            assert r["v" + name] == pytest.approx(np.quantile(values, p)) and r["w" + name] == pytest.approx(np.quantile(-values, p))
        assert r["above"] == (values > r["v_50"]).sum()


def test_small_groups_need_no_sketch(spark):
    _, df = rows(spark)
    plan = quantiles.exact_quantiles(df, ["k"], {"v": F.col("v")}, {"": 0.95})._jdf.queryExecution().toString()
    assert "percentile_approx" not in plan and "__salt" not in plan


def test_padded_sequences_are_not_grouped_again(spark):
    df = spark.createDataFrame([(k, d, float(10 * k + d)) for k in (1, 2) for d in range(k + 1)], "key int, d int, v double")
    padded = sequences.last_n_padded(df, ["key"], "d", None, ["d"], ["v"], 4)
    flat = sequences.flatten(padded, ["key"], ["v"], 4)
    assert "max(" not in flat._jdf.queryExecution().toString()
    assert sorted(flat.collect()) == sorted(sequences.flatten(sequences.to_long(padded, ["key"]), ["key"], ["v"], 4).collect())
