"""Blocks cut from the data, and quantiles from bracketed ranks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import features, quality, splits
from sensorloom.operators.evaluate import ranking_metrics
from sensorloom.operators.features import Limit
from sensorloom.operators.ordered import BLOCK, EVEN, Series, even_blocks, positions
from sensorloom.operators.quantiles import exact_quantiles


def sizes(df, order, blocks):
    return [r["count"] for r in even_blocks(df, order, blocks=blocks).groupBy(BLOCK).count().collect()]


@pytest.mark.parametrize("value", [
    "0.9999 + rand(3) * 0.0001D",  # scores near 1
    "1.7e9 + id / 10",             # epoch seconds
    "exp(randn(4) * 30)", "-cast(id as double)"])
def test_blocks_hold_at_most_twice_the_mean(spark, value):
    df = spark.range(40_000).select("id", F.expr(value).alias("x"))
    got = sizes(df, ["x"], 64)
    assert len(got) == 64 and max(got) <= 2 * 40_000 / 64


def test_one_day_is_cut_too(spark):
    df = spark.range(20_000).selectExpr("1 day", "pmod(id * 7919, 20000) id")
    assert max(sizes(df, ["day", "id"], 32)) <= 2 * 20_000 / 32
    got = positions(df, Series([], ["day", "id"], EVEN)).where("rn <> id + 1").count()
    assert got == 0


def test_blocks_rise_with_nulls_nan_and_ties(spark):
    rows = [(None,), (float("nan"),), (float("-inf"),), (float("inf"),), (-0.5,), (2.0,), (2.0,), (2.0,)] * 5
    df = even_blocks(spark.createDataFrame(rows, "x double"), ["x"])
    got = [r[BLOCK] for r in df.orderBy("x").collect()]
    assert got == sorted(got)
    assert df.groupBy("x").agg(F.countDistinct(BLOCK).alias("n")).where("n > 1").count() == 0
    assert even_blocks(df.limit(0).select("x"), ["x"]).count() == 0


def test_cuts_and_folds_of_one_day(spark):
    df = spark.range(900).selectExpr("DATE '2024-05-05' d", "id")
    got = {r.id: r.part for r in splits.split_rows(df, ["d", "id"], 0.8).collect()}
    assert all(got[i] == ("train" if i < 720 else "test") for i in range(900))
    folds = {r.id: r.fold for r in splits.expanding_folds_rows(df, ["d", "id"], 5).collect()}
    assert all(folds[i] == i // 150 - 1 for i in range(900))
    gaps = spark.range(600).selectExpr("TIMESTAMP '2024-05-05' + make_interval(0, 0, 0, 0, 0, 0, id) ts", "id", "IF(id % 100 < 30, NULL, 1.0) v")
    run = quality.missing_runs(gaps, ["v"], Series([], ["ts", "id"], EVEN)).first()
    assert (run.max_run, run.runs, run.avg_run) == (30, 6, 30.0)
    gap = quality.missing_gaps(gaps, ["v"], "ts", ["id"]).first()
    assert (gap.min_gap, gap.max_gap, gap.n) == (1.0, 71.0, 180)


def test_ranking_of_crowded_scores(spark):
    rng = random.Random(1)
    rows = [(0.9999 + rng.random() * 1e-4, int(rng.random() < 0.3)) for _ in range(800)]
    got = ranking_metrics(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    assert got.roc_auc == pytest.approx(auc)


def plain(values, p):
    v = sorted(values)
    h = p * (len(v) - 1)
    lo = int(h)
    return v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (h - lo)


def test_quantiles_at_each_bracket_width(spark):
    rng = random.Random(4)
    odd = lambda: rng.choice([round(rng.gauss(0, 1), 1), rng.random(), 1e9, float("nan"), None])
    rows = [(n, k, odd() if k else rng.gauss(5, 2)) for n in (1, 2, 31, 32, 33, 124, 125, 126, 499, 500, 501, 1999, 2000, 2001, 7000) for k in (0, 1, None) for _ in range(n)]
    probs = [0.0, 0.005, 0.25, 0.5, 0.95, 1.0]
    df = spark.createDataFrame(rows, "n int, k int, v double").repartition(4)
    got = {(r.n, r.k): r for r in exact_quantiles(df, ["n", "k"], {"v": F.col("v")}, {f"_{i}": p for i, p in enumerate(probs)}, {
        f"v_{i}": f"above_{i}" for i in range(len(probs))}).collect()}
    groups = {}
    for n, k, v in rows:
        if v is not None and v == v:
            groups.setdefault((n, k), []).append(v)
    assert set(got) == set(groups)
    for key, values in groups.items():
        for i, p in enumerate(probs):
            assert got[key][f"v_{i}"] == pytest.approx(plain(values, p), rel=1e-12, abs=1e-12)
            assert got[key][f"above_{i}"] == sum(v > got[key][f"v_{i}"] for v in values)


def test_rows_times_channels_stay_in_their_tasks(spark):
    """Of 29 channels, a small share of the values is exploded, and no exchange takes more rows than there are groups or such values."""
    wide = spark.range(30_000).select((F.col("id") % 3).alias("k"), *[F.rand(i).alias(f"c{i}") for i in range(29)]).cache()
    out = exact_quantiles(wide, ["k"], {f"c{i}": F.col(f"c{i}") for i in range(29)}, {"": 0.95})
    out.collect()
    plan = out._jdf.queryExecution().executedPlan()

    def generated(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return generated(node.executedPlan())
        if "QueryStage" in name:
            return generated(node.plan())
        own = node.metrics().get("numOutputRows").get().value() if name == "Generate" and "struct" in str(node).lower() and "__x" in str(node) else 0
        children = node.children()
        return max([own, *(generated(children.apply(i)) for i in range(children.size()))])

    assert 0 < generated(plan) < 30_000 * 29 * 0.02
    assert len(re.findall("Cartesian|NestedLoop", plan.toString())) == 0


def test_spikes_come_with_the_limits(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "a", None]), rng.gauss(0, 3), rng.choice([0.0, 1.0, 2.0]), None) for _ in range(500)] + [("empty", None, None, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double, z double")
    limits = [Limit("x", "p95", True), Limit("y", "sigma"), Limit("z")]
    got = {r.k: r for r in features.limits_and_spikes(df, ["k"], limits, limits).collect()}
    assert set(got) == {"a", None, "empty"}
    for k in ("a", None):
        x, y = [abs(r[1]) for r in rows if r[0] == k], [r[2] for r in rows if r[0] == k]
        assert got[k].limit_x == pytest.approx(plain(x, 0.95))
        assert got[k].spikes_x == sum(v > got[k].limit_x for v in x) and got[k].spikes_y == sum(v > got[k].limit_y for v in y)
        assert got[k].limit_z is None and got[k].spikes_z == 0
    assert got["empty"].spikes_x == 0 and got["empty"].limit_y == 0.0
