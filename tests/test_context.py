"""Edges of the assembly: inclusive ends, fallbacks, window ends, intervals, dates."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sensorloom.functions import expressions as X
from sensorloom.operators import clean, context
from sensorloom.roles import Roles

R = Roles(channels=("v",))


def day(n):
    return dt.date(2020, 3, 1) + dt.timedelta(days=n)


def contexts(spark, rows):
    df = spark.createDataFrame(rows, "key string, base string, mapped int, pos double, r_date date")
    return clean.context_window(df, "r_date", "pos", 30, 0.02)


def test_band_ends_are_inclusive(spark):
    c = contexts(spark, [("c", "A", 1, 10.0, day(0))])
    dates = [-31, -30, 0, 1]
    kms = [9.9999, 10.0, 10.02, 10.0201]
    r = spark.createDataFrame([("A", 1, k, day(d), 1.0) for d in dates for k in kms], "base string, mapped int, pos double, d date, v double")
    want = {(day(d), k) for d in (-30, 0) for k in (10.0, 10.02)}
    for join in (lambda: context.band_join(c, r, R, 0.02), lambda: context.band_join_plain(c, r, R)):
        assert {(x.r_d, x.r_pos) for x in join().collect()} == want


def test_unmapped_base_falls_back(spark):
    c = contexts(spark, [("c", "X", None, 1.0, day(0)), ("n", None, None, 1.0, day(0))])
    r = spark.createDataFrame([("X", None, 1.0, day(-1), 1.0), (None, None, 1.0, day(-1), 2.0)], "base string, mapped int, pos double, d date, v double")
    c = c.withColumn("mapped", F.col("mapped").cast("string"))
    r = r.withColumn("mapped", F.col("mapped").cast("string"))
    assert [x.key for x in context.band_join(c, r, R, 0.02).collect()] == ["c"]


def test_break_day_window(spark):
    rows = [(0, 5), (1, 5), (30, 5), (31, 5), (10, None), (10, -3)]
    df = spark.createDataFrame([(i, day(0), None if b is None else day(b), rul) for i, (rul, b) in enumerate(rows)], "i int, r date, b date, rul int")
    got = [r.e for r in df.select("i", X.window_end("r", "b", "rul").alias("e")).orderBy("i").collect()]
    assert got == [day(0), day(5), day(5), day(0), day(0), day(0)]


def test_interval_states(spark):
    c = spark.createDataFrame([("k", "A", day(0)), ("z", "B", day(0))], "key string, base string, r_date date")
    iv = spark.createDataFrame([("A", day(-20), day(-10), 7.0), ("A", day(-5), day(5), 10.0), ("A", day(3), day(9), 100.0), ("A", day(0), day(0), 50.0)],
                               "base string, f date, t date, amount double")
    got = {r.key: (r.total_load, r.load_to_date) for r in context.prorated_load(c, iv, "key", ["base"], "r_date", "f", "t", "amount").collect()}
    assert got["z"] == (None, None)
    assert got["k"][0] == 167.0 and abs(got["k"][1] - 12.0) < 1e-9


def test_overlapping_intervals_do_not_fan_out(spark):
    rows = spark.createDataFrame([(1, "A", day(0)), (2, "A", day(20)), (3, "B", day(0)), (4, "A", day(5))], "i int, base string, d date")
    iv = spark.createDataFrame([("A", day(-5), day(5), 10.0), ("A", day(0), day(0), 30.0), ("A", day(6), dt.date(9999, 12, 30), 4.0), ("A", day(9), day(1), 99.0)],
                               "base string, f date, t date, amount double")
    got = {r.i: r.amount for r in context.validity_join(rows, iv, ["base"], "d", "f", "t", "amount").collect()}
    assert got == {1: 20.0, 2: 4.0, 3: None, 4: 10.0}


def test_long_intervals_cost_months(spark):
    rng = random.Random(3)
    rows = [("AB"[i % 2], day(rng.randrange(-400, 400))) for i in range(300)] + [("C", day(0)), (None, day(0)), ("A", None)]
    spans = []
    for i in range(60):
        first = rng.randrange(-7000, 400)
        spans.append(("AB"[i % 2], day(first), day(first + rng.choice([0, 3, 40, 800, 7300])), float(rng.randrange(1, 50))))
    spans += [("A", day(-30), day(-10), float("nan")), ("B", None, day(4), 5.0), ("B", day(3), day(-3), 5.0), ("B", day(-3), day(3), None)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, r struct<base: string, d: date>").select("i", "r.*")
    iv = spark.createDataFrame(spans, "base string, f date, t date, amount double")
    got = {r.i: r.amount for r in context.validity_join(df, iv, ["base"], "d", "f", "t", "amount").collect()}
    assert len(got) == len(rows)
    for i, (base, d) in enumerate(rows):
        held = [a for b, f, t, a in spans if b == base and None not in (d, f, t, a) and f <= d <= t]
        if any(a != a for a in held):
            assert got[i] != got[i]
        else:
            assert got[i] == (pytest.approx(sum(held) / len(held)) if held else None), (base, d)


@pytest.mark.parametrize("most", [5, 1000])
def test_dated_contexts_split_crowded_cells(spark, most):
    rng = random.Random(1)
    rows = [(i, "A" if i % 3 else "B", 1 if i % 4 else 2, day(rng.randrange(-50, 50))) for i in range(200)] + [(200, None, 1, day(0)), (201, "A", 1, None)]
    ctx = [(f"k{i}", "A" if i % 2 else "B", 1 + i % 2, day(f := rng.randrange(-60, 60)), day(f + rng.randrange(0, 40)), i % 2) for i in range(40)]
    ctx += [("null", "A", 1, None, day(5), 1), ("back", "A", 1, day(9), day(-9), 1), ("edge", "A", 1, day(0), day(0), None)]
    r = spark.createDataFrame(rows, "i int, base string, pos int, d date")
    c = spark.createDataFrame(ctx, "key string, base string, pos int, f date, t date, label int")
    got = sorted((x.i, x.key or "", x.label) for x in context.dated_context_join(r, c, ["base", "pos"], "label", "d", "f", "t", 7, most).collect())
    want = []
    for i, base, pos, d in rows:
        hits = [(i, k, y or 0) for k, b, p, f, t, y in ctx if b == base and p == pos and d is not None and f is not None and f <= d <= t]
        want += hits or [(i, "", 0)]
    assert got == sorted(want)
    empty = context.dated_context_join(r, c.limit(0), ["base", "pos"], "label", "d", "f", "t")
    assert empty.count() == len(rows) and empty.columns == ["i", "base", "pos", "d", "key", "f", "t", "label"]


def test_date_strings(spark):
    text = ["2020-03-04", "2020-3-4", "2020/03/04", "2020/3/4", "03/04/2020", "25/12/2020", "garbage", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "i int, t string")
    got = [r.d for r in df.select("i", X.parse_date_any("t").alias("d")).orderBy("i").collect()]
    assert got == [dt.date(2020, 3, 4)] * 5 + [dt.date(2020, 12, 25), None, None]
    epoch = df.filter("i = 5").select(X.parse_epoch_any("t").alias("e")).first().e
    assert epoch == int(dt.datetime(2020, 12, 25, tzinfo=dt.timezone.utc).timestamp())


def test_trailing_stats_keep_empty_contexts(spark):
    c = spark.createDataFrame([("k", "A", day(0)), ("z", "B", day(0))], "key string, base string, r_date date")
    r = spark.createDataFrame([("A", day(d), v, -v) for d, v in ((-31, 9.0), (-30, 1.0), (-30, 3.0), (0, 5.0), (1, 9.0))], "base string, d date, s double, t double")
    got = {x.key: x for x in context.trailing_stats(c, r, "key", ["base"], "r_date", "d", "s", "t").collect()}
    assert (got["k"].avg_speed, got["k"].min_speed, got["k"].max_speed, got["k"].max_twist, got["k"].window_count) == (3.0, 1.0, 5.0, -1.0, 2)
    assert got["z"].avg_speed is None and got["z"].window_count == 0


def test_expressions(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-4.0, 2.0), (None, 2.0), (3.0, None)], "x double, lim double")
    got = df.select(X.risk_ratio("x", "lim", True).alias("a"), X.risk_ratio("x", "lim").alias("b"), X.clip("x", 0.0, 2.0).alias("c")).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 1.0), (2.0, -2.0, 0.0), (0.0, 0.0, None), (0.0, 0.0, 2.0)]
    g = clean.feature_groups(["a1", "a2", "b"], {"acc": ["a1", "a2"], "none": ["q"]})
    assert g == {"acc": ["a1", "a2"], "b": ["b"]}
