"""Sequence lengths, padding, calendars, summaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import sequences as S
from sensorloom.operators.ordered import Series

L = 4


def day(n):
    return dt.date(2021, 5, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(f"k{n}", day(i), day(50), float(i + 1)) for n in (1, L - 1, L, L + 1) for i in range(n)]
    data.append(("late", day(60), day(50), 9.0))
    return spark.createDataFrame(data, "k string, d date, r date, x double")


def test_padding(rows):
    long = S.to_long(S.last_n_padded(rows, ["k"], "d", "r", ["d"], ["x"], L), ["k"])
    got = {k: [(r.is_pad, r.x) for r in long.filter(F.col("k") == k).orderBy("pos").collect()] for k in ("k1", "k3", "k4", "k5")}
    assert got["k1"] == [(True, 0.0)] * 3 + [(False, 1.0)]
    assert got["k3"] == [(True, 0.0), (False, 1.0), (False, 2.0), (False, 3.0)]
    assert got["k4"] == [(False, v) for v in (1.0, 2.0, 3.0, 4.0)]
    assert got["k5"] == [(False, v) for v in (2.0, 3.0, 4.0, 5.0)]
    assert long.filter("k = 'late'").count() == 0


def test_tail_padding(rows):
    long = S.to_long(S.last_n_padded(rows, ["k"], "d", None, ["d"], ["x"], L, pad="edge", side="right"), ["k"])
    assert [(r.is_pad, r.x) for r in long.filter("k = 'k3'").orderBy("pos").collect()] == [(False, 1.0), (False, 2.0), (False, 3.0), (True, 3.0)]


def test_impute_and_summary(rows):
    long = S.to_long(S.last_n_padded(rows, ["k"], "d", "r", ["d"], ["x"], L), ["k"])
    filled = S.impute_pad(long, S.pad_medians(long, ["x"]), ["x"])
    assert {r.x for r in filled.filter("is_pad").collect()} == {2.5}
    s = {r.k: r for r in S.sequence_summary(long, ["k"], ["x"], L, 2).collect()}
    assert (s["k1"].x_last1of2, s["k1"].x_last2of2, s["k1"].x_trend, s["k1"].x_std, s["k1"].real_count) == (1.0, 0.0, 0.0, 0.0, 1)
    assert (s["k5"].x_last1of2, s["k5"].x_last2of2, s["k5"].x_trend, s["k5"].x_mean) == (4.0, 5.0, pytest.approx(1.0), 3.5)
    assert s["k3"].real_fraction == 0.75


def test_calendar(spark):
    df = spark.createDataFrame([("a", day(0), 1, 1.0), ("a", day(0), 2, 2.0), ("a", day(2), 1, 6.0), ("a", day(8), 1, 10.0), ("b", day(3), 1, 5.0)],
                               "s string, d date, i int, x double")
    med = S.calendar_fill(df, ["s"], "d", ["x"], ["i"], "median")
    assert [r.x for r in med.filter("s = 'a'").orderBy("d").collect()] == [2.0, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0, 10.0]
    ff = S.calendar_fill(df, ["s"], "d", ["x"], ["i"], "ffill")
    assert [r.x for r in ff.filter("s = 'a'").orderBy("d").collect()] == [2.0, 2.0, 6.0, 6.0, 6.0, 6.0, 6.0, 6.0, 10.0]
    w = S.calendar_windows(ff, ["s"], "d", ["x"], 3).orderBy("d").collect()
    # The first full window counts, the one-day section has none.
    assert [(r.d, [s.x for s in r.steps]) for r in w] == [(day(2), [2.0, 2.0, 6.0]), (day(8), [6.0, 6.0, 10.0])]
    a = S.anchored_windows(ff, ["s"], "d", ["x"], 3, 2).filter("s = 'a'").orderBy("d").collect()
    assert [(r.d, [s.x for s in r.steps]) for r in a] == [(day(0), [2.0, 2.0, 2.0]), (day(8), [6.0, 6.0, 10.0])]


def test_sliding_future(spark):
    df = spark.createDataFrame([("a", i, float(i), int(i == 6)) for i in range(10)], "s string, i int, x double, y int")
    got = S.sliding_future(df, Series(["s"], ["i"]), ["x"], "y", 3, 2).orderBy("i").collect()
    assert [(r.i, [s.x for s in r.steps], r.future_label) for r in got] == [(i, [i - 3.0, i - 2.0, i - 1.0], int(i in (5, 6))) for i in range(3, 8)]


def test_exact_last_n(rows):
    got = S.last_n(rows, ["k"], ["d"], L, exact=True)
    assert {r.k for r in got.collect()} == {"k4", "k5"}
