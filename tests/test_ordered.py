"""Block windows against plain windows, with one key that holds most rows, at several partitionings."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorloom.operators.features import lag_cascade, trailing_means
from sensorloom.operators.ordered import (Series, bounded_window, carry_forward, hash_series, mark_lowest, mark_lowest_per_key, positions, running)
from sensorloom.operators.quantiles import exact_quantiles

rng = random.Random(7)
# Key "a" holds two thirds of the rows; days repeat, days are missing, values are null.
ROWS = [("a" if rng.random() < 0.66 else rng.choice("bcd"), rng.choice([1, 2, 3, 7, 8, 20, 21, 40]), i, rng.choice([None, 0.0, -1.5, 2.0, 2.0, 1e6]) if rng.random() < 0.5 else rng.uniform(-5, 5))
        for i in range(600)]
S = Series(["k"], ["d", "i"])


@pytest.fixture(scope="module", params=[1, 4, 64])
def df(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", str(request.param))
    yield spark.createDataFrame(ROWS, "k string, d int, i int, v double").repartition(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def rows(df, *cols):
    return sorted(df.select(*cols).collect(), key=str)


def test_running_and_positions(df):
    w = Window.partitionBy("k").orderBy("d", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(positions(df, S), "i", "rn") == rows(df.withColumn("rn", F.count(F.lit(1)).over(w)), "i", "rn")
    got = running(df, S, {"t": F.when(F.col("v").isNull(), 1).otherwise(0)})
    assert rows(got, "i", "t") == rows(df.withColumn("t", F.sum(F.col("v").isNull().cast("int")).over(w)), "i", "t")


@pytest.mark.parametrize("back,ahead", [(3, 0), (29, 0), (5, 7), (0, 2)])
def test_bounded_window(df, back, ahead):
    def exprs(w):
        return {"n": F.count("v").over(w.rowsBetween(-back, ahead)), "m": F.max("i").over(w.rowsBetween(-back, ahead)), "f": F.min("d").over(w.rowsBetween(-back, ahead))}
    plain = Window.partitionBy("k").orderBy("d", "i")
    want = df.withColumns(exprs(plain))
    got = bounded_window(df, S, exprs, back, ahead)
    assert rows(got, "i", "n", "m", "f") == rows(want, "i", "n", "m", "f")


def test_carry_forward(df):
    for strict in (False, True):
        w = Window.partitionBy("k").orderBy("d", "i").rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
        got = carry_forward(df, S, {"v": F.col("v")}, strict=strict)
        assert rows(got, "i", "v") == rows(df.withColumn("v", F.last("v", ignorenulls=True).over(w)), "i", "v")
    w = Window.partitionBy("k").orderBy(F.desc("d"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    got = carry_forward(df, S, {"v": F.col("v")}, backward=True)
    assert rows(got, "i", "v") == rows(df.withColumn("v", F.last("v", ignorenulls=True).over(w)), "i", "v")


def test_mark_lowest(df):
    h = df.withColumn("h", F.md5(F.col("i").cast("string")))
    got = mark_lowest(h, F.lit(217), hash_series([], "h", digits=2))
    want = {r.i for r in h.orderBy("h").limit(217).collect()}
    assert {r.i for r in got.filter("chosen").collect()} == want and got.count() == 600
    assert mark_lowest(h, F.lit(9999), hash_series([], "h")).filter("chosen").count() == 600
    quota = df.sparkSession.createDataFrame([("a", 150), ("b", 3), ("zz", 5)], "k string, q int")
    per = mark_lowest_per_key(h, hash_series(["k"], "h", digits=2), quota, "q").filter("chosen").groupBy("k").count()
    assert {r["k"]: r["count"] for r in per.collect()} == {"a": 150, "b": 3}


def test_exact_quantiles(df):
    got = exact_quantiles(df, ["k"], {"v": F.col("v"), "w": F.abs("v")}, {"_0": 0.0, "_1": 0.05, "_5": 0.5, "_9": 0.95, "_10": 1.0})
    want = df.groupBy("k").agg(*[F.percentile(c, p).alias(f"{n}{s}") for n, c in (("v", F.col("v")), ("w", F.abs("v")))
                                 for s, p in (("_0", 0.0), ("_1", 0.05), ("_5", 0.5), ("_9", 0.95), ("_10", 1.0))])
    cols = want.columns[1:]
    for g, w in zip(got.orderBy("k").collect(), want.orderBy("k").collect()):
        assert [g[c] for c in cols] == pytest.approx([w[c] for c in cols])
    empty = exact_quantiles(df.filter("false"), [], {"v": F.col("v")}, {"": 0.5}).collect()
    assert len(empty) == 1 and empty[0].v is None


def test_short_series(spark):
    """Sections of 1 to 4 rows: a lag falls back to the filled lag before it."""
    df = spark.createDataFrame([(f"s{n}", d, float(d)) for n in (1, 2, 3, 4) for d in range(1, n + 1)], "k string, d int, v double")
    got = lag_cascade(df, Series(["k"], ["d"]), ["v"])
    assert [tuple(r)[3:] for r in got.filter("k = 's4'").orderBy("d").collect()] == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 2, 1)]
    means = trailing_means(df, Series(["k"], ["d"]), ["v"], (2,))
    assert [r.v_avg2 for r in means.filter("k = 's3'").orderBy("d").collect()] == [1.0, 1.5, 2.5]
