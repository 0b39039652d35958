"""Null keys, null dates, NaN scores and overlapping intervals."""

import datetime
import math

from pyspark.sql import functions as F

from sensorloom.operators import context, evaluate, splits
from sensorloom.operators.ordered import Series, carry_forward, positions
from sensorloom.operators.resample import stratum_quota, undersample_stratified


def day(n, month=1):
    return datetime.date(2024, month, n)


def test_a_null_key_is_one_series(spark):
    df = spark.range(100).select("id", F.lit(None).cast("string").alias("k"), (F.col("id") % 7).cast("int").alias("d"))
    got = positions(df, Series(["k"], ["d", "id"]))
    assert sorted(r.rn for r in got.collect()) == list(range(1, 101))
    filled = carry_forward(df.withColumn("v", F.when(F.col("id") == 0, 5)), Series(["k"], ["d", "id"]), {"v": F.col("v")})
    assert {r.v for r in filled.collect()} == {5}


def test_null_dates_come_first_in_a_split(spark):
    df = spark.range(100).select("id", F.when(F.col("id") >= 20, F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int"))).alias("d"))
    out = splits.split_rows(df, ["d", "id"], 0.8).collect()
    assert sorted(r.id for r in out if r.part == "train") == list(range(80))


def test_null_stratum_is_sampled(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 2 == 0, "a").alias("s"), (F.col("id") < 10).cast("int").alias("y"))
    assert {(r.s, r.quota) for r in stratum_quota(df, "y", ["s"]).collect()} == {("a", 5), (None, 5)}
    out = undersample_stratified(df, "y", ["s"], ["id"]).collect()
    assert sum(r.y == 0 and r.s is None for r in out) == 5 == sum(r.y == 0 and r.s == "a" for r in out)


def test_a_nan_score_ranks_first_and_alone(spark):
    rows = [(math.nan, 0), (0.9, 1), (0.9, 0), (0.1, 1)]
    curve = evaluate.ranking_curve(spark.createDataFrame(rows, "s double, y int"), "s", "y").collect()
    got = {("nan" if math.isnan(r.score) else r.score): (r.tp, r.fp) for r in curve}
    assert got == {"nan": (0, 1), 0.9: (1, 2), 0.1: (2, 2)}


def test_an_ended_amount_leaves_no_trace(spark):
    rows = [("p", day(1), day(5), math.nan), ("p", day(1), day(28, 2), 5.0), ("q", day(1), day(10), 1e17), ("q", day(1), day(10, 2), 1.0)]
    intervals = spark.createDataFrame(rows, "place string, a date, b date, amount double")
    asked = spark.createDataFrame([("p", day(3)), ("p", day(1, 2)), ("q", day(1, 2)), ("q", day(5)), ("q", day(20, 2)), (None, day(3))], "place string, d date")
    got = {(r.place, r.d): r.amount for r in context.validity_join(asked, intervals, ["place"], "d", "a", "b", "amount").collect()}
    assert math.isnan(got.pop(("p", day(3))))
    assert got == {("p", day(1, 2)): 5.0, ("q", day(1, 2)): 1.0, ("q", day(5)): (1e17 + 1.0) / 2, ("q", day(20, 2)): None, (None, day(3)): None}
