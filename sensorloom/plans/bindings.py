"""Bindings of the column roles to the supplied tables, in Spark and in SQL.

readings: lineitem with its supplier; contexts: the first line of each order; series: events
per user; intervals: monthly load per supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators.clean import context_window
from sensorloom.operators.context import lookup_join
from sensorloom.roles import Roles

CHANNELS = ("qty", "price", "disc", "tax")
ROLES = Roles(channels=CHANNELS)
WIDTH = 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base_map(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("base"), F.col("s_nationkey").alias("mapped"))


def raw_readings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def read_readings(raw: DataFrame, bmap: DataFrame) -> DataFrame:
    """Raw lines to role columns; a line's own number serves as place within its section."""
    rows = raw.select(
        F.col("l_suppkey").alias("base"), F.col("l_partkey").alias("pos"), F.to_date("l_shipdate").alias("d"),
        F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"),
        F.col("l_orderkey").alias("ok"), F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("flag"))
    return lookup_join(rows, bmap, "base")


def readings(spark: SparkSession, sf: str) -> DataFrame:
    return read_readings(raw_readings(spark, sf), base_map(spark, sf))


def contexts(spark: SparkSession, sf: str) -> DataFrame:
    first = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min(F.struct("l_linenumber", "l_partkey", "l_suppkey")).alias("f"))
    order = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("r_date"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"))
    rows = order.join(first, order["key"] == first["l_orderkey"]).select(
        "key", F.col("f.l_suppkey").alias("base"), F.col("f.l_partkey").alias("pos"), "r_date", "label",
        F.when(F.col("label") == 1, (F.col("key") % 60).cast("int")).alias("rul"))
    rows = rows.select(
        "*", F.date_add(F.col("r_date"), F.col("rul")).alias("break_date"),
        F.when(F.col("key") % 3 == 0, F.date_sub(F.col("r_date"), (F.col("key") % 90 + 1).cast("int"))).alias("last_fail"))
    return lookup_join(rows, base_map(spark, sf), "base")


def windows(spark: SparkSession, sf: str, break_day: bool = False) -> DataFrame:
    c = contexts(spark, sf)
    if break_day:
        return context_window(c, "r_date", "pos", 30, WIDTH, "break_date", "rul")
    return context_window(c, "r_date", "pos", 30, WIDTH)


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Load per supplier and month, as a validity interval."""
    return readings(spark, sf).groupBy("base", F.trunc("d", "month").alias("from_d")).agg(
        F.sum("qty").alias("amount")).select("base", "from_d", F.last_day("from_d").alias("to_d"), "amount")


def days(spark: SparkSession, sf: str) -> DataFrame:
    """Events per user with their day; label 1 for an error."""
    return table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("section"), F.to_date("ts").alias("d"), "value",
        (F.col("event_type") == "error").cast("int").alias("label"), F.col("event_type").alias("kind"))


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """A score and a label per line: deterministic expressions of the row."""
    return readings(spark, sf).select(
        "ok", "ln", "base", "mapped", "pos", "d",
        ((F.col("qty") % 50) / F.lit(50.0) * F.lit(0.8) + F.col("disc")).alias("score"),
        (F.col("flag") == "R").cast("int").alias("label"))


def rnd(c: Column | str, digits: int = 4) -> Column:
    """Round for comparison; the small shift keeps exact decimal ties away from the rounding edge."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(3e-9), digits)


# The same bindings in SQL.
READINGS = """readings AS (
  SELECT l_suppkey AS base, s_nationkey AS mapped, l_partkey AS pos, CAST(l_shipdate AS DATE) AS d,
         l_quantity AS qty, l_extendedprice AS price, l_discount AS disc, l_tax AS tax,
         l_orderkey AS ok, l_linenumber AS ln, l_returnflag AS flag
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
CONTEXTS = """first_line AS (
  SELECT l_orderkey, l_suppkey, l_partkey,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
contexts AS (
  SELECT o_orderkey AS key, l_suppkey AS base, s_nationkey AS mapped, l_partkey AS pos, CAST(o_orderdate AS DATE) AS r_date,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 60 AS INTEGER) END AS rul,
         CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 60 AS INTEGER) END AS break_date,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - CAST(o_orderkey % 90 + 1 AS INTEGER) END AS last_fail
  FROM orders JOIN first_line ON o_orderkey = l_orderkey AND rn = 1 LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
WINDOWS = CONTEXTS + """,
windows AS (SELECT *, r_date - 30 AS win_start, r_date AS win_end, pos AS pos_start, pos + 20 AS pos_end FROM contexts)"""
INTERVALS = """intervals AS (
  SELECT base, CAST(date_trunc('month', d) AS DATE) AS from_d, last_day(CAST(date_trunc('month', d) AS DATE)) AS to_d, sum(qty) AS amount
  FROM readings GROUP BY ALL)"""
DAYS = """days AS (
  SELECT event_id, user_id AS section, CAST(ts AS DATE) AS d, value, CAST(event_type = 'error' AS INTEGER) AS label,
         event_type AS kind FROM events)"""
SCORES = READINGS + """,
scores AS (SELECT ok, ln, base, mapped, pos, d, (qty % 50) / 50.0 * 0.8 + disc AS score,
  CAST(flag = 'R' AS INTEGER) AS label FROM readings)"""


def r(expr: str, digits: int = 4) -> str:
    """SQL twin of ``rnd``."""
    return f"round(({expr}) + 3e-9, {digits})"
