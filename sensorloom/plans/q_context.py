"""Assembly queries: joins and aggregations around the contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import clean, context, features
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query
from sensorloom.session import written

rnd, r = B.rnd, B.r

BINS = """bins AS (SELECT base, mapped, pos, d, avg(qty) AS qty, avg(price) AS price, avg(disc) AS disc, avg(tax) AS tax, count(*) AS rows_in_bin
  FROM readings GROUP BY base, mapped, pos, d)"""
JOINED = """joined AS (SELECT w.*, b.base AS r_base, b.pos AS r_pos, b.d AS r_d, b.qty, b.price, b.disc, b.tax, b.rows_in_bin
  FROM windows w JOIN bins b ON coalesce(w.mapped, w.base) = coalesce(b.mapped, b.base)
   AND b.d BETWEEN win_start AND win_end AND b.pos BETWEEN pos_start AND pos_end)"""
_DAY = f"""SELECT key, base, mapped, pos, r_date, label, r_d, {r('avg(qty)')} AS qty, {r('avg(price)')} AS price,
 {r('avg(disc)', 6)} AS disc, {r('avg(tax)', 6)} AS tax, CAST(sum(rows_in_bin) AS BIGINT) AS row_count"""
_KEYS = ["key", "base", "mapped", "pos", "r_date", "label"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"qty": rnd("qty"), "price": rnd("price"), "disc": rnd("disc", 6), "tax": rnd("tax", 6)})


def _table(spark, sf, break_day=False, with_load=False, **how):
    bmap = B.base_map(spark, sf)
    return context.training_table(
        B.windows(spark, sf, break_day), B.raw_readings(spark, sf), B.ROLES, "l_shipdate",
        lambda raw: B.read_readings(raw, bmap), B.WIDTH, _KEYS,
        B.intervals(spark, sf) if with_load else None, interval_on=["base"], **how)


@query("C2 D2 B25 C1 D1 B4", "WITH " + ", ".join([B.READINGS, B.WINDOWS, BINS, JOINED]) + _DAY + " FROM joined GROUP BY key, base, mapped, pos, r_date, label, r_d")
def context_assembly(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_table(spark, sf))


@query("C2", "WITH " + ", ".join([B.READINGS, B.WINDOWS, BINS, JOINED]) + _DAY + " FROM joined GROUP BY key, base, mapped, pos, r_date, label, r_d")
def context_assembly_plain_join(spark: SparkSession, sf: str) -> DataFrame:
    """The same table over date cells of a week. The join without cells, in which every context of a base meets every reading of
    it, is a yardstick of the benchmark only."""
    return _rounded(_table(spark, sf, days=7))


def all_pairs_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Yardstick, not registered."""
    return _rounded(_table(spark, sf, join=context.band_join_plain))


@query("B5b C2 C3 D2", "WITH " + ", ".join([
    B.READINGS, B.INTERVALS, B.CONTEXTS,
    """windows AS (SELECT *, r_date - 30 AS win_start, CASE WHEN rul BETWEEN 1 AND 30 THEN greatest(r_date, coalesce(break_date, r_date)) ELSE r_date END AS win_end,
    pos AS pos_start, pos + 20 AS pos_end FROM contexts)""", BINS, JOINED,
    """loads AS (SELECT r_base, r_date, avg(amount) AS amount FROM (SELECT DISTINCT r_base, r_date FROM joined) JOIN intervals ON r_base = intervals.base AND r_date BETWEEN from_d AND to_d GROUP BY ALL)""",
    "loaded AS (SELECT joined.*, amount FROM joined LEFT JOIN loads USING (r_base, r_date))"])
    + _DAY + f", {r('avg(amount)')} AS amount FROM loaded GROUP BY key, base, mapped, pos, r_date, label, r_d")
def context_assembly_break_day(spark: SparkSession, sf: str) -> DataFrame:
    """Break-day window end and the amount valid at the context date."""
    return _rounded(_table(spark, sf, break_day=True, with_load=True)).withColumn("amount", rnd("amount"))


@query("C2", "WITH " + ", ".join([B.READINGS, B.WINDOWS]) + """
SELECT w.key, r.d AS r_d, r.pos AS r_pos, count(*) AS n FROM windows w JOIN readings r
 ON coalesce(w.mapped, w.base) = coalesce(r.mapped, r.base) AND r.d BETWEEN win_start AND win_end AND r.pos BETWEEN pos_start AND pos_end
GROUP BY w.key, r.d, r.pos""")
def band_join(spark: SparkSession, sf: str) -> DataFrame:
    out = context.band_join(B.windows(spark, sf), B.readings(spark, sf), B.ROLES, B.WIDTH)
    return out.groupBy("key", "r_d", "r_pos").agg(F.count(F.lit(1)).alias("n"))


@query("D1 C1", f"WITH {B.READINGS}, {BINS} SELECT base, mapped, pos, d, {r('qty')} AS qty, {r('price')} AS price, {r('disc', 6)} AS disc, {r('tax', 6)} AS tax, rows_in_bin FROM bins")
def binned_readings(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(context.bin_readings(B.readings(spark, sf), B.ROLES, ["base", "mapped", "pos", "d"]))


@query("C3", "WITH " + ", ".join([B.READINGS, B.INTERVALS, B.CONTEXTS]) + """
SELECT key, c.base, r_date, amount FROM contexts c LEFT JOIN intervals i ON c.base = i.base AND r_date BETWEEN from_d AND to_d""")
def validity_join(spark: SparkSession, sf: str) -> DataFrame:
    c = B.contexts(spark, sf).select("key", "base", "r_date")
    return context.validity_join(c, B.intervals(spark, sf), ["base"], "r_date", "from_d", "to_d", "amount")


@query("C4 D6", "WITH " + ", ".join([B.READINGS, B.CONTEXTS]) + f"""
SELECT key, c.base, r_date, {r('avg(qty)')} AS avg_speed, min(qty) AS min_speed, max(qty) AS max_speed, max(disc) AS max_twist, count(DISTINCT d) AS window_count
FROM contexts c LEFT JOIN readings r ON c.base = r.base AND d BETWEEN r_date - 30 AND r_date GROUP BY key, c.base, r_date""")
def trailing_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = context.trailing_stats(B.contexts(spark, sf), B.readings(spark, sf), "key", ["base"], "r_date", "d", "qty", "disc")
    return out.withColumn("avg_speed", rnd("avg_speed"))


_LOAD = """loads AS (SELECT key, sum(amount) AS total_load, sum(CASE WHEN r_date BETWEEN from_d AND to_d
  THEN (r_date - from_d) * 1.0::DOUBLE / nullif(to_d - from_d, 0) * amount WHEN to_d < r_date THEN amount ELSE 0 END) AS load_to_date
 FROM contexts c LEFT JOIN intervals i ON c.base = i.base GROUP BY key)"""


@query("D7", "WITH " + ", ".join([B.READINGS, B.INTERVALS, B.CONTEXTS, _LOAD]) + f" SELECT key, {r('total_load')} AS total_load, {r('load_to_date')} AS load_to_date FROM loads")
def prorated_load(spark: SparkSession, sf: str) -> DataFrame:
    out = context.prorated_load(B.contexts(spark, sf), B.intervals(spark, sf), "key", ["base"], "r_date", "from_d", "to_d", "amount")
    return out.select("key", rnd("total_load").alias("total_load"), rnd("load_to_date").alias("load_to_date"))


@query("D8", "WITH " + B.CONTEXTS + " SELECT key, CAST(break_date - last_fail AS INTEGER) AS leak_days, CAST(r_date - last_fail AS INTEGER) AS days_since FROM contexts")
def days_since_failure(spark: SparkSession, sf: str) -> DataFrame:
    out = context.days_since(B.contexts(spark, sf), "last_fail", "break_date", "leak_days")
    return context.days_since(out, "last_fail", "r_date").select("key", "leak_days", "days_since")


@query("C10 C4 D6 D7 D8", "WITH " + ", ".join([B.READINGS, B.INTERVALS, B.CONTEXTS, _LOAD,
    """wagon AS (SELECT key, avg(qty) AS avg_speed, max(disc) AS max_twist, count(DISTINCT d) AS window_count
    FROM contexts c LEFT JOIN readings r ON c.base = r.base AND d BETWEEN r_date - 30 AND r_date GROUP BY key)"""]) + f"""
SELECT key, base, r_date, CAST(break_date - last_fail AS INTEGER) AS days_since, {r('avg_speed')} AS avg_speed, max_twist, window_count,
 {r('total_load')} AS total_load, {r('load_to_date')} AS load_to_date, label, rul FROM contexts LEFT JOIN wagon USING (key) LEFT JOIN loads USING (key)""")
def assembled_blocks(spark: SparkSession, sf: str) -> DataFrame:
    c = B.contexts(spark, sf)
    wagon = context.trailing_stats(c, B.readings(spark, sf), "key", ["base"], "r_date", "d", "qty", "disc").select(
        "key", rnd("avg_speed").alias("avg_speed"), "max_twist", "window_count")
    load = context.prorated_load(c, B.intervals(spark, sf), "key", ["base"], "r_date", "from_d", "to_d", "amount").select(
        "key", rnd("total_load").alias("total_load"), rnd("load_to_date").alias("load_to_date"))
    base = context.days_since(c, "last_fail", "break_date").select("key", "base", "r_date", "days_since", "label", "rul")
    return context.assemble_blocks(base, [wagon, load], "key")


@query("C7", "WITH " + ", ".join([B.READINGS, B.CONTEXTS]) + """
SELECT r.base, r.pos, count(*) AS n, CAST(sum(coalesce(label, 0)) AS BIGINT) AS positives FROM readings r LEFT JOIN contexts c ON r.base = c.base AND r.pos = c.pos GROUP BY r.base, r.pos""")
def context_left_join(spark: SparkSession, sf: str) -> DataFrame:
    c = B.contexts(spark, sf).select("base", "pos", "label")
    return context.context_left_join(B.readings(spark, sf), c, ["base", "pos"], "label").groupBy("base", "pos").agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").alias("positives"))


@query("C6 D9", "WITH " + B.DAYS + """, l AS (SELECT DISTINCT section, label FROM days),
p AS (SELECT section, min(value) AS value_min, max(value) AS value_max FROM days GROUP BY section)
SELECT section, value_min, value_max, label FROM p JOIN l USING (section)""")
def label_join(spark: SparkSession, sf: str) -> DataFrame:
    d = B.days(spark, sf)
    return context.label_join(features.key_profile(d, ["section"], ["value"], ["min", "max"]), d, "section", "label")


@query("C9", "WITH " + B.CONTEXTS + """ SELECT l_orderkey, l_linenumber, l_orderkey IN (SELECT key FROM contexts WHERE label = 1) AS inside FROM lineitem""")
def membership(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.raw_readings(spark, sf).select("l_orderkey", "l_linenumber")
    chosen = written(B.contexts(spark, sf).filter("label = 1").select(F.col("key").alias("l_orderkey")), "chosen")  # read twice
    ins = context.members(rows, chosen, ["l_orderkey"]).withColumn("inside", F.lit(True))
    out = context.members(rows, chosen, ["l_orderkey"], keep=False).withColumn("inside", F.lit(False))
    return ins.unionByName(out)
