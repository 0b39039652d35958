"""Scans, sinks, projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.functions import expressions as X
from sensorloom.operators import clean, context
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query
from sensorloom.session import scratch_path
from sensorloom.sources import tables as T

rnd, r = B.rnd, B.r


@query("A1", "SELECT * FROM supplier")
def table_scan(spark: SparkSession, sf: str) -> DataFrame:
    return T.scan_table(spark, f"{sf}/supplier.parquet")


@query("A2", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def sql_scan_limited(spark: SparkSession, sf: str) -> DataFrame:
    B.table(spark, sf, "orders").createOrReplaceTempView("loom_orders")
    return T.scan_sql(spark, "SELECT o_orderkey, o_totalprice FROM loom_orders", 500, [F.desc("o_totalprice"), "o_orderkey"])


@query("A3 A8", "SELECT * FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Write a report as CSV, load it with its schema, skip a table that is absent."""
    df = B.table(spark, sf, "supplier")
    folder = scratch_path(spark, "csv")
    T.write_report(df, f"{folder}/supplier.csv")
    return T.load_csv_tables(spark, folder, {"supplier": df.schema, "absent": df.schema})["supplier"]


@query("A4", """SELECT o_orderkey FROM orders
ORDER BY md5(concat('42|', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""")
def random_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.random_scan(B.table(spark, sf, "orders").select("o_orderkey"), 1000, ["o_orderkey"], 42, ["o_orderkey"])


@query("A6", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def table_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "table")
    T.write_table(B.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), path, ["o_orderstatus"])
    return spark.read.parquet(path)


@query("A7", """SELECT 'm' AS "ModelName", v AS "ModelVersion", concat('n=', CAST(n AS VARCHAR), ', pos=', CAST(pos AS VARCHAR)) AS "ModelMetrics", 'p1' AS "PipelineVersion"
FROM (SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS pos FROM orders), (VALUES ('1'), ('2')) t(v)""")
def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "metrics")
    row = B.table(spark, sf, "orders").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("pos"))
    for version in ("1", "2"):
        T.append_metrics(T.metrics_row(row, "m", version, "p1"), path)
    return spark.read.parquet(path)


@query("A10", "WITH " + B.CONTEXTS + """ SELECT key AS p_key, label AS target,
CASE WHEN key % 7 = 0 THEN 1.0 ELSE (key % 7) / 7.0 END AS probability FROM contexts""".replace("(key % 7) / 7.0", "CAST(key % 7 AS DOUBLE) / 7"))
def score_sink(spark: SparkSession, sf: str) -> DataFrame:
    p = F.when(F.col("key") % 7 == 0, F.lit(1.0)).otherwise((F.col("key") % 7).cast("double") / F.lit(7.0))
    out = T.score_table(B.contexts(spark, sf), "key", "label", p)
    path = scratch_path(spark, "scores")
    T.write_table(out, path)
    return spark.read.parquet(path)


@query("A11", "WITH " + B.WINDOWS + """
SELECT 'contexts' AS table_name, count(*) AS n_rows, 8 AS n_columns,
  CAST(sum(CASE WHEN break_date IS NULL THEN 1 ELSE 0 END + CASE WHEN rul IS NULL THEN 1 ELSE 0 END + CASE WHEN last_fail IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing,
  round(100.0 * sum(CASE WHEN break_date IS NULL THEN 1 ELSE 0 END + CASE WHEN rul IS NULL THEN 1 ELSE 0 END + CASE WHEN last_fail IS NULL THEN 1 ELSE 0 END) / (count(*) * 8.0) + 3e-9, 4) AS missing_pct,
  'prediction contexts' AS description FROM contexts
UNION ALL SELECT 'events', count(*), 6, 0, 3e-9 - 3e-9, '' FROM events""")
def tables_summary(spark: SparkSession, sf: str) -> DataFrame:
    cols = ["key", "base", "mapped", "pos", "r_date", "label", "break_date"]
    c = B.contexts(spark, sf).select(*cols[:6], "rul", "break_date", "last_fail").drop("mapped")
    out = T.table_summary({"contexts": c, "events": B.table(spark, sf, "events")}, {"contexts": "prediction contexts"})
    return out.withColumn("missing_pct", F.round(F.col("missing_pct") + F.when(F.col("missing") > 0, F.lit(3e-9)).otherwise(F.lit(0.0)), 4))


@query("A12 B13 C7 C1", "WITH " + B.READINGS + """, ctx AS (
SELECT l_suppkey AS base, l_partkey AS pos, o_orderkey AS key, CAST(o_orderstatus = 'F' AS INTEGER) AS label FROM orders JOIN (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) ON o_orderkey = l_orderkey AND rn = 1)
SELECT base, mapped, count(*) AS n, CAST(sum(CASE WHEN ln >= 2 AND ln <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_section,
  CAST(sum(coalesce(label, 0)) AS BIGINT) AS positives, count(key) AS with_context
FROM readings LEFT JOIN ctx USING (base, pos) GROUP BY base, mapped""")
def integrated_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.readings(spark, sf).drop("mapped").withColumns({"start": F.lit(2), "finish": F.lit(5)})
    rows = rows.withColumn("in_section", clean.in_section("ln", "start", "finish"))
    ctx = B.contexts(spark, sf).select("base", "pos", "key", "label")
    out = context.lookup_join(context.context_left_join(rows, ctx, ["base", "pos"], "label"), B.base_map(spark, sf), "base")
    return out.groupBy("base", "mapped").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("in_section").cast("long")).alias("n_in_section"),
        F.sum("label").alias("positives"), F.count("key").alias("with_context"))


@query("A12 B13 C7 C1", "WITH " + B.READINGS + ", " + B.WINDOWS + """
SELECT r.base, r.mapped, count(*) AS n, CAST(sum(CASE WHEN ln >= 2 AND ln <= 5 THEN 1 ELSE 0 END) AS BIGINT) AS n_in_section,
  CAST(sum(coalesce(label, 0)) AS BIGINT) AS positives, count(key) AS with_context
FROM readings r LEFT JOIN windows w ON r.base = w.base AND r.pos = w.pos AND d BETWEEN win_start - 335 AND win_end GROUP BY r.base, r.mapped""")
def integrated_by_date(spark: SparkSession, sf: str) -> DataFrame:
    """Each reading with the contexts of the year after it only, where ``integrated_table`` takes those of any date."""
    rows = B.readings(spark, sf).drop("mapped").withColumns({"start": F.lit(2), "finish": F.lit(5)})
    rows = rows.withColumn("in_section", clean.in_section("ln", "start", "finish"))
    ctx = B.windows(spark, sf).select("base", "pos", "key", "label", F.date_sub("win_start", 335).alias("win_start"), "win_end")
    joined = context.dated_context_join(rows, ctx, ["base", "pos"], "label", "d", "win_start", "win_end", days=366)
    return context.lookup_join(joined, B.base_map(spark, sf), "base").groupBy("base", "mapped").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("in_section").cast("long")).alias("n_in_section"),
        F.sum("label").alias("positives"), F.count("key").alias("with_context"))


@query("B1 B25", "WITH " + B.CONTEXTS + " SELECT base AS \"Tc_base\", r_date AS \"Tc_day\", key, label AS \"Tc_label\" FROM contexts")
def renamed_contexts(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.prefix_rename(B.contexts(spark, sf), "Tc_", keep=["key"])
    return clean.reorder(df, ["Tc_base", "Tc_day", "key", "Tc_label"], {"Tc_r_date": "Tc_day"})


@query("B2 B3", "WITH " + B.CONTEXTS + " SELECT key, r_date, break_date FROM contexts WHERE break_date IS NOT NULL AND r_date >= DATE '1997-06-30'")
def filtered_contexts(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.date_floor(clean.require_not_null(B.contexts(spark, sf), ["r_date", "break_date"]), "r_date", "1997-06-30")
    return df.select("key", "r_date", "break_date")


@query("B4", "WITH " + B.WINDOWS + """ SELECT l_suppkey, count(*) AS n FROM lineitem,
(SELECT min(win_start) AS lo, max(win_end) AS hi FROM windows WHERE r_date < DATE '1996-01-01')
WHERE CAST(l_shipdate AS DATE) BETWEEN lo AND hi GROUP BY l_suppkey""")
def trimmed_readings(spark: SparkSession, sf: str) -> DataFrame:
    w = B.windows(spark, sf).filter(F.col("r_date") < F.lit("1996-01-01").cast("date"))
    return clean.trim_to_bounds(B.raw_readings(spark, sf), "l_shipdate", w, "win_start", "win_end").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"))


@query("B5 B5b", "WITH " + B.CONTEXTS + """ SELECT key, r_date - 30 AS win_start,
CASE WHEN rul BETWEEN 1 AND 30 THEN greatest(r_date, coalesce(break_date, r_date)) ELSE r_date END AS win_end,
pos AS pos_start, pos + 20 AS pos_end FROM contexts""")
def context_windows(spark: SparkSession, sf: str) -> DataFrame:
    return B.windows(spark, sf, break_day=True).select("key", "win_start", "win_end", "pos_start", "pos_end")


@query("B7", "WITH " + B.READINGS + """ SELECT ok, ln, pos, coalesce(nullif(disc, 0.05), 0) AS disc, coalesce(nullif(ln, 3), 0) AS ln0 FROM readings""")
def zero_filled(spark: SparkSession, sf: str) -> DataFrame:
    df = B.readings(spark, sf).select("ok", "ln", "pos", F.nullif("disc", F.lit(0.05)).alias("disc"), F.nullif("ln", F.lit(3)).alias("ln0"))
    return clean.zero_fill(df, ["disc", "ln0"])


_MIXED = """CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 3 THEN 'garbage' END"""


@query("B8", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_orderdate AS DATE)
 WHEN o_orderkey % 5 = 2 AND day(o_orderdate) <= 12 THEN make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))
 WHEN o_orderkey % 5 = 2 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders""")
def parsed_dates(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd"))
            .when(k == 2, F.date_format("o_orderdate", "dd/MM/yyyy")).when(k == 3, F.lit("garbage")))
    return B.table(spark, sf, "orders").select("o_orderkey", X.parse_date_any(text).alias("parsed"))


@query("B9 B10", "WITH " + B.CONTEXTS + """ SELECT key, concat(base, '_', pos, '_20m_', strftime(r_date, '%Y-%m-%d')) AS p_key,
concat(base, '_', pos, '_20m') AS section, concat(base, '_', pos, '_20m') AS grp, r_date AS day,
concat(base, '|', pos) AS sample_id FROM contexts""")
def keys_composed_and_split(spark: SparkSession, sf: str) -> DataFrame:
    df = B.contexts(spark, sf).select("key", "base", "pos", X.compose_key("base", "pos", "r_date").alias("p_key"))
    return df.select("key", "p_key", X.key_prefix("p_key").alias("section"), X.key_group("p_key").alias("grp"),
                     X.key_date("p_key").alias("day"),
                     F.concat_ws("|", F.col("base").cast("string"), F.col("pos").cast("string")).alias("sample_id"))


@query("B11", "WITH " + B.CONTEXTS + " SELECT concat(base, '_', pos) AS grp, count(*) AS n FROM contexts GROUP BY 1")
def fallback_group_key(spark: SparkSession, sf: str) -> DataFrame:
    df = B.contexts(spark, sf)
    return df.groupBy(clean.group_key(df, [["p_key"], ["base", "pos"], ["base", "mapped", "pos"]]).alias("grp")).agg(
        F.count(F.lit(1)).alias("n"))


@query("B12", """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE value END AS value FROM events""")
def finite_values(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 3, F.lit("bad")).when(k == 2, F.lit("Infinity")).when(k == 1, F.lit("NaN")).otherwise(F.col("value").cast("string"))
    return clean.to_finite(B.table(spark, sf, "events").select("event_id", text.alias("value")), ["value"])


@query("B14 B15", """SELECT l_orderkey, l_linenumber, l_quantity, 0.0::DOUBLE AS absent, l_tax FROM lineitem""")
def feature_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = clean.drop_leakage(B.raw_readings(spark, sf), ["l_shipdate", "l_returnflag"])
    return clean.ensure_columns(df, ["l_quantity", "absent", "l_tax"], keep=["l_orderkey", "l_linenumber"])


@query("B16", "WITH " + B.CONTEXTS + " SELECT CAST(year(r_date) AS INTEGER) AS year, CAST(month(r_date) AS INTEGER) AS month, count(*) AS n FROM contexts GROUP BY ALL")
def contexts_per_month(spark: SparkSession, sf: str) -> DataFrame:
    return clean.year_month(B.contexts(spark, sf), "r_date").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"))


@query("B17", "SELECT l_orderkey, l_linenumber, greatest(10.0, least(40.0, l_quantity)) AS l_quantity FROM lineitem")
def clipped(spark: SparkSession, sf: str) -> DataFrame:
    df = B.raw_readings(spark, sf).select("l_orderkey", "l_linenumber", "l_quantity")
    return clean.clip_columns(df, {"l_quantity": (10.0, 40.0)})


@query("B22", "WITH " + B.CONTEXTS + " SELECT key, CAST(break_date - r_date BETWEEN 0 AND 30 AS INTEGER) AS horizon FROM contexts WHERE break_date IS NOT NULL")
def horizon_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = B.contexts(spark, sf).select("key", X.horizon_label("r_date", "break_date").alias("horizon"))
    return clean.require_not_null(df, ["horizon"])


@query("B23", "WITH " + B.CONTEXTS + """ SELECT key,
round(sin(6.2831852 * (dayofweek(r_date) / 7.0::DOUBLE)), 6) AS sin_dow, round(cos(6.2831852 * (dayofweek(r_date) / 7.0::DOUBLE)), 6) AS cos_dow,
round(sin(6.2831852 * ((month(r_date) - 1) / 12.0::DOUBLE)), 6) AS sin_mon, round(cos(6.2831852 * ((month(r_date) - 1) / 12.0::DOUBLE)), 6) AS cos_mon FROM contexts""")
def cyclic_dates(spark: SparkSession, sf: str) -> DataFrame:
    return B.contexts(spark, sf).select("key", *[F.round(e, 6).alias(n) for n, e in X.cyclic("r_date").items()])
