"""Rebalancing, weights, splits and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import resample, splits
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query

rnd, r = B.rnd, B.r
COLS = ["key", "base", "mapped", "label"]
HASHED = "hashed AS (SELECT key, base, mapped, r_date, label, md5(concat('42|', CAST(key AS VARCHAR))) AS h FROM contexts)"
U = "CAST(('0x' || substr(h, 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE"


def ctx(spark, sf):
    return B.contexts(spark, sf).select(*COLS)


@query("H1", f"""WITH {B.CONTEXTS}, {HASHED}, n AS (SELECT label, count(*) AS n FROM contexts GROUP BY label), m AS (SELECT max(n) AS m FROM n),
ranked AS (SELECT hashed.*, n, m, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM hashed JOIN n USING (label), m)
SELECT key, base, mapped, label, CAST(unnest(range(1, CAST(m // n + CASE WHEN rn <= m % n THEN 1 ELSE 0 END AS BIGINT) + 1)) AS INTEGER) AS copy FROM ranked""")
def oversample_random(spark: SparkSession, sf: str) -> DataFrame:
    return resample.oversample_random(ctx(spark, sf), "label", ["key"])


@query("H2", f"""WITH {B.CONTEXTS}, {HASHED}, ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn FROM hashed)
SELECT key, base, mapped, label FROM ranked WHERE label = 1 OR rn <= (SELECT count(*) FROM contexts WHERE label = 1)""")
def undersample_random(spark: SparkSession, sf: str) -> DataFrame:
    return resample.undersample_random(ctx(spark, sf), "label", ["key"])


@query("H3", f"""WITH {B.CONTEXTS}, {HASHED}, t AS (SELECT floor(count(*) FILTER (label = 0) * 0.83::DOUBLE)::BIGINT AS target, count(*) FILTER (label = 1) AS have FROM contexts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY mapped ORDER BY h) AS rk FROM hashed WHERE label = 1),
placed AS (SELECT ranked.*, target, have, row_number() OVER (ORDER BY rk, h) AS p FROM ranked, t)
SELECT key, base, mapped, label, CAST(unnest(range(1, target // have + CASE WHEN p <= target % have THEN 1 ELSE 0 END + 1)) AS INTEGER) AS copy FROM placed
UNION ALL SELECT key, base, mapped, label, 1 FROM contexts WHERE label = 0""")
def oversample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return resample.oversample_stratified(ctx(spark, sf), "label", ["mapped"], ["key"], 0.83)


_UNDER = f"""WITH {B.CONTEXTS}, {HASHED}, m AS (SELECT base, count(*) AS m FROM contexts WHERE label = 1 GROUP BY base),
ranked AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY h) AS rk FROM hashed WHERE label = 0)
SELECT key, base, mapped, label FROM ranked JOIN m USING (base) WHERE rk <= {{}} UNION ALL SELECT key, base, mapped, label FROM contexts WHERE label = 1"""


@query("H4 C8 E3", _UNDER.format("m"))
def undersample_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return resample.undersample_stratified(ctx(spark, sf), "label", ["base"], ["key"])


@query("H5", _UNDER.format("floor(m * 1.3::DOUBLE)"))
def undersample_stratified_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return resample.undersample_stratified(ctx(spark, sf), "label", ["base"], ["key"], 1.3)


@query("C8", f"WITH {B.CONTEXTS} SELECT base, count(*) FILTER (label = 0) AS majority, count(*) FILTER (label = 1) AS minority FROM contexts GROUP BY base HAVING count(*) FILTER (label = 0) > 0")
def stratum_counts(spark: SparkSession, sf: str) -> DataFrame:
    return resample.stratum_counts(ctx(spark, sf), "label", ["base"])


@query("E3", f"WITH {B.CONTEXTS}, {HASHED} SELECT key, base, mapped, label, row_number() OVER (PARTITION BY mapped ORDER BY h) AS rank FROM hashed")
def rank_in_stratum(spark: SparkSession, sf: str) -> DataFrame:
    return resample.rank_in_stratum(ctx(spark, sf), ["mapped"], ["key"])


@query("H6", f"WITH {B.CONTEXTS}, {HASHED}, s AS (SELECT count(*) FILTER (label = 1)::DOUBLE / count(*) FILTER (label = 0) AS share FROM contexts) SELECT key, base, mapped, label FROM hashed, s WHERE label = 1 OR {U} < share")
def undersample_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return resample.undersample_fraction(ctx(spark, sf), "label", ["key"])


@query("H7", f"WITH {B.CONTEXTS} SELECT key, base, mapped, label, {r('(count(*) OVER (PARTITION BY base) + 1)::DOUBLE / (count(*) OVER (PARTITION BY base, label) + 1)', 6)} AS weight FROM contexts")
def draw_weights(spark: SparkSession, sf: str) -> DataFrame:
    return resample.draw_weights(ctx(spark, sf), "base", "label").withColumn("weight", rnd("weight", 6))


@query("H7", f"""WITH {B.CONTEXTS}, {HASHED}, w AS (SELECT *, (count(*) OVER (PARTITION BY base) + 1)::DOUBLE / (count(*) OVER (PARTITION BY base, label) + 1) AS w,
 (CAST(('0x' || substr(h, 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE AS u FROM hashed)
SELECT key, base, mapped, label FROM w ORDER BY -ln(u) / w, key LIMIT 2000""")
def weighted_draw(spark: SparkSession, sf: str) -> DataFrame:
    return resample.weighted_draw(resample.draw_weights(ctx(spark, sf), "base", "label"), "weight", 2000, ["key"]).select(*COLS)


@query("H8", f"WITH {B.CONTEXTS} SELECT key, base, mapped, label, round(1.0::DOUBLE / count(*) OVER (PARTITION BY label), 9) AS weight FROM contexts")
def inverse_class_weight(spark: SparkSession, sf: str) -> DataFrame:
    return resample.inverse_class_weight(ctx(spark, sf), "label").withColumn("weight", F.round("weight", 9))


@query("H9", f"WITH {B.CONTEXTS} SELECT key, label, CASE WHEN label = 1 THEN (SELECT {r('0.4 * count(*) FILTER (label = 0) / (0.6 * count(*) FILTER (label = 1))', 6)} FROM contexts) ELSE 1.0::DOUBLE END AS weight FROM contexts")
def target_fraction_weight(spark: SparkSession, sf: str) -> DataFrame:
    out = resample.target_fraction_weight(ctx(spark, sf), "label", 0.4)
    return out.select("key", "label", F.when(F.col("label") == 1, rnd("weight", 6)).otherwise(F.col("weight")).alias("weight"))


@query("H10", f"WITH {B.CONTEXTS} SELECT key, label, {r('count(*) OVER ()::DOUBLE / (2 * count(*) OVER (PARTITION BY label))', 6)} AS weight FROM contexts".replace("count(*) OVER ()::DOUBLE", "(count(*) OVER ())::DOUBLE"))
def balanced_class_weight(spark: SparkSession, sf: str) -> DataFrame:
    return resample.balanced_class_weight(ctx(spark, sf), "label").select("key", "label", rnd("weight", 6).alias("weight"))


@query("H10", f"WITH {B.CONTEXTS} SELECT count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg, {r('count(*) FILTER (label = 0)::DOUBLE / count(*) FILTER (label = 1)', 6)} AS pos_weight FROM contexts".replace("count(*) FILTER (label = 0)::DOUBLE /", "(count(*) FILTER (label = 0))::DOUBLE /"))
def pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    return resample.pos_weight(ctx(spark, sf), "label").withColumn("pos_weight", rnd("pos_weight", 6))


@query("E4", f"WITH {B.DAYS} SELECT event_id, {r('1.0::DOUBLE / count(*) OVER (PARTITION BY section, d) * (SELECT (count(*) FILTER (label = 0))::DOUBLE / count(*) FILTER (label = 1) FROM days)', 6)} AS weight FROM days")
def bag_weight(spark: SparkSession, sf: str) -> DataFrame:
    return resample.bag_weight(B.days(spark, sf), ["section", "d"], "label").select("event_id", rnd("weight", 6).alias("weight"))


_DATES = "dd AS (SELECT r_date AS day, row_number() OVER (ORDER BY r_date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT r_date FROM contexts))"


def dated(spark, sf):
    return B.contexts(spark, sf).select("key", "base", "pos", "r_date", "label")


@query("I1", f"""WITH {B.CONTEXTS}, {_DATES}, c AS (SELECT max(day) FILTER (i = floor(n * 0.8::DOUBLE)) AS c1, max(day) FILTER (i = floor(n * 0.9::DOUBLE)) AS c2 FROM dd)
SELECT key, r_date, CASE WHEN r_date <= c1 THEN 'train' WHEN r_date <= c2 THEN 'val' ELSE 'test' END AS part FROM contexts, c""")
def split_dates_3way(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_dates_3way(dated(spark, sf), "r_date").select("key", "r_date", "part")


@query("I2", f"""WITH {B.CONTEXTS}, {_DATES}, c AS (SELECT max(day) FILTER (i = floor(n * 0.8::DOUBLE) - 1) AS c1 FROM dd)
SELECT key, r_date, CASE WHEN r_date <= c1 THEN 'train' ELSE 'test' END AS part FROM contexts, c""")
def split_dates_2way(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_dates_2way(dated(spark, sf), "r_date").select("key", "r_date", "part")


@query("I3", f"""WITH {B.CONTEXTS}, x AS (SELECT *, row_number() OVER (ORDER BY r_date, key) AS rn, count(*) OVER () AS n FROM contexts)
SELECT key, r_date, CASE WHEN rn <= floor(n * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM x""")
def split_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_rows(dated(spark, sf), ["r_date", "key"]).select("key", "r_date", "part")


@query("I4", f"""WITH {B.CONTEXTS}, y AS (SELECT yr, row_number() OVER (ORDER BY yr DESC) AS k FROM (SELECT DISTINCT year(r_date) AS yr FROM contexts))
SELECT key, r_date, CASE k WHEN 1 THEN 'test' WHEN 2 THEN 'val' ELSE 'train' END AS part FROM contexts JOIN y ON year(r_date) = yr""")
def split_years(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_years(dated(spark, sf), "r_date", "label", ["key"]).select("key", "r_date", "part")


@query("I5", f"""WITH {B.CONTEXTS}, f AS (SELECT base, pos, min(r_date) - DATE '1970-01-01' AS first FROM contexts GROUP BY base, pos),
c AS (SELECT quantile_cont(CAST(first AS DOUBLE), 0.8) AS cut FROM f)
SELECT key, CASE WHEN first <= cut THEN 'train' ELSE 'test' END AS part FROM contexts JOIN f USING (base, pos), c""")
def split_group_first_date(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_group_first_date(dated(spark, sf), ["base", "pos"], "r_date").select("key", "part")


_GROUP = "g AS (SELECT *, md5(concat('42|', base, '|', pos)) AS h FROM contexts)"


@query("I6", f"WITH {B.CONTEXTS}, {_GROUP} SELECT key, CASE WHEN {U} < 0.2 THEN 'test' ELSE 'train' END AS part FROM g")
def split_groups_random(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_groups_random(dated(spark, sf), ["base", "pos"]).select("key", "part")


@query("I7", f"WITH {B.CONTEXTS}, {_GROUP} SELECT key, CAST(CAST(('0x' || substr(h, 1, 8)) AS BIGINT) % 3 AS INTEGER) AS fold FROM g")
def group_kfold(spark: SparkSession, sf: str) -> DataFrame:
    return splits.group_kfold(dated(spark, sf), ["base", "pos"], 3).select("key", "fold")


@query("I8", f"""WITH {B.CONTEXTS}, {HASHED}, x AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, count(*) OVER (PARTITION BY label) AS n FROM hashed)
SELECT key, label, CASE WHEN rn <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN rn <= floor(n * 0.85::DOUBLE) THEN 'val' ELSE 'test' END AS part FROM x""")
def split_stratified(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_stratified(dated(spark, sf), "label", ["key"]).select("key", "label", "part")


@query("I9", f"WITH {B.CONTEXTS}, {HASHED} SELECT key, CASE WHEN {U} < 0.8 THEN 'train' WHEN {U} < 0.9 THEN 'val' ELSE 'test' END AS part FROM hashed")
def split_random(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_random(dated(spark, sf), ["key"]).select("key", "part")


_FOLD = "CAST(CASE WHEN {i} < {n} - ({n} // 6) * 5 THEN -1 ELSE ({i} - ({n} - ({n} // 6) * 5)) // ({n} // 6) END AS INTEGER) AS fold"


@query("I10", f"WITH {B.CONTEXTS}, x AS (SELECT *, row_number() OVER (ORDER BY r_date, key) - 1 AS i, count(*) OVER () AS n FROM contexts) SELECT key, {_FOLD.format(i='i', n='n')} FROM x")
def expanding_folds_rows(spark: SparkSession, sf: str) -> DataFrame:
    return splits.expanding_folds_rows(dated(spark, sf), ["r_date", "key"]).select("key", "fold")


@query("I10", f"WITH {B.CONTEXTS}, {_DATES} SELECT key, {_FOLD.format(i='i', n='n')} FROM contexts JOIN dd ON r_date = day")
def expanding_folds_dates(spark: SparkSession, sf: str) -> DataFrame:
    return splits.expanding_folds_dates(dated(spark, sf), "r_date").select("key", "fold")
