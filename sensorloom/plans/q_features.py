"""Monthly limits, features, profiles and row windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import clean, features
from sensorloom.operators.features import Limit
from sensorloom.operators.ordered import Series
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query

rnd, r = B.rnd, B.r

LIMITS = [Limit("qty", "p95"), Limit("disc", "p95", True), Limit("price", "sigma"), Limit("tax", "sigma", True)]
MONTH = ["mapped", "year", "month"]
MONTHS = """months AS (SELECT *, CAST(year(d) AS INTEGER) AS year, CAST(month(d) AS INTEGER) AS month FROM readings)"""
LIMITS_SQL = """limits AS (SELECT mapped, year, month, quantile_cont(qty, 0.95) AS limit_qty, quantile_cont(abs(disc), 0.95) AS limit_disc,
 coalesce(avg(price) + 2 * stddev_samp(price), 0) AS limit_price, coalesce(avg(abs(tax)) + 2 * stddev_samp(abs(tax)), 0) AS limit_tax
 FROM months GROUP BY mapped, year, month)"""
SPIKES_SQL = """spikes AS (SELECT mapped, year, month, CAST(sum(CASE WHEN qty > limit_qty + 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS spikes_qty,
 CAST(sum(CASE WHEN abs(disc) > limit_disc + 1e-12 THEN 1 ELSE 0 END) AS BIGINT) AS spikes_disc FROM months JOIN limits USING (mapped, year, month) GROUP BY mapped, year, month)"""


def months(spark, sf):
    return clean.year_month(B.readings(spark, sf), "d")


@query("D3 D4", f"WITH {B.READINGS}, {MONTHS}, {LIMITS_SQL} SELECT mapped, year, month, {r('limit_qty')} AS limit_qty, {r('limit_disc', 6)} AS limit_disc, {r('limit_price')} AS limit_price, {r('limit_tax', 6)} AS limit_tax FROM limits")
def monthly_limits(spark: SparkSession, sf: str) -> DataFrame:
    out = features.monthly_limits(months(spark, sf), MONTH, LIMITS)
    return out.select(*MONTH, rnd("limit_qty").alias("limit_qty"), rnd("limit_disc", 6).alias("limit_disc"),
                      rnd("limit_price").alias("limit_price"), rnd("limit_tax", 6).alias("limit_tax"))


@query("D3", f"WITH {B.READINGS}, {MONTHS} SELECT base, year, month, {r('quantile_cont(qty, 0.95)')} AS limit_qty FROM months GROUP BY base, year, month")
def monthly_p95(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["base", "year", "month"]
    return features.monthly_p95(months(spark, sf), keys, [Limit("qty")]).select(*keys, rnd("limit_qty").alias("limit_qty"))


@query("D4", f"WITH {B.READINGS}, {MONTHS} SELECT base, year, month, {r('coalesce(avg(qty) + 2 * stddev_samp(qty), 0)')} AS limit_qty FROM months GROUP BY base, year, month")
def monthly_two_sigma(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["base", "year", "month"]
    return features.monthly_2sigma(months(spark, sf), keys, [Limit("qty", "sigma")]).select(*keys, rnd("limit_qty").alias("limit_qty"))


@query("C5 D3 D4 D5 B18", f"WITH {B.READINGS}, {MONTHS}, {LIMITS_SQL}, {SPIKES_SQL} SELECT ok, ln, pos, base, d, spikes_qty, spikes_disc, {r('coalesce(qty / nullif(limit_qty, 0), 0)', 6)} AS risk_qty, {r('coalesce(abs(disc) / nullif(limit_disc, 0), 0)', 6)} AS risk_disc, {r('coalesce(price / nullif(limit_price, 0), 0)', 6)} AS risk_price FROM months LEFT JOIN limits USING (mapped, year, month) LEFT JOIN spikes USING (mapped, year, month)")
def risk_and_spikes(spark: SparkSession, sf: str) -> DataFrame:
    rows = months(spark, sf)
    table = features.limits_and_spikes(rows, MONTH, LIMITS, LIMITS[:2])
    out = features.risk_features(features.threshold_join(rows, table, MONTH, ["ok", "ln"]), LIMITS[:3])
    return out.select("ok", "ln", "pos", "base", "d", "spikes_qty", "spikes_disc",
                      *[rnd(f"risk_{c}", 6).alias(f"risk_{c}") for c in ("qty", "disc", "price")])


@query("D5", f"WITH {B.READINGS}, {MONTHS}, {LIMITS_SQL}, {SPIKES_SQL} SELECT * FROM spikes")
def monthly_spikes(spark: SparkSession, sf: str) -> DataFrame:
    table = features.limits_and_spikes(months(spark, sf), MONTH, LIMITS[:2], LIMITS[:2])
    return table.select(*MONTH, "spikes_qty", "spikes_disc")


# As many channels as an asset has, derived from the four: thirteen with a percentile (seven of them on absolute values), the
# others with two deviations; twelve are watched for spikes.
WIDE = [Limit(f"w{k}", "p95" if k < 13 else "sigma", k % 2 == 0) for k in range(29)]
WIDE_SQL = ", ".join(f"qty * {k % 5 + 1} - price / 100 * (disc * {k % 7} + tax * {k % 3 + 1}) - {k * 3} AS w{k}" for k in range(29))


def wide_value(x: Limit) -> str:
    return f"abs({x.channel})" if x.absolute else x.channel


WIDE_LIMITS_SQL = ", ".join(f"quantile_cont({wide_value(x)}, 0.95) AS {x.name}" if x.kind == "p95" else
                            f"coalesce(avg({wide_value(x)}) + 2 * stddev_samp({wide_value(x)}), 0) AS {x.name}" for x in WIDE)
WIDE_COUNTS_SQL = ", ".join(f"CAST(sum(CASE WHEN {wide_value(x)} > {x.name} + 1e-9 THEN 1 ELSE 0 END) AS BIGINT) AS spikes_{x.channel}" for x in WIDE[:12])


@query("D3 D4 D5", f"""WITH {B.READINGS}, {MONTHS}, wide AS (SELECT mapped, year, month, {WIDE_SQL} FROM months),
lim AS (SELECT mapped, year, month, {WIDE_LIMITS_SQL} FROM wide GROUP BY mapped, year, month),
sp AS (SELECT mapped, year, month, {WIDE_COUNTS_SQL} FROM wide JOIN lim USING (mapped, year, month) GROUP BY mapped, year, month)
SELECT mapped, year, month, {", ".join(f"{r(x.name, 2)} AS {x.name}" for x in WIDE)}, {", ".join(f"spikes_w{k}" for k in range(12))}
FROM lim JOIN sp USING (mapped, year, month)""")
def wide_limits_and_spikes(spark: SparkSession, sf: str) -> DataFrame:
    channels = [(F.col("qty") * (k % 5 + 1) - F.col("price") / 100 * (F.col("disc") * (k % 7) + F.col("tax") * (k % 3 + 1)) - k * 3).alias(f"w{k}") for k in range(29)]
    out = features.limits_and_spikes(months(spark, sf).select(*MONTH, *channels), MONTH, WIDE, WIDE[:12])
    return out.withColumns({x.name: rnd(x.name, 2) for x in WIDE})


@query("B19 B20", f"WITH {B.READINGS} SELECT ok, ln, pos, d, {r('disc - tax', 6)} AS disc_tax_diff, {r('qty * disc', 6)} AS qty_x_disc, {r('price * tax')} AS price_x_tax FROM readings")
def differences_and_products(spark: SparkSession, sf: str) -> DataFrame:
    out = features.interactions(features.lr_diff(B.readings(spark, sf), {"disc_tax_diff": ("disc", "tax")}), [("qty", "disc"), ("price", "tax")])
    return out.select("ok", "ln", "pos", "d", rnd("disc_tax_diff", 6).alias("disc_tax_diff"), rnd("qty_x_disc", 6).alias("qty_x_disc"),
                      rnd("price_x_tax").alias("price_x_tax"))


@query("B21 D12", f"""WITH {B.READINGS}, p AS (SELECT base, quantile_cont(qty, 0.95) AS qty, quantile_cont(disc, 0.95) AS disc, coalesce(stddev_samp(qty), 0) AS qty_std,
 coalesce(stddev_samp(disc), 0) AS disc_std, coalesce(max(qty), 0) AS qty_max, coalesce(max(disc), 0) AS disc_max, avg(tax) AS tax FROM readings GROUP BY base)
SELECT base, {r('qty')} AS qty, {r('disc', 6)} AS disc, {r('qty_std')} AS qty_std, {r('tax', 6)} AS tax, {r('qty_max * qty_max + disc_max * disc_max')} AS total_energy,
 {r('greatest(qty, disc) - least(qty, disc)')} AS imbalance, {r('qty_std / (disc_std + 1e-6)')} AS variance_ratio FROM p""")
def mixed_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = features.energy_features(features.mixed_profile(B.readings(spark, sf), ["base"], ["qty", "disc"], ["tax"]), ["qty", "disc"])
    return out.select("base", rnd("qty").alias("qty"), rnd("disc", 6).alias("disc"), rnd("qty_std").alias("qty_std"), rnd("tax", 6).alias("tax"),
                      *[rnd(c).alias(c) for c in ("total_energy", "imbalance", "variance_ratio")])


@query("D9", f"WITH {B.READINGS} SELECT base, min(qty) AS qty_min, max(qty) AS qty_max, {r('stddev_samp(qty)')} AS qty_std, {r('median(qty)')} AS qty_median, min(disc) AS disc_min, max(disc) AS disc_max, {r('stddev_samp(disc)', 6)} AS disc_std, {r('median(disc)', 6)} AS disc_median FROM readings GROUP BY base")
def key_profile(spark: SparkSession, sf: str) -> DataFrame:
    out = features.key_profile(B.readings(spark, sf), ["base"], ["qty", "disc"], ["min", "max", "std", "median"])
    return out.withColumns({"qty_std": rnd("qty_std"), "qty_median": rnd("qty_median"), "disc_std": rnd("disc_std", 6), "disc_median": rnd("disc_median", 6)})


@query("D10", f"WITH {B.DAYS} SELECT section, d, {r('avg(value)')} AS value, {r('avg(label)', 6)} AS label, min(kind) AS kind FROM days GROUP BY section, d")
def mean_or_first(spark: SparkSession, sf: str) -> DataFrame:
    out = features.mean_or_first(B.days(spark, sf), ["section", "d"], ["value", "label"], ["kind"])
    return out.withColumns({"value": rnd("value"), "label": rnd("label", 6)})


@query("D11", f"WITH {B.READINGS} SELECT base, mapped, pos, d, concat(base, '|', pos) AS sample_id, {r('avg(qty)')} AS qty, {r('avg(price)')} AS price FROM readings GROUP BY base, mapped, pos, d")
def sample_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.readings(spark, sf).withColumn("sample_id", F.concat_ws("|", F.col("base").cast("string"), F.col("pos").cast("string")))
    out = features.mean_or_first(rows, ["base", "mapped", "pos", "d", "sample_id"], ["qty", "price"], [])
    return out.withColumns({"qty": rnd("qty"), "price": rnd("price")})


@query("D13", "SELECT l_partkey AS pos, count(*) AS n FROM lineitem GROUP BY 1")
def key_frequency(spark: SparkSession, sf: str) -> DataFrame:
    return features.key_frequency(B.readings(spark, sf), "pos")


@query("D13", f"WITH {B.CONTEXTS} SELECT label, count(*) AS n FROM contexts GROUP BY label")
def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.class_counts(B.contexts(spark, sf), "label")


@query("D14", f"WITH {B.DAYS} SELECT kind, count(DISTINCT section) AS samples, count(DISTINCT CASE WHEN label = 1 THEN section END) AS positives FROM days GROUP BY kind")
def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return features.distinct_counts(B.days(spark, sf), "kind", "section", "label")


# The series: lines of a mapped base in date order; the other columns make the order total.
ORDER = ["d", "ok", "ln", "pos", "base", "qty", "price", "disc", "tax"]
SQL_ORDER = ", ".join(ORDER)
LINES = Series(["mapped"], ORDER)
W = f"PARTITION BY mapped ORDER BY {SQL_ORDER}"
ID = "ok, ln, pos, base, d"


@query("E1", f"WITH {B.READINGS} SELECT {ID}, {r(f'avg(qty) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS qty_avg7, {r(f'avg(qty) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)')} AS qty_avg30 FROM readings")
def trailing_means(spark: SparkSession, sf: str) -> DataFrame:
    out = features.trailing_means(B.readings(spark, sf), LINES, ["qty"])
    return out.select(*ID.split(", "), rnd("qty_avg7").alias("qty_avg7"), rnd("qty_avg30").alias("qty_avg30"))


def _lag_sql(c: str) -> str:
    one = f"coalesce(lag({c}, 1) OVER ({W}), {c})"
    two = f"coalesce(lag({c}, 2) OVER ({W}), {one})"
    return f"{one} AS {c}_lag1, {two} AS {c}_lag2, coalesce(lag({c}, 3) OVER ({W}), {two}) AS {c}_lag3"


@query("E2", f"WITH {B.READINGS} SELECT {ID}, {_lag_sql('qty')}, {_lag_sql('disc')} FROM readings")
def lag_cascade(spark: SparkSession, sf: str) -> DataFrame:
    out = features.lag_cascade(B.readings(spark, sf), LINES, ["qty", "disc"])
    return out.select(*ID.split(", "), *[f"{c}_lag{k}" for c in ("qty", "disc") for k in (1, 2, 3)])


@query("E1 E2", f"""WITH {B.READINGS} SELECT {ID}, {r(f'avg(qty) OVER ({W} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS qty_avg7, {r(f'avg(qty) OVER ({W} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)')} AS qty_avg30,
 {_lag_sql('qty')}, {_lag_sql('disc')}, {_lag_sql('tax')} FROM readings""")
def rolling_and_lags(spark: SparkSession, sf: str) -> DataFrame:
    out = features.rolling_and_lags(B.readings(spark, sf), LINES, ["qty"], ["qty", "disc", "tax"])
    return out.select(*ID.split(", "), rnd("qty_avg7").alias("qty_avg7"), rnd("qty_avg30").alias("qty_avg30"),
                      *[f"{c}_lag{k}" for c in ("qty", "disc", "tax") for k in (1, 2, 3)])


_SHIFT = f"OVER ({W} ROWS BETWEEN {{}} PRECEDING AND 2 PRECEDING)"


@query("E9", f"""WITH {B.READINGS} SELECT {ID}, lag(qty, 1) OVER ({W}) AS qty_lag1, lag(qty, 1) OVER ({W}) - lag(qty, 2) OVER ({W}) AS qty_diff1,
 {r('avg(qty) ' + _SHIFT.format(8))} AS qty_mean_7, {r('stddev_samp(qty) ' + _SHIFT.format(15))} AS qty_std_14,
 max(qty) {_SHIFT.format(8)} AS qty_max_7, min(qty) {_SHIFT.format(31)} AS qty_min_30,
 {r('avg(qty) ' + _SHIFT.format(8) + ' / nullif(avg(qty) ' + _SHIFT.format(31) + ', 0)', 6)} AS qty_7_div_30 FROM readings""")
def shifted_rolling(spark: SparkSession, sf: str) -> DataFrame:
    out = features.shifted_rolling(B.readings(spark, sf), LINES, ["qty"])
    return out.select(*ID.split(", "), "qty_lag1", "qty_diff1", rnd("qty_mean_7").alias("qty_mean_7"), rnd("qty_std_14").alias("qty_std_14"),
                      "qty_max_7", "qty_min_30", rnd("qty_7_div_30", 6).alias("qty_7_div_30"))


@query("E10", f"""WITH {B.CONTEXTS}, x AS (SELECT key, mapped, r_date, last_value(break_date IGNORE NULLS) OVER (PARTITION BY mapped ORDER BY r_date, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_event FROM contexts)
SELECT key, last_event, CAST(r_date - last_event AS INTEGER) AS days_since_event FROM x""")
def last_event_before(spark: SparkSession, sf: str) -> DataFrame:
    out = features.last_event_before(B.contexts(spark, sf), Series(["mapped"], ["r_date", "key"]), "break_date", "r_date")
    return out.select("key", "last_event", "days_since_event")
