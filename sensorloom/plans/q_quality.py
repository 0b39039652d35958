"""Data-quality and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import quality
from sensorloom.operators.ordered import EVEN, Series
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query

rnd, r = B.rnd, B.r
CH = list(B.CHANNELS)
GAPPY = f"WITH {B.READINGS}, g AS (SELECT ok, ln, pos, base, d, qty, price, nullif(disc, 0) AS disc, CASE WHEN disc = 0 THEN NULL WHEN tax = 0.04 THEN NULL ELSE tax END AS tax, CASE WHEN flag = 'R' THEN 1 ELSE 0 END AS label FROM readings)"


def gappy(spark, sf):
    df = B.readings(spark, sf)
    return df.select("ok", "ln", "pos", "base", "d", "qty", "price", F.nullif("disc", F.lit(0.0)).alias("disc"),
                     F.when((F.col("disc") != 0) & (F.col("tax") != 0.04), F.col("tax")).alias("tax"),
                     (F.col("flag") == "R").cast("int").alias("label"))


_MISS = "CASE WHEN disc IS NULL THEN 1 ELSE 0 END + CASE WHEN tax IS NULL THEN 1 ELSE 0 END"


@query("M1", GAPPY + f""", k AS (SELECT *, count(*) AS n FROM (SELECT pos, qty, disc, tax, label FROM g) GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS n_rows, 5 AS n_columns, CAST(sum(n * ({_MISS})) AS BIGINT) AS missing_cells, {r(f'100.0::DOUBLE * sum(n * ({_MISS})) / (sum(n) * 5)')} AS missing_pct,
 CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r('100.0::DOUBLE * sum(n - 1) / sum(n)')} AS duplicate_pct, 'bigint: 1, double: 3, int: 1' AS type_counts FROM k""")
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.quality_report(gappy(spark, sf).select("pos", "qty", "disc", "tax", "label"))
    return out.withColumns({"missing_pct": rnd("missing_pct"), "duplicate_pct": rnd("duplicate_pct")})


@query("M2 M5", GAPPY + f""", u AS (SELECT 'disc' AS "column", count(*) FILTER (disc IS NULL) AS missing, count(*) AS n FROM g UNION ALL SELECT 'tax', count(*) FILTER (tax IS NULL), count(*) FROM g)
SELECT "column", missing, {r('100.0::DOUBLE * missing / n')} AS missing_pct, CASE WHEN 100.0 * missing / n > 50 THEN 'high' WHEN 100.0 * missing / n > 20 THEN 'moderate' WHEN 100.0 * missing / n > 5 THEN 'low' ELSE 'minimal' END AS level FROM u WHERE missing > 0""")
def missing_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.missing_summary(gappy(spark, sf)).withColumn("missing_pct", rnd("missing_pct"))


@query("M3", GAPPY + f""", c AS (SELECT count(*) FILTER (disc IS NULL)::DOUBLE AS d, count(*) FILTER (tax IS NULL)::DOUBLE AS t, count(*) FILTER (disc IS NULL AND tax IS NULL)::DOUBLE AS b FROM g)
SELECT * FROM (SELECT 'disc' AS "column", 'tax' AS other, {r('b / d', 6)} AS share FROM c UNION ALL SELECT 'tax', 'disc', {r('b / t', 6)} FROM c) WHERE share > 0.3""")
def co_missing(spark: SparkSession, sf: str) -> DataFrame:
    return quality.co_missing(gappy(spark, sf), ["qty", "disc", "tax"]).withColumn("share", rnd("share", 6))


@query("M6", f"WITH k AS (SELECT l_suppkey, l_quantity, l_discount, count(*) AS n FROM lineitem GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, {r('100.0::DOUBLE * sum(n - 1) / sum(n)')} AS duplicate_pct FROM k")
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    df = B.raw_readings(spark, sf).select("l_suppkey", "l_quantity", "l_discount")
    return quality.exact_duplicates(df).withColumn("duplicate_pct", rnd("duplicate_pct"))


@query("M7", "WITH k AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) SELECT count(*) AS duplicate_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows_in_them FROM k")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return quality.key_duplicates(B.raw_readings(spark, sf), ["l_orderkey", "l_linenumber"])


@query("M8 M5", f"""WITH {B.CONTEXTS}, y AS (SELECT CASE WHEN key % 13 = 0 THEN NULL WHEN key % 4 = 0 THEN label ELSE 0 END AS y FROM contexts), c AS (SELECT y, count(*) AS n FROM y GROUP BY y),
s AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (y IS NULL), 0) AS BIGINT) AS missing, count(*) FILTER (y IS NOT NULL) AS classes, max(n) FILTER (y IS NOT NULL) AS largest, min(n) FILTER (y IS NOT NULL) AS smallest FROM c)
SELECT *, {r('100.0::DOUBLE * missing / n_rows')} AS missing_pct, CASE WHEN 100.0 * missing / n_rows > 20 THEN 'critical' WHEN 100.0 * missing / n_rows > 10 THEN 'high' WHEN 100.0 * missing / n_rows > 5 THEN 'moderate' ELSE 'low' END AS level,
 {r('largest::DOUBLE / smallest', 6)} AS class_ratio, CASE WHEN largest / smallest::DOUBLE > 10 THEN 'severe' WHEN largest / smallest::DOUBLE > 5 THEN 'imbalanced' ELSE 'balanced' END AS balance FROM s""")
def target_quality(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("key")
    y = F.when(k % 13 == 0, F.lit(None)).when(k % 4 == 0, F.col("label")).otherwise(0).cast("int")
    out = quality.target_quality(B.contexts(spark, sf).select(y.alias("y")), "y")
    return out.withColumns({"missing_pct": rnd("missing_pct"), "class_ratio": rnd("class_ratio", 6)})


def _per_channel(select: str) -> str:
    return " UNION ALL ".join(select.replace("{c}", c) for c in CH)


@query("M9 M5", GAPPY + ", s AS (" + _per_channel("SELECT '{c}' AS channel, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS pct, var_samp({c}) AS v FROM g") + f") SELECT channel, {r('pct')} AS missing_pct, {r('v')} AS variance, CASE WHEN pct > 30 THEN 'critical' WHEN pct > 15 THEN 'high' WHEN pct > 5 THEN 'moderate' ELSE 'low' END AS level FROM s".replace(r("v"), "round(v, 2)"))
def feature_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.feature_quality(gappy(spark, sf), CH).select("channel", rnd("missing_pct").alias("missing_pct"), F.round("variance", 2).alias("variance"), "level")


@query("M10", GAPPY + ", s AS (" + _per_channel("SELECT '{c}' AS channel, avg({c}) AS m, stddev_samp({c}) AS s, min({c}) AS min, max({c}) AS max, var_samp({c}) AS v FROM g") + f") SELECT channel, {r('m')} AS mean, {r('s')} AS std, min, max, round(v, 2) AS variance FROM s ORDER BY v DESC LIMIT 3")
def top_variance(spark: SparkSession, sf: str) -> DataFrame:
    return quality.top_variance(gappy(spark, sf), CH, 3).select("channel", rnd("mean").alias("mean"), rnd("std").alias("std"), "min", "max", F.round("variance", 2).alias("variance"))


@query("M11", f"""WITH {B.READINGS}, q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM readings WHERE qty > 0), v AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
o AS (SELECT q1, q3, count(*) FILTER (value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)) AS o, count(*) AS n FROM events, v GROUP BY q1, q3)
SELECT 'value' AS channel, {r('q1')} AS q1, {r('q3')} AS q3, {r('q3 - q1')} AS iqr, {r('q1 - 1.5::DOUBLE * (q3 - q1)')} AS lower, {r('q3 + 1.5::DOUBLE * (q3 - q1)')} AS upper, o AS outliers, {r('100.0::DOUBLE * o / n')} AS outlier_pct FROM o""")
def iqr_outliers(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.iqr_outliers(B.days(spark, sf), ["value"])
    return out.select("channel", *[rnd(c).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")], "outliers", rnd("outlier_pct").alias("outlier_pct"))


def _two(c: str) -> str:
    return f"""SELECT '{c}' AS channel, count({c}) FILTER (label = 0) AS n0, count({c}) FILTER (label = 1) AS n1, avg({c}) FILTER (label = 1) AS m1, avg({c}) FILTER (label = 0) AS m0,
 var_samp({c}) FILTER (label = 1) AS v1, var_samp({c}) FILTER (label = 0) AS v0, avg(abs({c} - (CASE WHEN label = 1 THEN med1 ELSE med0 END))) FILTER (label = 1) AS zm1, avg(abs({c} - (CASE WHEN label = 1 THEN med1 ELSE med0 END))) FILTER (label = 0) AS zm0,
 var_samp(abs({c} - med1)) FILTER (label = 1) AS zv1, var_samp(abs({c} - med0)) FILTER (label = 0) AS zv0 FROM g, (SELECT median({c}) FILTER (label = 1) AS med1, median({c}) FILTER (label = 0) AS med0 FROM g)"""


_TWO = GAPPY + ", s AS (" + " UNION ALL ".join(_two(c) for c in ("qty", "disc", "tax")) + """), p AS (SELECT *, m1 - m0 AS gap, v1 / n1 AS a, v0 / n0 AS b, ((n1 - 1) * v1 + (n0 - 1) * v0) / (n0 + n1 - 2) AS sp,
 ((n1 - 1) * zv1 + (n0 - 1) * zv0) / (n0 + n1 - 2) AS zsp, (n1 * m1 + n0 * m0) / (n0 + n1) AS gm, (n1 * zm1 + n0 * zm0) / (n0 + n1) AS zgm FROM s)"""


@query("M12", _TWO + f""" SELECT channel, n0, n1, {r('m1', 6)} AS mean1, {r('m0', 6)} AS mean0, {r('gap', 6)} AS difference, {r('sqrt(v1)', 6)} AS std1, {r('sqrt(v0)', 6)} AS std0, {r('gap / sqrt(sp * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0))', 6)} AS t_pooled,
 {r('gap / sqrt(a + b)', 6)} AS t_welch, {r('(a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1))')} AS welch_df, {r('(n1 * (m1 - gm) ** 2 + n0 * (m0 - gm) ** 2) / sp', 6)} AS anova_f, {r('(n1 * (zm1 - zgm) ** 2 + n0 * (zm0 - zgm) ** 2) / zsp', 6)} AS levene_w,
 {r('gap / sqrt(sp)', 6)} AS effect_size, {r('v1 / v0', 6)} AS variance_ratio, CASE WHEN abs(gap / sqrt(sp)) > 0.8 THEN 'Large' WHEN abs(gap / sqrt(sp)) > 0.5 THEN 'Medium' ELSE 'Small' END AS effect FROM p""")
def two_group_test(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.two_group_test(gappy(spark, sf), ["qty", "disc", "tax"], "label", p_values=False)
    return out.select("channel", "n0", "n1", *[rnd(c, 4 if c == "welch_df" else 6).alias(c) for c in out.columns[3:-1]], "effect")


def _two_sided(cases: str) -> str:
    """Two-sided p-values by Simpson's rule over the t density; ``cases`` has channel, name, t and v (degrees of freedom)."""
    density = "exp(lgamma((v + 1) / 2) - lgamma(v / 2) - 0.5::DOUBLE * ln(v * pi()) - (v + 1) / 2 * ln(1 + (t * i / 4000) ** 2 / v))"
    return f"""cases AS ({cases}), pv AS (SELECT channel, name, greatest(0, 1 - 2 * any_value(t) / 12000 * sum(CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * {density})) AS p
 FROM cases, range(0, 4001) k(i) GROUP BY channel, name)"""


# An F statistic with one degree of freedom above is the square of a t.
_P_CASES = " UNION ALL ".join(f"SELECT channel, '{name}' AS name, {t} AS t, {v}::DOUBLE AS v FROM p" for name, t, v in (
    ("pooled", "abs(gap) / sqrt(sp * (1.0::DOUBLE / n1 + 1.0::DOUBLE / n0))", "(n0 + n1 - 2)"),
    ("welch", "abs(gap) / sqrt(a + b)", "((a + b) * (a + b) / (a * a / (n1 - 1) + b * b / (n0 - 1)))"),
    ("anova", "sqrt((n1 * (m1 - gm) ** 2 + n0 * (m0 - gm) ** 2) / sp)", "(n0 + n1 - 2)"),
    ("levene", "sqrt((n1 * (zm1 - zgm) ** 2 + n0 * (zm0 - zgm) ** 2) / zsp)", "(n0 + n1 - 2)")))
P_NAMES = ("pooled", "welch", "anova", "levene")


@query("M12", _TWO + ", " + _two_sided(_P_CASES) + " SELECT channel, " + ", ".join(f"round(max(p) FILTER (name = '{n}') + 3e-9, 5) AS {n}_p" for n in P_NAMES) + " FROM pv GROUP BY channel")
def two_group_p_values(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.two_group_test(gappy(spark, sf), ["qty", "disc", "tax"], "label")
    return out.select("channel", *[rnd(f"{n}_p", 5).alias(f"{n}_p") for n in P_NAMES])


_PAIRS = [(a, b) for i, a in enumerate(CH) for b in CH[i + 1:]]
_CORR = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r(f'corr({a}, {b})', 6)} AS r FROM g" for a, b in _PAIRS)


@query("M13", GAPPY + _CORR)
def correlation_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return quality.correlation_matrix(gappy(spark, sf), CH).withColumn("r", rnd("r", 6))


@query("M13", GAPPY + " " + " UNION ALL ".join(f"""SELECT '{a}' AS a, '{b}' AS b, {r('corr(rx, ry)', 6)} AS rho FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2.0::DOUBLE AS ry FROM g WHERE {a} IS NOT NULL AND {b} IS NOT NULL)""" for a, b in [("qty", "price"), ("disc", "tax")]))
def spearman(spark: SparkSession, sf: str) -> DataFrame:
    return quality.spearman(gappy(spark, sf), [("qty", "price"), ("disc", "tax")]).withColumn("rho", rnd("rho", 6))


MADE = GAPPY + ", m AS (SELECT *, 2 * qty + disc AS twice, -qty + 20 * tax AS minus FROM g WHERE disc IS NOT NULL AND tax IS NOT NULL)"
_MP = [("qty", "price"), ("qty", "twice"), ("qty", "minus"), ("price", "twice"), ("price", "minus"), ("twice", "minus")]
_MADE = ", c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM m" for a, b in _MP) + ")"


def made(spark, sf):
    df = gappy(spark, sf).withColumns({"twice": 2 * F.col("qty") + F.col("disc"), "minus": -F.col("qty") + 20 * F.col("tax")}).dropna()
    return quality.correlated_pairs(quality.correlation_matrix(df, ["qty", "price", "twice", "minus"], complete=True), 0.7)


@query("M14", MADE + _MADE + f" SELECT a, b, {r('r', 6)} AS r, CASE WHEN abs(c.r) > 0.9 THEN 'Very Strong' ELSE 'Strong' END AS strength, CASE WHEN c.r > 0 THEN 'Positive' ELSE 'Negative' END AS direction FROM c WHERE abs(c.r) > 0.7")
def correlated_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return made(spark, sf).withColumn("r", rnd("r", 6))


@query("M14", MADE + _MADE + """, p AS (SELECT CASE WHEN abs(r) > 0.9 THEN 'Very Strong' ELSE 'Strong' END AS strength, unnest([a, b]) AS m FROM c WHERE abs(r) > 0.7)
SELECT strength, string_agg(m, ', ' ORDER BY m) AS members FROM (SELECT DISTINCT strength, m FROM p) GROUP BY strength""")
def correlation_groups(spark: SparkSession, sf: str) -> DataFrame:
    return quality.correlation_groups(made(spark, sf))


def _trend(c: str, x: str) -> str:
    return f"SELECT '{c}' AS channel, round(regr_slope({c}, {x}), 9) AS slope, round(regr_r2({c}, {x}), 9) AS r2, CAST(regr_count({c}, {x}) AS BIGINT) AS n FROM g"


@query("M15", GAPPY + " " + " UNION ALL ".join(_trend(c, "(d - DATE '1970-01-01')") for c in ("qty", "disc")))
def day_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.linear_trend(gappy(spark, sf), ["qty", "disc"], F.datediff("d", F.lit("1970-01-01").cast("date")), p_values=False)
    return out.withColumns({"slope": F.round("slope", 9), "r2": F.round("r2", 9)})


@query("M15", GAPPY + " " + " UNION ALL ".join(_trend(c, "pos") for c in ("qty", "disc")))
def position_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.linear_trend(gappy(spark, sf), ["qty", "disc"], F.col("pos"), p_values=False)
    return out.withColumns({"slope": F.round("slope", 9), "r2": F.round("r2", 9)})


ORDER = ["d", "ok", "ln", "pos", "base", "qty", "price"]


@query("M15", GAPPY + f", x AS (SELECT disc, row_number() OVER (ORDER BY {', '.join(ORDER)}) - 1 AS i FROM g WHERE disc IS NOT NULL) SELECT 'disc' AS channel, round(regr_slope(disc, i), 12) AS slope, round(regr_r2(disc, i), 9) AS r2, CAST(regr_count(disc, i) AS BIGINT) AS n FROM x")
def index_trend(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.index_trend(gappy(spark, sf), "disc", ORDER, p_values=False)
    return out.withColumns({"slope": F.round("slope", 12), "r2": F.round("r2", 9)})


_TREND_CASES = " UNION ALL ".join(f"SELECT '{c}' AS channel, 'trend' AS name, sqrt(regr_r2({c}, pos) * (regr_count({c}, pos) - 2) / (1 - regr_r2({c}, pos))) AS t, (regr_count({c}, pos) - 2)::DOUBLE AS v FROM g" for c in ("qty", "disc"))


@query("M15", GAPPY + ", " + _two_sided(_TREND_CASES) + " SELECT channel, round(p + 3e-9, 5) AS p_value FROM pv")
def trend_p_values(spark: SparkSession, sf: str) -> DataFrame:
    return quality.linear_trend(gappy(spark, sf), ["qty", "disc"], F.col("pos")).select("channel", rnd("p_value", 5).alias("p_value"))


@query("M16", f"WITH {B.CONTEXTS} SELECT count(*) AS n, count(*) FILTER (label = 1) AS positives, {r('avg(label)', 6)} AS rate, min(r_date) AS first, max(r_date) AS last FROM contexts")
def break_rate(spark: SparkSession, sf: str) -> DataFrame:
    return quality.break_rate(B.contexts(spark, sf), "label", "r_date").withColumn("rate", rnd("rate", 6))


NULLED = "n AS (SELECT event_id, ts, user_id, CASE WHEN event_type <> 'error' THEN value END AS value, CASE WHEN event_id % 7 >= 3 THEN props END AS props FROM events)"


def nulled(spark, sf):
    return B.table(spark, sf, "events").select(
        "event_id", "ts", "user_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"),
        F.when(F.col("event_id") % 7 >= 3, F.col("props")).alias("props"))


def _runs(c: str, part: str = "") -> str:
    return f"SELECT {part}'{c}' AS col, k, count(*) AS len FROM (SELECT *, row_number() OVER ({{w}}) - row_number() OVER ({{v}}) AS k FROM n) WHERE {c} IS NULL GROUP BY ALL".format(
        w="ORDER BY ts, event_id", v=f"PARTITION BY {c} IS NULL ORDER BY ts, event_id")


@query("E7 M5", f"WITH {NULLED}, i AS ({_runs('value')} UNION ALL {_runs('props')}) SELECT col AS \"column\", max(len) AS max_run, count(*) AS runs, {r('avg(len)', 6)} AS avg_run, CASE WHEN max(len) > 100 THEN 'systematic' WHEN max(len) > 10 THEN 'clustered' ELSE 'scattered' END AS level FROM i GROUP BY col")
def missing_runs(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.missing_runs(nulled(spark, sf), ["value", "props"], Series([], ["ts", "event_id"], EVEN))
    return out.withColumn("avg_run", rnd("avg_run", 6))


def _gaps(c: str) -> str:
    return f"""SELECT '{c}' AS "column", min(gap) AS min_gap, max(gap) AS max_gap, {r('avg(gap)')} AS avg_gap, CAST(min(ts) AS DATE) AS first, CAST(max(ts) AS DATE) AS last, count(*) AS n
 FROM (SELECT ts, (epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id))) / 1e6::DOUBLE AS gap FROM n WHERE {c} IS NULL)"""


@query("E8", f"WITH {NULLED} {_gaps('value')} UNION ALL {_gaps('props')}")
def missing_gaps(spark: SparkSession, sf: str) -> DataFrame:
    out = quality.missing_gaps(nulled(spark, sf), ["value", "props"], "ts", ["event_id"])
    return out.withColumns({"avg_gap": rnd("avg_gap"), "first": F.to_date("first"), "last": F.to_date("last")})


@query("D18", f"WITH {B.CONTEXTS} SELECT base, count(pos) AS n, min(pos) AS min_pos, max(pos) AS max_pos, CAST(sum(label) AS BIGINT) AS positives FROM contexts GROUP BY base")
def location_summary(spark: SparkSession, sf: str) -> DataFrame:
    return quality.location_summary(B.contexts(spark, sf), "base", "pos", "label")


@query("D19", f"""WITH l AS (SELECT min(value) AS lo, max(value) AS hi FROM events), c AS (SELECT least(CAST(floor((value - lo) / ((hi - lo) / 50.0::DOUBLE)) AS BIGINT), 49) AS bin, count(*) AS n FROM events, l GROUP BY 1)
SELECT CAST(j AS BIGINT) AS bin, {r('lo + j * ((hi - lo) / 50.0::DOUBLE)')} AS "left", coalesce(n, 0) AS n FROM range(50) g(j) LEFT JOIN c ON j = bin, l""")
def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return quality.histogram(B.days(spark, sf), "value").withColumn("left", rnd("left"))
