"""Sequences, calendars, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.operators import context, scaling, sequences
from sensorloom.operators.ordered import Series
from sensorloom.plans import bindings as B
from sensorloom.plans.registry import query
from sensorloom.session import written

rnd, r = B.rnd, B.r
EW = "PARTITION BY section ORDER BY d, event_id, value, label"
L, K = 30, 5  # steps of a sequence, and of its tail in the summary
# Readings per mapped section: years of days, as windows of a month need.
SERIES = B.READINGS + """, days AS (SELECT (ok * 10 + ln) * 10000000 + pos AS event_id, mapped AS section, d, qty AS value, CAST(flag = 'R' AS INTEGER) AS label FROM readings)"""


def series(spark, sf):
    return B.readings(spark, sf).select(
        ((F.col("ok") * 10 + F.col("ln")) * 10000000 + F.col("pos")).alias("event_id"), F.col("mapped").alias("section"), "d", F.col("qty").alias("value"),
        (F.col("flag") == "R").cast("int").alias("label"))


def order():
    """By day and event, in blocks of a quarter: a few windows long at the density of the smallest tables."""
    return Series(["section"], ["d", "event_id", "value", "label"], F.trunc("d", "quarter"))


def digest(out, keep):
    """One row per window: its length and the sum of its values times their places."""
    total = F.aggregate(F.transform("steps", lambda s, i: s["value"] * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return out.select(*keep, F.size("steps").alias("n_steps"), rnd(total).alias("weighted"))


TRAIL = """daily AS (SELECT base, d, avg(qty) AS qty, avg(disc) AS disc FROM readings GROUP BY base, d),
trail AS (SELECT c.key, c.base, c.r_date, c.label, daily.d, qty, disc FROM contexts c JOIN daily ON c.base = daily.base AND daily.d BETWEEN c.r_date - 30 AND c.r_date)"""
LONG = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d DESC) AS rk, count(*) OVER (PARTITION BY key) AS n FROM trail),
long AS (SELECT k.key, k.base, k.r_date, k.label, CAST(p.p AS INTEGER) AS pos, p.p <= {L} - least(n, {L}) AS is_pad, coalesce(x.qty, 0) AS qty, coalesce(x.disc, 0) AS disc
 FROM (SELECT key, base, r_date, label, max(n) AS n FROM ranked GROUP BY ALL) k CROSS JOIN range(1, {L} + 1) p(p)
 LEFT JOIN (SELECT key, rk, qty, disc FROM ranked) x ON x.key = k.key AND x.rk = {L} + 1 - p.p)"""
SEQ = f"WITH {B.READINGS}, {B.CONTEXTS}, {TRAIL}, {LONG}"
TRAIN = "r_date < DATE '1999-01-01'"
FEATS = ["qty", "disc"]


def trail(spark, sf):
    """Daily means of a section in the 30 days up to each context date."""
    c = B.contexts(spark, sf).select("key", "base", "r_date", "label")
    daily = B.readings(spark, sf).groupBy("base", "d").agg(F.avg("qty").alias("qty"), F.avg("disc").alias("disc"))
    return context.trailing_join(c, daily, ["base"], "r_date", "d")


def padded(spark, sf):
    return sequences.last_n_padded(trail(spark, sf), ["key", "base", "r_date", "label"], "d", "r_date", ["d"], FEATS, L)


def long(spark, sf):
    return sequences.to_long(padded(spark, sf), ["key", "base", "r_date", "label"])


def train_of(df):
    return df.filter(TRAIN)


@query("F1", f"""WITH {SERIES}, x AS (SELECT *, row_number() OVER ({EW}) AS rn, count(*) OVER (PARTITION BY section) AS n,
 max(label) OVER ({EW} ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING) AS future_label FROM days)
SELECT a.event_id, a.future_label, CAST(count(*) AS INTEGER) AS n_steps, {r('sum(b.value * (b.rn - a.rn + 31))')} AS weighted FROM x a JOIN x b ON a.section = b.section AND b.rn BETWEEN a.rn - 30 AND a.rn - 1
WHERE a.rn > 30 AND a.rn <= a.n - 30 GROUP BY a.section, a.rn, a.event_id, a.future_label""")
def sliding_future(spark: SparkSession, sf: str) -> DataFrame:
    return digest(sequences.sliding_future(series(spark, sf), order(), ["value"], "label"), ["event_id", "future_label"])


@query("F2", f"""WITH {SERIES}, x AS (SELECT *, row_number() OVER ({EW}) AS rn FROM days)
SELECT a.event_id, a.label, CAST(count(*) AS INTEGER) AS n_steps, {r('sum(b.value * (b.rn - a.rn + 30))')} AS weighted FROM x a JOIN x b ON a.section = b.section AND b.rn BETWEEN a.rn - 29 AND a.rn WHERE a.rn >= 30
GROUP BY a.section, a.rn, a.event_id, a.label""")
def sliding_last(spark: SparkSession, sf: str) -> DataFrame:
    return digest(sequences.sliding_last(series(spark, sf), order(), ["value"]), ["event_id", "label"])


@query("F3", SEQ + f" SELECT key, base, r_date, label, pos, is_pad, {r('long.qty')} AS qty, {r('long.disc', 6)} AS disc FROM long")
def last_n_padded(spark: SparkSession, sf: str) -> DataFrame:
    return long(spark, sf).withColumns({"qty": rnd("qty"), "disc": rnd("disc", 6)})


@query("E5", f"WITH {SERIES}, x AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY d DESC, event_id DESC) AS rank, count(*) OVER (PARTITION BY section) AS n FROM days) SELECT section, event_id, value, CAST(rank AS INTEGER) AS rank FROM x WHERE rank <= 60 AND n >= 60")
def last_n_exact(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.last_n(series(spark, sf), ["section"], ["d", "event_id"], 60, exact=True).select("section", "event_id", "value", "rank")


DEDUP = "dedup AS (SELECT section, d, value FROM (SELECT *, row_number() OVER (PARTITION BY section, d ORDER BY event_id DESC) AS rn FROM days) WHERE rn = 1)"
CAL = """cal AS (SELECT section, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT section, min(d) AS a, max(d) AS b FROM dedup GROUP BY section)),
filled AS (SELECT c.section, c.d, x.d IS NOT NULL AS observed, coalesce(x.value, m.med) AS value FROM cal c LEFT JOIN dedup x ON c.section = x.section AND c.d = x.d
 JOIN (SELECT section, median(value) AS med FROM dedup GROUP BY section) m ON c.section = m.section)"""
FFILL = """cal AS (SELECT section, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS d FROM (SELECT section, min(d) AS a, max(d) AS b FROM dedup GROUP BY section)),
filled AS (SELECT c.section, c.d, x.d IS NOT NULL AS observed, last_value(x.value IGNORE NULLS) OVER (PARTITION BY c.section ORDER BY c.d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value
 FROM cal c LEFT JOIN dedup x ON c.section = x.section AND c.d = x.d)"""
CALWIN = "numbered AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY d) AS rn, sum(CAST(observed AS INTEGER)) OVER (PARTITION BY section ORDER BY d) AS seen FROM filled)"


@query("E6", f"WITH {SERIES}, {DEDUP} SELECT * FROM dedup")
def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    return sequences.dedup_keep_last(series(spark, sf), ["section"], "d", ["event_id"]).select("section", "d", "value")


def calendar(spark, sf, mode):
    return sequences.calendar_fill(series(spark, sf), ["section"], "d", ["value"], ["event_id"], mode)


@query("F4", f"WITH {SERIES}, {DEDUP}, {CAL} SELECT section, d, observed, {r('value')} AS value FROM filled")
def calendar_fill_median(spark: SparkSession, sf: str) -> DataFrame:
    return calendar(spark, sf, "median").withColumn("value", rnd("value"))


@query("F4", f"WITH {SERIES}, {DEDUP}, {FFILL} SELECT section, d, observed, value FROM filled")
def calendar_fill_forward(spark: SparkSession, sf: str) -> DataFrame:
    return calendar(spark, sf, "ffill")


@query("F4 F5", f"""WITH {SERIES}, {DEDUP}, {CAL}, {CALWIN}
SELECT a.section, a.d, CAST(count(*) AS INTEGER) AS n_steps, {r('sum(b.value * (b.rn - a.rn + 30))')} AS weighted FROM numbered a JOIN numbered b ON a.section = b.section AND b.rn BETWEEN a.rn - 29 AND a.rn
WHERE a.observed AND a.rn >= 30 GROUP BY a.section, a.d""")
def calendar_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.calendar_windows(calendar(spark, sf, "median"), ["section"], "d", ["value"])
    return digest(out, ["section", "d"])


# Anchors and places are materialised first: the join is then on equal (section, rn), whatever plan the engine picks.
@query("F4 F6", f"""WITH {SERIES}, {DEDUP}, {FFILL}, {CALWIN.replace("numbered AS (", "numbered AS MATERIALIZED (")},
places AS MATERIALIZED (SELECT section, d AS day, CAST(p AS INTEGER) AS pos, CAST(greatest(1, rn - 30 + p) AS BIGINT) AS rn FROM numbered, range(1, 31) t(p) WHERE observed AND (seen - 1) % 7 = 0)
SELECT a.section, a.day AS d, a.pos, b.value FROM places a JOIN numbered b ON a.section = b.section AND a.rn = b.rn""")
def anchored_windows(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.anchored_windows(calendar(spark, sf, "ffill"), ["section"], "d", ["value"])
    return sequences.explode_steps(out, ["section", "d"])


@query("F6", f"""WITH {SERIES}, {DEDUP}, {FFILL}, {CALWIN}, anchors AS (SELECT * FROM numbered WHERE (rn - 1) % 7 = 0)
SELECT a.section, a.d, CAST(count(*) AS INTEGER) AS n_steps, {r('sum(b.value * p)')} AS weighted FROM anchors a CROSS JOIN range(1, 31) t(p) JOIN numbered b ON a.section = b.section AND b.rn = greatest(1, a.rn - 30 + p)
GROUP BY a.section, a.d""")
def anchored_windows_calendar(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.anchored_windows(calendar(spark, sf, "ffill"), ["section"], "d", ["value"], on="calendar")
    return digest(out, ["section", "d"])


@query("F7", f"""WITH {B.READINGS}, {B.CONTEXTS}, {TRAIL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY d DESC) AS rk, count(*) OVER (PARTITION BY key) AS n FROM trail),
k AS (SELECT key, least(max(n), {L}) AS n FROM ranked GROUP BY key)
SELECT k.key, CAST(p AS INTEGER) AS pos, p > k.n AS is_pad, {r('qty')} AS qty FROM k CROSS JOIN range(1, {L} + 1) t(p) JOIN ranked ON ranked.key = k.key AND rk = greatest(k.n - p + 1, 1)""")
def tail_padded(spark: SparkSession, sf: str) -> DataFrame:
    padded = sequences.last_n_padded(trail(spark, sf), ["key"], "d", None, ["d"], ["qty"], L, pad="edge", side="right")
    return sequences.to_long(padded, ["key"]).withColumn("qty", rnd("qty"))


@query("F8", SEQ + f""", m AS (SELECT median(qty) AS mq, median(disc) AS md FROM long WHERE {TRAIN} AND NOT is_pad)
SELECT key, pos, is_pad, {r('CASE WHEN is_pad THEN mq ELSE qty END')} AS qty, {r('CASE WHEN is_pad THEN md ELSE disc END', 6)} AS disc FROM long, m""")
def impute_pad(spark: SparkSession, sf: str) -> DataFrame:
    df = sequences.to_long(written(padded(spark, sf), "sequences"), ["key", "base", "r_date", "label"])  # read by the medians and the fill
    out = sequences.impute_pad(df, sequences.pad_medians(train_of(df), FEATS), FEATS)
    return out.select("key", "pos", "is_pad", rnd("qty").alias("qty"), rnd("disc", 6).alias("disc"))


_SUM = f"""summary AS (SELECT key, label, r_date, count(*) FILTER (NOT is_pad) AS real_count, avg(qty) FILTER (NOT is_pad) AS qty_mean, stddev_pop(qty) FILTER (NOT is_pad) AS qty_std,
 min(qty) FILTER (NOT is_pad) AS qty_min, max(qty) FILTER (NOT is_pad) AS qty_max, coalesce(regr_slope(qty, pos) FILTER (NOT is_pad), 0) AS qty_trend,
 max(CASE WHEN pos = {L} THEN qty END) AS qty_last, list(qty ORDER BY pos) FILTER (NOT is_pad AND pos > {L} - {K}) AS tail FROM long GROUP BY key, label, r_date)"""


@query("F9", SEQ + f""", {_SUM} SELECT key, {", ".join(f"{r(f'coalesce(tail[{i}], 0)')} AS qty_last{i}of{K}" for i in range(1, K + 1))}, {r('summary.qty_last')} AS qty_last,
 {r('qty_mean')} AS qty_mean, {r('qty_std')} AS qty_std, {r('summary.qty_min')} AS qty_min, {r('summary.qty_max')} AS qty_max, {r('CASE WHEN isnan(qty_trend) THEN 0 ELSE qty_trend END')} AS qty_trend, {r(f'real_count / {L}.0::DOUBLE', 6)} AS real_fraction, real_count FROM summary""")
def sequence_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.sequence_summary(long(spark, sf), ["key"], ["qty"], L, K)
    return out.select("key", *[rnd(c).alias(c) for c in out.columns if c.startswith("qty_")], rnd("real_fraction", 6).alias("real_fraction"), "real_count")


@query("F11 B17", f"""WITH {B.READINGS}, q AS (SELECT quantile_cont(price, 0.005) AS lo, quantile_cont(price, 0.995) AS hi FROM readings WHERE d < DATE '1999-01-01')
SELECT ok, ln, pos, d, {r('greatest(lo, least(hi, price))')} AS price FROM readings, q""")
def quantile_clip(spark: SparkSession, sf: str) -> DataFrame:
    df = B.readings(spark, sf).select("ok", "ln", "pos", "d", "price")
    limits = sequences.quantile_limits(df.filter("d < DATE '1999-01-01'"), ["price"])
    return sequences.quantile_clip(df, limits, ["price"], skip_equal=True).withColumn("price", rnd("price"))


@query("F12", SEQ + " SELECT key, " + ", ".join(f"{r(f'max(qty) FILTER (pos = {i})')} AS t{i}_qty, {r(f'max(disc) FILTER (pos = {i})', 6)} AS t{i}_disc" for i in range(1, L + 1)) + " FROM long GROUP BY key")
def flatten(spark: SparkSession, sf: str) -> DataFrame:
    out = sequences.flatten(padded(spark, sf), ["key"], FEATS, L)
    return out.select("key", *[rnd(c, 6 if c.endswith("disc") else 4).alias(c) for c in out.columns[1:]])


ROWS = "ok, ln, pos, d"
EARLY = "d < DATE '1999-01-01' AND base % 10 <> 3"


def rows(spark, sf):
    df = B.readings(spark, sf).select("ok", "ln", "pos", "d", "base", "qty", "price")
    return df, df.filter(EARLY)


def scaled(df):
    return df.select("ok", "ln", "pos", "d", rnd("qty", 6).alias("qty"), rnd("price", 6).alias("price"))


@query("G1", f"WITH {B.READINGS}, p AS (SELECT avg(qty) AS cq, stddev_pop(qty) AS sq, avg(price) AS cp, stddev_pop(price) AS sp FROM readings WHERE {EARLY}) SELECT {ROWS}, {r('(qty - cq) / sq', 6)} AS qty, {r('(price - cp) / sp', 6)} AS price FROM readings, p")
def standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    df, train = rows(spark, sf)
    return scaled(scaling.standard_scale(df, train, ["qty", "price"]))


def _q(c: str) -> str:
    return f"quantile_cont({c}, 0.5) AS c_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS s_{c}"


@query("G2 G6", f"WITH {B.READINGS}, p AS (SELECT {_q('qty')}, {_q('price')} FROM readings WHERE {EARLY}) SELECT {ROWS}, {r('(qty - c_qty) / s_qty', 6)} AS qty, {r('(price - c_price) / s_price', 6)} AS price FROM readings, p")
def robust_scale(spark: SparkSession, sf: str) -> DataFrame:
    df, train = rows(spark, sf)
    return scaled(scaling.robust_scale(df, train, ["qty", "price"]))


@query("G2 C12", f"""WITH {B.READINGS}, g AS (SELECT {_q('qty')}, {_q('price')} FROM readings WHERE {EARLY}), b AS (SELECT base, {_q('qty')}, {_q('price')} FROM readings WHERE {EARLY} GROUP BY base)
SELECT {ROWS}, {r('(qty - coalesce(b.c_qty, g.c_qty)) / coalesce(b.s_qty, g.s_qty)', 6)} AS qty, {r('(price - coalesce(b.c_price, g.c_price)) / coalesce(b.s_price, g.s_price)', 6)} AS price FROM readings LEFT JOIN b USING (base), g""")
def robust_scale_per_base(spark: SparkSession, sf: str) -> DataFrame:
    df, train = rows(spark, sf)
    return scaled(scaling.robust_scale_by(df, train, ["base"], ["qty", "price"]))


@query("G3 C12", f"""WITH {B.READINGS}, g AS (SELECT avg(qty) AS cq, stddev_pop(qty) AS sq, avg(price) AS cp, stddev_pop(price) AS sp FROM readings WHERE {EARLY}),
b AS (SELECT base, avg(qty) AS cq, stddev_pop(qty) AS sq, avg(price) AS cp, stddev_pop(price) AS sp FROM readings WHERE {EARLY} GROUP BY base)
SELECT {ROWS}, {r('(qty - coalesce(b.cq, g.cq)) / coalesce(b.sq, g.sq)', 6)} AS qty, {r('(price - coalesce(b.cp, g.cp)) / coalesce(b.sp, g.sp)', 6)} AS price FROM readings LEFT JOIN b USING (base), g""")
def standard_scale_per_base(spark: SparkSession, sf: str) -> DataFrame:
    df, train = rows(spark, sf)
    return scaled(scaling.standard_scale_by(df, train, ["base"], ["qty", "price"]))


@query("G4", f"""WITH {B.READINGS}, p AS (SELECT avg(qty) AS cq, stddev_pop(qty) + 1e-6 AS sq, avg(disc) AS cd, stddev_pop(disc) + 1e-6 AS sd FROM readings WHERE {EARLY})
SELECT {ROWS}, {r('CASE WHEN sq > 10 OR abs(cq) > 10 THEN (qty - cq) / sq ELSE qty END', 6)} AS qty, {r('CASE WHEN sd > 10 OR abs(cd) > 10 THEN (disc - cd) / sd ELSE disc END', 6)} AS disc FROM readings, p""")
def conditional_standardise(spark: SparkSession, sf: str) -> DataFrame:
    df = B.readings(spark, sf).select("ok", "ln", "pos", "d", "base", "qty", "disc")
    out = scaling.conditional_standardise(df, df.filter(EARLY), ["qty", "disc"])
    return out.select("ok", "ln", "pos", "d", rnd("qty", 6).alias("qty"), rnd("disc", 6).alias("disc"))


@query("G5", f"WITH {B.READINGS}, m AS (SELECT median(nullif(disc, 0)) AS m FROM readings WHERE {EARLY}) SELECT {ROWS}, {r('coalesce(nullif(disc, 0), m)', 6)} AS disc FROM readings, m")
def median_impute(spark: SparkSession, sf: str) -> DataFrame:
    df = B.readings(spark, sf).select("ok", "ln", "pos", "d", "base", F.nullif("disc", F.lit(0.0)).alias("disc"))
    return scaling.median_impute(df, df.filter(EARLY), ["disc"]).select("ok", "ln", "pos", "d", rnd("disc", 6).alias("disc"))
