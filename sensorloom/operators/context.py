"""Context assembly: lookups, band joins and interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.clean import trim_to_bounds
from sensorloom.operators.ordered import Series, running, salted_join, with_scalar
from sensorloom.roles import Roles

EPOCH = "1970-01-01"


def lookup_join(df: DataFrame, lookup: DataFrame, on: str) -> DataFrame:
    """Left equi-join to a lookup table. Spark broadcasts it while its size is below the
    session's broadcast threshold and shuffles beyond it."""
    return df.join(lookup, on, "left")


def bin_readings(readings: DataFrame, roles: Roles, keys: Sequence[str]) -> DataFrame:
    """Channel means and row count per bin."""
    return readings.groupBy(*keys).agg(
        *[F.avg(c).alias(c) for c in roles.channels], F.count(F.lit(1)).alias("rows_in_bin"))


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit(EPOCH).cast("date"))


def band_join_plain(contexts: DataFrame, readings: DataFrame, roles: Roles) -> DataFrame:
    """Inner join on the effective base with date and position ranges as residual.

    Every context of a base meets every reading of that base: right for small tables, and the
    yardstick for ``band_join``.
    """
    c = contexts.withColumn("__eff", F.coalesce(F.col(roles.mapped), F.col(roles.base))).alias("c")
    r = readings.select(*[F.col(x).alias(f"r_{x}") for x in readings.columns],
                        F.coalesce(F.col(roles.mapped), F.col(roles.base)).alias("r___eff"))
    cond = ((F.col("__eff") == F.col("r___eff"))
            & F.col(f"r_{roles.date}").between(F.col("win_start"), F.col("win_end"))
            & F.col(f"r_{roles.position}").between(F.col("pos_start"), F.col("pos_end")))
    return c.join(r, cond).drop("__eff", "r___eff")


def band_join(contexts: DataFrame, readings: DataFrame, roles: Roles, width: float, days: int = 31,
              how: str = "inner") -> DataFrame:
    """The band join as an equi-join on (effective base, position cell, date cell).

    A reading lies in exactly one cell. A context is copied to the cells its window touches:
    at most two position cells of one window width and, for a window of ``days`` days, two
    date cells. The ranges are checked again on the joined pairs. The shuffle key is thus as
    fine as the windows, so that one busy base is spread over all tasks. The columns of the
    readings get the prefix ``r_``.
    """
    c = contexts.select(
        "*", F.coalesce(F.col(roles.mapped), F.col(roles.base)).alias("__eff"),
        F.explode(F.sequence(F.floor(F.col("pos_start") / F.lit(width)), F.floor(F.col("pos_end") / F.lit(width)))).alias("__pc"),
    ).select("*", F.explode(F.sequence(F.floor(_day("win_start") / F.lit(days)), F.floor(_day("win_end") / F.lit(days)))).alias("__dc"))
    r = readings.select(
        *[F.col(x).alias(f"r_{x}") for x in readings.columns],
        F.coalesce(F.col(roles.mapped), F.col(roles.base)).alias("r___eff"),
        F.floor(F.col(roles.position) / F.lit(width)).alias("r___pc"),
        F.floor(_day(roles.date) / F.lit(days)).alias("r___dc"))
    cond = ((F.col("__eff") == F.col("r___eff")) & (F.col("__pc") == F.col("r___pc")) & (F.col("__dc") == F.col("r___dc"))
            & F.col(f"r_{roles.date}").between(F.col("win_start"), F.col("win_end"))
            & F.col(f"r_{roles.position}").between(F.col("pos_start"), F.col("pos_end")))
    return c.join(r, cond, how).drop("__eff", "__pc", "__dc", "r___eff", "r___pc", "r___dc")


def amounts_by_day(intervals: DataFrame, on: Sequence[str], first: str, last: str, amount: str, asked: DataFrame, date: str) -> DataFrame:
    """Mean amount valid per place and day, over the range of the asked dates only, so that an open end far in the future costs nothing.

    An interval is cut at the months' ends, so twenty years cost 240 rows. Equal spans of a month (496 exist) merge before they are
    laid out by day. A day adds up its own spans only: an amount, also one that is not a number, leaves no trace after its interval.
    """
    span = asked.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("b")).scalar()
    valid = intervals.filter((F.col(first) <= F.col(last)) & F.col(amount).isNotNull())
    near = with_scalar(valid, __b=span).filter((F.col(first) <= F.col("__b.hi")) & (F.col(last) >= F.col("__b.lo")))
    near = near.select(*on, F.greatest(F.col(first), F.col("__b.lo")).cast("date").alias("__lo"), F.least(F.col(last), F.col("__b.hi")).cast("date").alias("__hi"),
                       F.col(amount).cast("double").alias("__a"))
    months = F.sequence(F.trunc("__lo", "month"), F.trunc("__hi", "month"), F.expr("interval 1 month"))
    cut = near.select(*on, "__lo", "__hi", "__a", F.explode(months).alias("__m"))
    spans = cut.groupBy(*on, F.greatest("__lo", "__m").alias("__lo"), F.least(F.col("__hi"), F.last_day("__m")).alias("__hi")).agg(
        F.sum("__a").alias("__a"), F.count(F.lit(1)).alias("__n"))
    daily = spans.select(*on, F.explode(F.sequence("__lo", "__hi", F.expr("interval 1 day"))).alias("day"), "__a", "__n")
    return daily.groupBy(*on, "day").agg((F.sum("__a") / F.sum("__n")).alias(amount))


def validity_join(left: DataFrame, intervals: DataFrame, on: Sequence[str], date: str, first: str, last: str, amount: str,
                  bounds: DataFrame | None = None) -> DataFrame:
    """Left join of the mean amount valid at the row's date.

    The key is (place, day), so a place with many rows spreads over its dates; at most one row matches. ``bounds`` may name a
    smaller table with the range of the dates.
    """
    right = amounts_by_day(intervals, on, first, last, amount, left if bounds is None else bounds, date)
    right = right.select(*[F.col(c).alias(f"__on_{c}") for c in on], "day", amount)
    cond = F.col(date) == F.col("day")
    for c in on:
        cond = cond & (F.col(c) == F.col(f"__on_{c}"))
    return left.join(right, cond, "left").select(*left.columns, amount)


def context_day(joined: DataFrame, keys: Sequence[str], channels: Sequence[str], amount: str | None = None,
                prefix: str = "r_") -> DataFrame:
    """Channel means, summed bin counts and mean amount per context and reading date."""
    aggs = [F.avg(f"{prefix}{c}").alias(c) for c in channels]
    aggs.append(F.sum(f"{prefix}rows_in_bin").alias("row_count"))
    if amount:
        aggs.append(F.avg(amount).alias(amount))
    return joined.groupBy(*keys).agg(*aggs)


def trailing_join(contexts: DataFrame, daily: DataFrame, on: Sequence[str], r_date: str, date: str, days: int = 30) -> DataFrame:
    """Inner join of the days at the same place in the ``days`` days up to the context date.

    With one row per place and day, and distinct places and dates on the left, a row meets at
    most days + 1 others. The key is (place, date cell).
    """
    cell = days + 1
    start = F.date_sub(F.col(r_date), days)
    c = contexts.select("*", F.explode(F.sequence(
        F.floor(F.datediff(start, F.lit(EPOCH).cast("date")) / F.lit(cell)), F.floor(_day(r_date) / F.lit(cell)))).alias("__dc"))
    d = daily.withColumn("__dc", F.floor(_day(date) / F.lit(cell)))
    return c.join(d, [*on, "__dc"]).filter(F.col(date).between(start, F.col(r_date))).drop("__dc")


def trailing_stats(contexts: DataFrame, readings: DataFrame, key: str, on: Sequence[str], r_date: str, date: str,
                   speed: str, twist: str, days: int = 30) -> DataFrame:
    """Mean, min, max speed, max twist and distinct reading dates in the trailing window;
    contexts without a reading keep null and count 0.

    Readings shrink to one row per place and day, contexts to distinct places and dates, before
    they meet: a busy place costs its days, not contexts times readings.
    """
    place = list(on)
    daily = readings.groupBy(*place, date).agg(
        F.sum(speed).alias("__s"), F.count(speed).alias("__n"), F.min(speed).alias("__lo"), F.max(speed).alias("__hi"), F.max(twist).alias("__t"))
    hits = trailing_join(contexts.select(*place, r_date).distinct(), daily, place, r_date, date, days)
    stats = hits.groupBy(*place, r_date).agg(
        (F.sum("__s") / F.nullif(F.sum("__n"), F.lit(0))).alias("avg_speed"), F.min("__lo").alias("min_speed"), F.max("__hi").alias("max_speed"),
        F.max("__t").alias("max_twist"), F.count(F.lit(1)).alias("window_count"))
    return contexts.select(key, *place, r_date).join(stats, [*place, r_date], "left").withColumn(
        "window_count", F.coalesce(F.col("window_count"), F.lit(0).cast("long")))


def prorated_load(contexts: DataFrame, intervals: DataFrame, key: str, on: Sequence[str], r_date: str,
                  first: str, last: str, amount: str) -> DataFrame:
    """Total amount of a place, and the amount up to the context date.

    An interval that ended before the date counts in full, a running one by the share of its
    days, one of zero length not until it has ended. At any date the sum is done + slope * day
    + level, and each interval changes these three only on its first day and after its last. So
    they are running sums over interval ends and context dates in one order; contexts and
    intervals are never paired.
    """
    place = list(on)
    total = intervals.groupBy(*place).agg(F.sum(amount).alias("total_load"))
    a = F.col(amount).cast("double")
    length = F.datediff(F.col(last), F.col(first))
    rate = F.when(length > 0, a / F.nullif(length, F.lit(0))).otherwise(F.lit(0.0))
    opens = F.when(length >= 0, rate).otherwise(F.lit(0.0))
    level = opens * _day(first)
    zero = F.lit(0.0)
    changes = intervals.filter(F.col(amount).isNotNull()).select(*place, F.inline(F.array(
        F.struct(F.col(first).alias("__at"), zero.alias("__done"), opens.alias("__slope"), (-level).alias("__level")),
        F.struct(F.date_add(F.col(last), 1).alias("__at"), a.alias("__done"), (-opens).alias("__slope"), level.alias("__level")))))
    parts = ("__done", "__slope", "__level")
    changes = changes.groupBy(*place, "__at").agg(*[F.sum(p).alias(p) for p in parts]).withColumn("__ask", F.lit(0))
    asks = contexts.select(*place, F.col(r_date).alias("__at")).distinct().select(*place, "__at", *[zero.alias(p) for p in parts], F.lit(1).alias("__ask"))
    # A change counts for its own day, so it comes before the questions of that day.
    series = Series(place, ["__at", "__ask"], F.trunc("__at", "month"))
    sums = running(changes.unionByName(asks), series, {f"{p}_sum": F.col(p) for p in parts}).filter("__ask = 1")
    to_date = F.col("__done_sum") + F.col("__slope_sum") * _day("__at") + F.col("__level_sum")
    answers = sums.select(*place, F.col("__at").alias(r_date), to_date.alias("__load"))
    return (contexts.select(key, *place, r_date).join(total, place, "left").join(answers, [*place, r_date], "left")
            .select(key, "total_load", F.when(F.col("total_load").isNotNull(), F.col("__load")).alias("load_to_date")))


def days_since(df: DataFrame, since: str, until: str, name: str = "days_since") -> DataFrame:
    """Whole days between two dates. Against the break date it leaks the label; against the
    context date it does not."""
    return df.withColumn(name, F.datediff(F.col(until), F.col(since)))


def context_left_join(readings: DataFrame, contexts: DataFrame, on: Sequence[str], label: str) -> DataFrame:
    """Readings with every context at their place; a missing label becomes 0.

    The contexts are hashed per partition, so the readings, the larger side, pass by unsorted.
    """
    return readings.join(contexts.hint("shuffle_hash"), list(on), "left").withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def dated_context_join(readings: DataFrame, contexts: DataFrame, on: Sequence[str], label: str, date: str, first: str, last: str,
                       days: int = 31, most: int = 200_000) -> DataFrame:
    """Readings with the contexts at their place whose window ``first`` to ``last`` (both ends in) holds their date; a missing label
    becomes 0.

    The key is (place, date cell): a reading lies in one cell, a context in those its window touches. A cell with more than ``most``
    readings is split by their hash, and the contexts in it are copied to its parts; both sides learn the number of parts from a table of
    the crowded cells only. A reading without a match stays once, also one with a null place or date; a window with a null or
    reversed end holds nothing.
    """
    cell = [*on, "__dc"]
    r = readings.withColumn("__dc", F.floor(_day(date) / F.lit(days)))
    crowded = r.groupBy(*cell).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select(*cell, F.ceil(F.col("n") / most).cast("int").alias("__parts"))
    r = salted_join(r, crowded, cell).withColumn("__part", F.pmod(F.xxhash64(*readings.columns), F.coalesce("__parts", F.lit(1))).cast("int"))
    c = contexts.filter(F.col(first) <= F.col(last)).select("*", F.explode(F.sequence(
        F.floor(_day(first) / F.lit(days)), F.floor(_day(last) / F.lit(days)))).alias("__dc"))
    c = salted_join(c, crowded, cell).withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    c = c.withColumnsRenamed({k: f"__c_{k}" for k in [*cell, "__part"]})
    cond = F.col(date).between(F.col(first), F.col(last))
    for k in [*cell, "__part"]:
        cond = cond & (F.col(k) == F.col(f"__c_{k}"))
    joined = r.drop("__parts").join(c, cond, "left")
    return joined.select(*readings.columns, *[k for k in contexts.columns if k not in on]).withColumn(label, F.coalesce(F.col(label), F.lit(0)))


def assemble_blocks(contexts: DataFrame, blocks: Sequence[DataFrame], key: str) -> DataFrame:
    """Contexts with each feature block, one row per key in each."""
    out = contexts
    for block in blocks:
        out = out.join(block, key, "left")
    return out


def label_join(profile: DataFrame, rows: DataFrame, key: str, label: str) -> DataFrame:
    """Profile with the distinct label of its key."""
    return profile.join(rows.select(key, label).dropDuplicates(), key)


def members(df: DataFrame, chosen: DataFrame, keys: Sequence[str], keep: bool = True) -> DataFrame:
    """Rows whose key is (or is not) in ``chosen``, whose distinct keys are hashed per partition; the rows pass by unsorted."""
    return df.join(chosen.select(*keys).distinct().hint("shuffle_hash"), list(keys), "left_semi" if keep else "left_anti")


def training_table(contexts: DataFrame, raw_readings: DataFrame, roles: Roles, raw_date: str, read, width: float,
                   context_cols: Sequence[str], intervals: DataFrame | None = None, amount: str = "amount",
                   interval_on: Sequence[str] | None = None, join=None, days: int = 31) -> DataFrame:
    """The assembled table: windows, trimmed and binned readings, band join, interval amount,
    one row per context and reading date.

    ``contexts`` carries the window columns; ``read`` turns raw readings into role columns,
    after the trim, so that the date bounds reach the scan. ``interval_on`` names the reading
    columns an interval must equal, ``days`` the length of the join's date cells. ``join`` may replace the band join (by the
    yardstick of tests and benchmarks).
    """
    trimmed = read(trim_to_bounds(raw_readings, raw_date, contexts, "win_start", "win_end"))
    bins = bin_readings(trimmed, roles, [roles.base, roles.mapped, roles.position, roles.date])
    joined = join(contexts, bins, roles) if join else band_join(contexts, bins, roles, width, days)
    if intervals is not None:
        on = [f"r_{c}" for c in (interval_on or [roles.base, roles.position])]
        renamed = intervals.withColumnsRenamed({c[2:]: c for c in on})
        joined = validity_join(joined, renamed, on, roles.context_date, "from_d", "to_d", amount, bounds=contexts)
    keys = [*context_cols, f"r_{roles.date}"]
    return context_day(joined, keys, roles.channels, amount if intervals is not None else None)
