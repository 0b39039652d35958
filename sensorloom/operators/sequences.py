"""Sequences and calendars.

A sequence is one row per key with an array ``steps`` of at most a fixed length, or the long
form with one row per (key, pos). No array grows with the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from sensorloom.functions.expressions import clip
from sensorloom.operators.ordered import Series, bounded_window, carry_forward, last_rows, with_scalar
from sensorloom.operators.quantiles import exact_quantiles


def _step(features: Sequence[str]) -> Column:
    return F.struct(*[F.col(f) for f in features])


def sliding_future(df: DataFrame, series: Series, features: Sequence[str], label: str, past: int = 30,
                   future: int = 30) -> DataFrame:
    """Per row: the ``past`` rows before it, and whether any of the ``future`` rows from it on
    is positive. Rows without a full past, or without one more row than the future, are left out."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {
            "steps": F.collect_list(_step(features)).over(w.rowsBetween(-past, -1)),
            "future_label": F.max(label).over(w.rowsBetween(0, future - 1)),
            "__ahead": F.count(F.lit(1)).over(w.rowsBetween(0, future)),
        }

    out = bounded_window(df, series, exprs, past, future)
    return out.filter((F.size("steps") == past) & (F.col("__ahead") == future + 1)).drop("__ahead")


def sliding_last(df: DataFrame, series: Series, features: Sequence[str], length: int = 30) -> DataFrame:
    """Per row: the ``length`` rows ending with it; the label is its own."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {"steps": F.collect_list(_step(features)).over(w.rowsBetween(1 - length, 0))}

    return bounded_window(df, series, exprs, length - 1).filter(F.size("steps") == length)


def explode_steps(df: DataFrame, keep: Sequence[str | Column]) -> DataFrame:
    """Long form of ``steps`` with ``pos`` from 1."""
    return df.select(*keep, F.posexplode("steps").alias("__p", "__s")).select(
        *[c if isinstance(c, str) else c for c in keep], (F.col("__p") + 1).alias("pos"), "__s.*")


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, exact: bool = False) -> DataFrame:
    """Last ``n`` rows per key; with ``exact``, only of keys that have that many."""
    out = last_rows(df, keys, [F.desc(c) for c in order], n)
    if exact:
        out = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("__n") == n).drop("__n")
    return out


def dedup_keep_last(df: DataFrame, keys: Sequence[str], date: str, ties: Sequence[str]) -> DataFrame:
    """One row per key and date: the last in the order of ``ties``."""
    return last_rows(df, [*keys, date], [F.desc(c) for c in ties], 1).drop("rank")


def last_n_padded(df: DataFrame, keys: Sequence[str], date: str, r_date: str | None, order: Sequence[str],
                  features: Sequence[str], length: int, pad: str = "zero", side: str = "left") -> DataFrame:
    """Last ``length`` rows per key up to ``r_date``, padded to that length.

    ``pad`` fills with zeros, or by repeating the nearest real row (the first on the left side,
    the last on the right). Each step carries ``pos``, ``is_pad`` and the features. ``keys``
    may hold columns that depend on the key, such as its label.
    """
    rows = df if r_date is None else df.filter(F.col(date) <= F.col(r_date))
    latest = [F.desc(c) for c in order]
    kept = last_rows(rows, keys, latest, length)
    # The rows lie sorted by key, so a frame over the whole key lists them without an aggregate's second sort.
    whole = Window.partitionBy(*keys).orderBy(*latest).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Where the padding stands before the rows, a row's rank gives its place.
    real = F.struct((F.lit(length + 1) - F.col("rank")).alias("pos"), F.lit(False).alias("is_pad"), *[F.col(f).cast("double").alias(f) for f in features])
    grouped = kept.withColumn("steps", F.collect_list(real).over(whole)).filter("rank = 1").select(*keys, F.reverse("steps").alias("steps"))
    missing = F.lit(length) - F.size("steps")
    if pad == "zero" and side == "left":
        blank = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(True).alias("is_pad"), *[F.lit(0.0).alias(f) for f in features]) for i in range(1, length + 1)])
        return grouped.select(*keys, F.size("steps").alias("n_real"), F.concat(F.slice(blank, 1, missing), F.col("steps")).alias("steps"))
    near = F.element_at("steps", 1 if side == "left" else -1)
    fill = [F.lit(0.0).alias(f) if pad == "zero" else near[f].alias(f) for f in features]
    padding = F.array_repeat(F.struct(F.lit(0).alias("pos"), F.lit(True).alias("is_pad"), *fill), missing)
    full = F.concat(padding, F.col("steps")) if side == "left" else F.concat(F.col("steps"), padding)
    steps = F.transform(full, lambda s, i: F.struct((i + 1).alias("pos"), s["is_pad"].alias("is_pad"), *[s[f].alias(f) for f in features]))
    return grouped.select(*keys, F.size("steps").alias("n_real"), steps.alias("steps"))


def to_long(padded: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Rows (key, pos, is_pad, features) of ``last_n_padded``."""
    return padded.select(*keep, F.inline("steps"))


def calendar_fill(df: DataFrame, keys: Sequence[str], date: str, cols: Sequence[str], ties: Sequence[str],
                  mode: str = "median") -> DataFrame:
    """Every day from the first to the last date of a section, gaps filled by the section's
    median or by the last value; ``observed`` marks the real days.

    After one row per day is kept, a section holds no more rows than the calendar has days.
    """
    rows = dedup_keep_last(df, keys, date, ties).select(*keys, date, *cols)
    span = rows.groupBy(*keys).agg(F.min(date).alias("__a"), F.max(date).alias("__b"))
    calendar = span.select(*keys, F.explode(F.sequence("__a", "__b", F.expr("interval 1 day"))).alias(date))
    full = calendar.join(rows.withColumn("observed", F.lit(True)), [*keys, date], "left").withColumn(
        "observed", F.coalesce(F.col("observed"), F.lit(False)))
    if mode == "ffill":
        return carry_forward(full, Series(keys, [date], F.trunc(date, "month")), {c: F.col(c) for c in cols})
    medians = rows.groupBy(*keys).agg(*[F.percentile(c, 0.5).alias(f"__m_{c}") for c in cols])
    return full.join(medians, list(keys)).select(
        *keys, date, "observed", *[F.coalesce(c, f"__m_{c}").alias(c) for c in cols])


def calendar_windows(filled: DataFrame, keys: Sequence[str], date: str, features: Sequence[str], length: int = 30) -> DataFrame:
    """For each observed day with enough history, the ``length`` calendar days that end there."""
    out = sliding_last(filled, Series(keys, [date], F.trunc(date, "month")), features, length)
    return out.filter("observed").select(*keys, date, "steps")


def anchored_windows(filled: DataFrame, keys: Sequence[str], date: str, features: Sequence[str], length: int = 30,
                     stride: int = 7, on: str = "observed") -> DataFrame:
    """A window for every ``stride``-th observed (or calendar) day, short ones padded by
    repeating their first row."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {"steps": F.collect_list(_step(features)).over(w.rowsBetween(1 - length, 0))}

    series = Series(keys, [date], F.trunc(date, "month"))
    out = bounded_window(filled, series, exprs, length - 1)
    # Position of the anchor: at most one row per calendar day and section.
    counted = F.sum(F.col("observed").cast("int")).over(Window.partitionBy(*keys).orderBy(date)) if on == "observed" \
        else F.row_number().over(Window.partitionBy(*keys).orderBy(date))
    anchors = out.withColumn("__i", counted)
    if on == "observed":
        anchors = anchors.filter("observed")
    pad = F.array_repeat(F.element_at("steps", 1), F.lit(length) - F.size("steps"))
    return anchors.filter((F.col("__i") - 1) % stride == 0).select(*keys, date, F.concat(pad, F.col("steps")).alias("steps"))


def pad_medians(train_long: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row of medians over the real steps of the training rows."""
    real = train_long.filter(~F.col("is_pad"))
    return exact_quantiles(real, [], {f: F.col(f) for f in features}, {"": 0.5})


def impute_pad(long: DataFrame, medians: DataFrame, features: Sequence[str]) -> DataFrame:
    """Padded steps take the training medians."""
    m = medians.select(F.struct(*[F.coalesce(f, F.lit(0.0)).alias(f) for f in features]).alias("m")).scalar()
    return with_scalar(long, __m=m).select(*[F.when(F.col("is_pad"), F.col("__m")[c]).otherwise(F.col(c)).alias(c) if c in features else F.col(c)
                         for c in long.columns])


BLOCKS = ("lastk", "last", "mean", "std", "min", "max", "trend", "meta")


def sequence_summary(long: DataFrame, keys: Sequence[str], features: Sequence[str], length: int, k: int = 5,
                     blocks: Sequence[str] = BLOCKS) -> DataFrame:
    """One row per key over the real steps: the last k values (zeros behind, if fewer), last,
    mean, population deviation, min, max, slope on the step number, real share and count."""
    real = ~F.col("is_pad")
    aggs = [F.count(F.when(real, 1)).alias("__n")]
    for f in features:
        x = F.when(real, F.col(f))
        aggs += [F.max(F.when(F.col("pos") == p, x)).alias(f"__{f}_{p}") for p in range(length - k + 1, length + 1)]
        aggs += [F.avg(x).alias(f"__{f}_mean"), F.stddev_pop(x).alias(f"__{f}_std"), F.min(x).alias(f"__{f}_min"),
                 F.max(x).alias(f"__{f}_max"), F.regr_slope(x, F.col("pos").cast("double")).alias(f"__{f}_trend")]
    g = long.groupBy(*keys).agg(*aggs)
    zero = F.lit(0.0)
    out = []
    for f in features:
        tail = F.array(*[F.col(f"__{f}_{p}") for p in range(length - k + 1, length + 1)])
        if "lastk" in blocks:
            shift = F.lit(k) - F.least(F.lit(k), F.col("__n").cast("int"))
            out += [F.coalesce(F.get(tail, shift + j), zero).alias(f"{f}_last{j + 1}of{k}") for j in range(k)]
        if "last" in blocks:
            out.append(F.coalesce(F.col(f"__{f}_{length}"), zero).alias(f"{f}_last"))
        out += [F.coalesce(F.col(f"__{f}_{b}"), zero).alias(f"{f}_{b}") for b in ("mean", "std", "min", "max", "trend") if b in blocks]
    if "meta" in blocks:
        out += [(F.col("__n") / F.lit(length)).alias("real_fraction"), F.col("__n").alias("real_count")]
    return g.select(*keys, *out)


def quantile_limits(train: DataFrame, features: Sequence[str], lo: float = 0.005, hi: float = 0.995) -> DataFrame:
    return exact_quantiles(train, [], {f: F.col(f) for f in features}, {"_lo": lo, "_hi": hi})


def quantile_clip(df: DataFrame, limits: DataFrame, features: Sequence[str], skip_equal: bool = False) -> DataFrame:
    """Clip to the training limits; with ``skip_equal``, leave a feature whose limits coincide."""
    q = limits.select(F.struct("*").alias("q")).scalar()
    def one(f: str) -> Column:
        lo, hi = F.col("__q")[f"{f}_lo"], F.col("__q")[f"{f}_hi"]
        c = clip(f, lo, hi)
        return F.when(lo == hi, F.col(f)).otherwise(c) if skip_equal else c
    return with_scalar(df, __q=q).select(*[one(c).alias(c) if c in features else F.col(c) for c in df.columns])


def flatten(rows: DataFrame, keys: Sequence[str], features: Sequence[str], length: int) -> DataFrame:
    """Columns t{i}_{feature}, one row per key, from the long form or from ``last_n_padded``, whose steps are picked by place
    without being laid out, nor grouped again if it was made for the same keys: it then has one row for each."""
    if set(rows.columns) == {*keys, "n_real", "steps"}:
        return rows.select(*keys, *[F.get("steps", F.lit(i - 1))[f].alias(f"t{i}_{f}") for i in range(1, length + 1) for f in features])
    if "steps" in rows.columns:
        return rows.groupBy(*keys).agg(*[
            F.max(F.get("steps", F.lit(i - 1))[f]).alias(f"t{i}_{f}") for i in range(1, length + 1) for f in features])
    return rows.groupBy(*keys).agg(*[
        F.max(F.when(F.col("pos") == i, F.col(f))).alias(f"t{i}_{f}") for i in range(1, length + 1) for f in features])
