"""Monthly limits, risk ratios, spikes, profiles, rolling and lag features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from sensorloom.functions.expressions import risk_ratio
from sensorloom.operators.ordered import Series, bounded_window, carry_forward, null_safe_join, salted_join
from sensorloom.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Limit:
    """How the limit of a channel is formed: 95th percentile or mean plus two deviations, on
    the value or its absolute value. The same flag serves the limit, the spike and the risk."""

    channel: str
    kind: str = "p95"
    absolute: bool = False

    @property
    def value(self) -> Column:
        return F.abs(F.col(self.channel)) if self.absolute else F.col(self.channel)

    @property
    def name(self) -> str:
        return f"limit_{self.channel}"


def monthly_p95(df: DataFrame, keys: Sequence[str], limits: Sequence[Limit], p: float = 0.95) -> DataFrame:
    """Exact interpolated percentile per group, skew-safe."""
    out = exact_quantiles(df, keys, {x.name: x.value for x in limits}, {"": p})
    return null_safe_join(df.select(*keys).distinct(), out, keys, "left")


def monthly_2sigma(df: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """Mean plus two sample deviations; 0 where the deviation is undefined."""
    return df.groupBy(*keys).agg(*[
        F.coalesce(F.avg(x.value) + F.lit(2.0) * F.stddev_samp(x.value), F.lit(0.0)).alias(x.name) for x in limits])


def monthly_limits(df: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """Both kinds of limits, one row per group."""
    p95 = [x for x in limits if x.kind == "p95"]
    sigma = [x for x in limits if x.kind != "p95"]
    if not sigma:
        return monthly_p95(df, keys, p95)
    out = monthly_2sigma(df, keys, sigma)
    if p95:
        out = null_safe_join(out, exact_quantiles(df, keys, {x.name: x.value for x in p95}, {"": 0.95}), keys, "left")
    return out


def limits_and_spikes(df: DataFrame, keys: Sequence[str], limits: Sequence[Limit], spikes: Sequence[Limit] = ()) -> DataFrame:
    """``monthly_limits`` with the number of values above the limit, ``spikes_{channel}``, for the limits in ``spikes``.

    For percentiles that number falls out of the quantile passes. Only rows of channels with the other kind are met with their
    limits to be counted.
    """
    p95, sigma = ([x for x in limits if (x.kind == "p95") == wanted] for wanted in (True, False))
    out = monthly_2sigma(df, keys, sigma) if sigma else df.select(*keys).distinct()
    counted = [x for x in spikes if x.kind != "p95"]
    if counted:
        rows = df.select(*keys, *{x.channel for x in counted})
        out = null_safe_join(out, spike_counts(salted_join(rows, monthly_2sigma(df, keys, counted), keys, null_safe=True), keys, counted), keys, "left")
    if p95:
        above = {x.name: f"spikes_{x.channel}" for x in spikes if x.kind == "p95"}
        out = null_safe_join(out, exact_quantiles(df, keys, {x.name: x.value for x in p95}, {"": 0.95}, above), keys, "left")
    return out.select(*keys, *[x.name for x in limits], *[F.coalesce(f"spikes_{x.channel}", F.lit(0).cast("long")).alias(f"spikes_{x.channel}") for x in spikes])


def threshold_join(df: DataFrame, limits: DataFrame, keys: Sequence[str], spread: Sequence[str] | None = None) -> DataFrame:
    """Left join of the values of the row's group; a busy group is salted, because an aggregate
    or a second such join on the same keys keeps Spark from splitting it at run time."""
    return salted_join(df, limits, keys, spread)


def spike_counts(with_limits: DataFrame, keys: Sequence[str], limits: Sequence[Limit]) -> DataFrame:
    """Rows above the limit per group and channel."""
    return with_limits.groupBy(*keys).agg(*[
        F.sum(F.when(x.value > F.col(x.name), 1).otherwise(0)).alias(f"spikes_{x.channel}") for x in limits])


def risk_features(df: DataFrame, limits: Sequence[Limit]) -> DataFrame:
    return df.select("*", *[risk_ratio(x.channel, x.name, x.absolute).alias(f"risk_{x.channel}") for x in limits])


def lr_diff(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.select("*", *[(F.col(a) - F.col(b)).alias(n) for n, (a, b) in pairs.items()])


def interactions(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return df.select("*", *[(F.col(a) * F.col(b)).alias(f"{a}_x_{b}") for a, b in pairs])


def energy_features(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """From a mixed profile: energy of the maxima, imbalance of the values, ratio of the first
    two deviations."""
    energy = sum((F.pow(F.col(f"{c}_max"), 2.0) for c in channels[1:]), F.pow(F.col(f"{channels[0]}_max"), 2.0))
    return df.select(
        "*", energy.alias("total_energy"),
        (F.greatest(*channels) - F.least(*channels)).alias("imbalance"),
        (F.col(f"{channels[0]}_std") / (F.col(f"{channels[1]}_std") + F.lit(1e-6))).alias("variance_ratio"))


def trailing_means(df: DataFrame, series: Series, cols: Sequence[str], sizes: Sequence[int] = (7, 30)) -> DataFrame:
    """Mean of the last n rows including the current one."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {f"{c}_avg{n}": F.avg(c).over(w.rowsBetween(1 - n, 0)) for c in cols for n in sizes}

    return bounded_window(df, series, exprs, max(sizes) - 1)


def _lags(c: str, depth: int, w: WindowSpec) -> dict[str, Column]:
    """Lag k; where it is null, the already filled lag k - 1."""
    out, fill = {}, F.col(c)
    for k in range(1, depth + 1):
        fill = F.coalesce(F.lag(c, k).over(w), fill)
        out[f"{c}_lag{k}"] = fill
    return out


def lag_cascade(df: DataFrame, series: Series, cols: Sequence[str], depth: int = 3) -> DataFrame:
    """Filled lags of all columns in one window."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        return {n: e for c in cols for n, e in _lags(c, depth, w).items()}

    return bounded_window(df, series, exprs, depth)


def rolling_and_lags(df: DataFrame, series: Series, mean_cols: Sequence[str], lag_cols: Sequence[str],
                     sizes: Sequence[int] = (7, 30), depth: int = 3) -> DataFrame:
    """Trailing means and lag cascade with one shuffle and one sort of the rows."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        out = {f"{c}_avg{n}": F.avg(c).over(w.rowsBetween(1 - n, 0)) for c in mean_cols for n in sizes}
        for c in lag_cols:
            out.update(_lags(c, depth, w))
        return out

    return bounded_window(df, series, exprs, max(max(sizes) - 1, depth))


def shifted_rolling(df: DataFrame, series: Series, cols: Sequence[str], sizes: Sequence[int] = (7, 14, 30)) -> DataFrame:
    """Statistics of the previous-row value over the n rows before the current one, its first
    difference, and the ratio of the shortest to the longest mean where both 7 and 30 are asked."""
    def exprs(w: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in cols:
            out[f"{c}_lag1"] = F.lag(c, 1).over(w)
            out[f"{c}_diff1"] = F.lag(c, 1).over(w) - F.lag(c, 2).over(w)
            for n in sizes:
                f = w.rowsBetween(-n - 1, -2)
                out[f"{c}_mean_{n}"] = F.avg(c).over(f)
                out[f"{c}_std_{n}"] = F.stddev_samp(c).over(f)
                out[f"{c}_max_{n}"] = F.max(c).over(f)
                out[f"{c}_min_{n}"] = F.min(c).over(f)
            if 7 in sizes and 30 in sizes:
                out[f"{c}_7_div_30"] = out[f"{c}_mean_7"] / F.nullif(out[f"{c}_mean_30"], F.lit(0.0))
        return out

    return bounded_window(df, series, exprs, max(sizes) + 1)


def last_event_before(df: DataFrame, series: Series, event: str, date: str) -> DataFrame:
    """Last non-null event date on an earlier row, and the days since."""
    out = carry_forward(df, series, {"last_event": F.col(event)}, strict=True)
    return out.withColumn("days_since_event", F.datediff(F.col(date), F.col("last_event")))


def key_profile(df: DataFrame, key: Sequence[str], cols: Sequence[str],
                stats: Sequence[str] = ("min", "max", "mean")) -> DataFrame:
    """Chosen statistics per key: min, max, mean, std and the exact median."""
    make = {"min": F.min, "max": F.max, "mean": F.avg, "std": F.stddev_samp}
    plain = [s for s in stats if s != "median"]
    out = df.groupBy(*key).agg(*[make[s](c).alias(f"{c}_{s}") for c in cols for s in plain])
    if "median" in stats:
        med = exact_quantiles(df, key, {c: F.col(c) for c in cols}, {"_median": 0.5})
        out = null_safe_join(out, med, key, "left")
    return out


def mean_or_first(df: DataFrame, keys: Sequence[str], numeric: Sequence[str], other: Sequence[str]) -> DataFrame:
    """Mean of numeric columns, smallest non-null value of the others (a first value has no order)."""
    return df.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in numeric], *[F.min(c).alias(c) for c in other])


def mixed_profile(df: DataFrame, keys: Sequence[str], peaks: Sequence[str], others: Sequence[str]) -> DataFrame:
    """95th percentile, deviation and maximum of the peak channels; mean of the others."""
    aggs = []
    for c in peaks:
        aggs.append(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))
        aggs.append(F.coalesce(F.max(c), F.lit(0.0)).alias(f"{c}_max"))
    base = df.groupBy(*keys).agg(*aggs, *[F.avg(c).alias(c) for c in others])
    return null_safe_join(base, exact_quantiles(df, keys, {c: F.col(c) for c in peaks}, {"": 0.95}), keys, "left")


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def key_frequency(df: DataFrame, key: str, top: int | None = None) -> DataFrame:
    """Rows per key, most frequent first; ties by key."""
    out = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)
    return out if top is None else out.limit(top)


def distinct_counts(df: DataFrame, split: str, key: str, label: str) -> DataFrame:
    """Distinct samples and distinct positive samples per split."""
    samples = df.select(split, key, label).groupBy(split, key).agg(F.max(label).alias(label))
    return samples.groupBy(split).agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("positives"))
