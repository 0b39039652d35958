"""Data-quality and exploratory statistics: one or two passes over the data, tiny results."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.functions.probability import f_p_value, t_p_value
from sensorloom.operators.ordered import EVEN, Series, bounded_window, positions, running, with_scalar
from sensorloom.operators.quantiles import exact_quantiles

# Share of missing cells (percent) and its level, run lengths, class ratios, effect sizes.
MISSING_LEVELS = ((50.0, "high"), (20.0, "moderate"), (5.0, "low"))
TARGET_LEVELS = ((20.0, "critical"), (10.0, "high"), (5.0, "moderate"))
FEATURE_LEVELS = ((30.0, "critical"), (15.0, "high"), (5.0, "moderate"))
RUN_LEVELS = ((100, "systematic"), (10, "clustered"))
RATIO_LEVELS = ((10.0, 0.1, "severe"), (5.0, 0.2, "imbalanced"))
EFFECT_LEVELS = ((0.8, "Large"), (0.5, "Medium"))


def severity_band(x: Column, levels: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """Name of the first cut-off that x exceeds."""
    out = F.lit(otherwise)
    for cut, name in reversed(levels):
        out = F.when(x > cut, F.lit(name)).otherwise(out)
    return out


def _rows(aggregated: DataFrame, structs: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """Turn a one-row wide aggregate into one row per struct."""
    return aggregated.select(*keep, F.inline(F.array(*structs)))


def _nulls(c: str) -> Column:
    return F.count(F.when(F.col(c).isNull(), 1))


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy, and their share."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("duplicate_rows")).withColumn(
        "duplicate_pct", F.lit(100.0) * F.col("duplicate_rows") / F.col("n_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """Rows, columns, missing cells, duplicate rows and column types, one row.

    Copies are counted first; missing cells of a group of copies weigh its count, so the data
    is scanned once.
    """
    width = len(df.columns)
    types: dict[str, int] = {}
    for _, t in df.dtypes:
        types[t] = types.get(t, 0) + 1
    gaps = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns])
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    out = groups.agg(F.sum("__n").alias("n_rows"), F.sum(gaps * F.col("__n")).alias("missing_cells"),
                     F.sum(F.col("__n") - 1).alias("duplicate_rows"))
    return out.select(
        "n_rows", F.lit(width).alias("n_columns"), "missing_cells",
        (F.lit(100.0) * F.col("missing_cells") / (F.col("n_rows") * width)).alias("missing_pct"),
        "duplicate_rows", (F.lit(100.0) * F.col("duplicate_rows") / F.col("n_rows")).alias("duplicate_pct"),
        F.lit(", ".join(f"{t}: {n}" for t, n in sorted(types.items()))).alias("type_counts"))


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count, share and level per column, only where some are missing, most first."""
    wide = df.agg(F.count(F.lit(1)).alias("n"), *[_nulls(c).alias(f"m_{i}") for i, c in enumerate(df.columns)])
    rows = _rows(wide, [F.struct(F.lit(c).alias("column"), F.col(f"m_{i}").alias("missing")) for i, c in enumerate(df.columns)], ["n"])
    pct = F.lit(100.0) * F.col("missing") / F.col("n")
    return rows.filter("missing > 0").select("column", "missing", pct.alias("missing_pct"),
                                             severity_band(pct, MISSING_LEVELS, "minimal").alias("level")).orderBy(F.desc("missing"), "column")


def co_missing(df: DataFrame, cols: Sequence[str], above: float = 0.3) -> DataFrame:
    """Share of a column's nulls that are null in another column too."""
    pairs = [(a, b) for a in cols for b in cols if a != b]
    wide = df.agg(*[_nulls(c).alias(f"m_{c}") for c in cols],
                  *[F.count(F.when(F.col(a).isNull() & F.col(b).isNull(), 1)).alias(f"b_{a}_{b}") for a, b in pairs if a < b])
    both = {(a, b): F.col(f"b_{min(a, b)}_{max(a, b)}") for a, b in pairs}
    rows = _rows(wide, [F.struct(F.lit(a).alias("column"), F.lit(b).alias("other"),
                                 (both[a, b] / F.nullif(F.col(f"m_{a}"), F.lit(0))).alias("share")) for a, b in pairs])
    return rows.filter(F.col("share") > above)


def key_duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, and the rows in them."""
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows_in_them"))


def target_quality(df: DataFrame, label: str) -> DataFrame:
    """Missing share and its level, class sizes, and a flag for their ratio (two classes only)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    known = F.col(label).isNotNull()
    out = counts.agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing"),
                     F.count(F.when(known, 1)).alias("classes"), F.max(F.when(known, F.col("n"))).alias("largest"),
                     F.min(F.when(known, F.col("n"))).alias("smallest"))
    pct, ratio = F.lit(100.0) * F.col("missing") / F.col("n_rows"), F.col("largest") / F.col("smallest")
    flag = F.lit("balanced")
    for hi, lo, name in reversed(RATIO_LEVELS):
        flag = F.when((ratio > hi) | (ratio < lo), F.lit(name)).otherwise(flag)
    return out.select("*", pct.alias("missing_pct"), severity_band(pct, TARGET_LEVELS, "low").alias("level"), ratio.alias("class_ratio"),
                      F.when(F.col("classes") == 2, flag).alias("balance"))


def _describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per column: n, missing, mean, std, min, max, variance."""
    stats = {"present": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "variance": F.var_samp}
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[fn(F.col(c).cast("double") if s != "present" else F.col(c)).alias(f"{s}_{i}") for i, c in enumerate(cols) for s, fn in stats.items()])
    return _rows(wide, [F.struct(F.lit(c).alias("channel"), *[F.col(f"{s}_{i}").alias(s) for s in stats]) for i, c in enumerate(cols)], ["n_rows"])


def feature_quality(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing share, sample variance and level of the channels."""
    pct = F.lit(100.0) * (F.col("n_rows") - F.col("present")) / F.col("n_rows")
    return _describe(df, cols).select("channel", pct.alias("missing_pct"), "variance",
                                                    severity_band(pct, FEATURE_LEVELS, "low").alias("level"))


def top_variance(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Channels of the largest sample variance."""
    return _describe(df, cols).select("channel", "mean", "std", "min", "max", "variance").orderBy(
        F.desc_nulls_last("variance"), "channel").limit(n)


def iqr_outliers(df: DataFrame, cols: Sequence[str], width: float = 1.5) -> DataFrame:
    """Quartiles, fences and rows outside them, per channel."""
    q = exact_quantiles(df, [], {c: F.col(c) for c in cols}, {"_q1": 0.25, "_q3": 0.75}).select(F.struct("*").alias("q")).scalar()
    q1, q3 = {c: F.col("__q")[f"{c}_q1"] for c in cols}, {c: F.col("__q")[f"{c}_q3"] for c in cols}
    def fences(c: str) -> tuple[Column, Column]:
        return q1[c] - F.lit(width) * (q3[c] - q1[c]), q3[c] + F.lit(width) * (q3[c] - q1[c])
    aggs = []
    for i, c in enumerate(cols):
        lo, hi = fences(c)
        aggs += [F.count(c).alias(f"n_{i}"), F.count(F.when((F.col(c) < lo) | (F.col(c) > hi), 1)).alias(f"o_{i}")]
    wide = with_scalar(with_scalar(df, __q=q).agg(*aggs), __q=q)
    structs = []
    for i, c in enumerate(cols):
        lo, hi = fences(c)
        structs.append(F.struct(F.lit(c).alias("channel"), q1[c].alias("q1"), q3[c].alias("q3"), (q3[c] - q1[c]).alias("iqr"),
                                lo.alias("lower"), hi.alias("upper"), F.col(f"o_{i}").alias("outliers"),
                                (F.lit(100.0) * F.col(f"o_{i}") / F.nullif(F.col(f"n_{i}"), F.lit(0))).alias("outlier_pct")))
    return _rows(wide, structs)


def two_group_test(df: DataFrame, cols: Sequence[str], label: str, p_values: bool = True) -> DataFrame:
    """Pooled and Welch t, one-way F, median-centred Levene, effect size and variance ratio of
    label 1 against label 0, per channel."""
    med = {g: exact_quantiles(df.filter(F.col(label) == g), [], {c: F.col(c) for c in cols}, {"": 0.5}).select(F.struct("*").alias("m")).scalar() for g in (0, 1)}
    aggs = []
    for i, c in enumerate(cols):
        for g in (0, 1):
            x = F.when(F.col(label) == g, F.col(c))
            z = F.abs(x - F.col(f"__med{g}")[c])
            aggs += [F.count(x).alias(f"n{g}_{i}"), F.avg(x).alias(f"m{g}_{i}"), F.var_samp(x).alias(f"v{g}_{i}"),
                     F.avg(z).alias(f"zm{g}_{i}"), F.var_samp(z).alias(f"zv{g}_{i}")]
    wide = with_scalar(df, __med0=med[0], __med1=med[1]).agg(*aggs)
    names = [f"{s}{g}" for g in (0, 1) for s in ("n", "m", "v", "zm", "zv")]
    rows = _rows(wide, [F.struct(F.lit(c).alias("channel"), *[F.col(f"{s}_{i}").alias(s) for s in names]) for i, c in enumerate(cols)])
    rows = rows.filter("n0 > 0 AND n1 > 0")
    n0, n1, m0, m1, v0, v1 = (F.col(s) for s in ("n0", "n1", "m0", "m1", "v0", "v1"))
    n = n0 + n1

    def pooled(a: Column, b: Column) -> Column:
        return ((n1 - 1) * a + (n0 - 1) * b) / F.nullif(n - 2, F.lit(0))

    def one_way(a: Column, b: Column, va: Column, vb: Column) -> Column:
        grand = (n1 * a + n0 * b) / n
        return (n1 * F.pow(a - grand, 2.0) + n0 * F.pow(b - grand, 2.0)) / F.nullif(pooled(va, vb), F.lit(0.0))

    gap, a, b = m1 - m0, v1 / n1, v0 / n0
    d = gap / F.nullif(F.sqrt(pooled(v1, v0)), F.lit(0.0))
    out = rows.select(
        "channel", "n0", "n1", m1.alias("mean1"), m0.alias("mean0"), gap.alias("difference"), F.sqrt(v1).alias("std1"), F.sqrt(v0).alias("std0"),
        (gap / F.nullif(F.sqrt(pooled(v1, v0) * (F.lit(1.0) / n1 + F.lit(1.0) / n0)), F.lit(0.0))).alias("t_pooled"),
        (gap / F.nullif(F.sqrt(a + b), F.lit(0.0))).alias("t_welch"),
        (F.pow(a + b, 2.0) / F.nullif(F.pow(a, 2.0) / F.nullif(n1 - 1, F.lit(0)) + F.pow(b, 2.0) / F.nullif(n0 - 1, F.lit(0)), F.lit(0.0))).alias("welch_df"),
        one_way(m1, m0, v1, v0).alias("anova_f"), one_way(F.col("zm1"), F.col("zm0"), F.col("zv1"), F.col("zv0")).alias("levene_w"),
        d.alias("effect_size"), F.when(v0 > 0, v1 / F.nullif(v0, F.lit(0.0))).otherwise(F.lit(float("inf"))).alias("variance_ratio"),
        severity_band(F.abs(d), EFFECT_LEVELS, "Small").alias("effect"))
    if not p_values:
        return out
    rest = (F.col("n0") + F.col("n1") - 2).cast("double")
    one = F.lit(1.0)
    return out.select("*", t_p_value("t_pooled", rest).alias("pooled_p"), t_p_value("t_welch", "welch_df").alias("welch_p"),
                      f_p_value("anova_f", one, rest).alias("anova_p"), f_p_value("levene_w", one, rest).alias("levene_p"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], complete: bool = False) -> DataFrame:
    """Pearson correlation per pair of columns, over the rows where both are present, or over
    the rows complete in all columns."""
    rows = df.dropna(subset=list(cols)) if complete else df
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    wide = rows.agg(*[F.corr(a, b).alias(f"r_{i}") for i, (a, b) in enumerate(pairs)])
    return _rows(wide, [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r_{i}").alias("r")) for i, (a, b) in enumerate(pairs)])


def average_ranks(cells: DataFrame, c: str, name: str) -> DataFrame:
    """Mean rank of each distinct value of ``c``, from rows that carry a count ``n``."""
    counts = cells.groupBy(c).agg(F.sum("n").alias("__c"))
    ranked = running(counts, Series([], [c], EVEN), {"__upto": F.col("__c")})
    return ranked.select(c, (F.col("__upto") - (F.col("__c") - 1) / F.lit(2.0)).alias(name))


def spearman(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Correlation of average ranks over the rows where both columns are present.

    Pairs of values are counted first, so ranks are joined to distinct pairs only. Ranks are
    centred on their known mean, so that squares of large ranks do not cancel.
    """
    def one(a: str, b: str) -> DataFrame:
        cells = df.select(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")).dropna().groupBy("x", "y").agg(
            F.count(F.lit(1)).alias("n"))
        mid = cells.agg(((F.sum("n") + 1) / F.lit(2.0)).alias("m")).scalar()
        j = with_scalar(cells.join(average_ranks(cells, "x", "rx"), "x").join(average_ranks(cells, "y", "ry"), "y"), __mid=mid)
        dx, dy, n = F.col("rx") - F.col("__mid"), F.col("ry") - F.col("__mid"), F.col("n")
        sums = j.agg(F.sum(n * dx * dy).alias("xy"), F.sum(n * dx * dx).alias("xx"), F.sum(n * dy * dy).alias("yy"))
        return sums.select(F.lit(a).alias("a"), F.lit(b).alias("b"),
                           (F.col("xy") / F.nullif(F.sqrt(F.col("xx") * F.col("yy")), F.lit(0.0))).alias("rho"))

    return reduce(lambda p, q: p.unionByName(q), [one(a, b) for a, b in pairs])


def correlated_pairs(matrix: DataFrame, above: float = 0.7) -> DataFrame:
    """Pairs above the threshold with strength and direction."""
    return matrix.filter(F.abs("r") > above).select(
        "a", "b", "r", F.when(F.abs("r") > 0.9, "Very Strong").otherwise("Strong").alias("strength"),
        F.when(F.col("r") > 0, "Positive").otherwise("Negative").alias("direction"))


def correlation_groups(pairs: DataFrame) -> DataFrame:
    """Members of the strong and the very strong group."""
    member = pairs.select("strength", F.explode(F.array("a", "b")).alias("m"))
    return member.groupBy("strength").agg(F.array_join(F.array_sort(F.collect_set("m")), ", ").alias("members"))


def linear_trend(df: DataFrame, cols: Sequence[str], x: Column, p_values: bool = True) -> DataFrame:
    """Slope and R squared of each channel on ``x``, with the p-value of the slope."""
    wide = df.select(x.cast("double").alias("__x"), *cols).agg(*[
        fn(F.col(c), F.col("__x")).alias(f"{s}_{i}") for i, c in enumerate(cols)
        for s, fn in {"slope": F.regr_slope, "r2": F.regr_r2, "n": F.regr_count}.items()])
    out = _rows(wide, [F.struct(F.lit(c).alias("channel"), *[F.col(f"{s}_{i}").alias(s) for s in ("slope", "r2", "n")]) for i, c in enumerate(cols)])
    if not p_values:
        return out
    t = F.sqrt(F.col("r2") * (F.col("n") - 2) / F.nullif(F.lit(1.0) - F.col("r2"), F.lit(0.0)))
    return out.withColumn("p_value", t_p_value(t, (F.col("n") - 2).cast("double")))


def index_trend(df: DataFrame, channel: str, order: Sequence[str], p_values: bool = True) -> DataFrame:
    """Trend on the row number of the present values in time order."""
    rows = positions(df.filter(F.col(channel).isNotNull()), Series([], order, EVEN), "__rn")
    return linear_trend(rows, [channel], F.col("__rn") - 1, p_values)


def break_rate(df: DataFrame, label: str, date: str) -> DataFrame:
    """Rows, positives, positive share and time span."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == 1, 1)).alias("positives"),
                  F.avg(F.col(label).cast("double")).alias("rate"), F.min(date).alias("first"), F.max(date).alias("last"))


def missing_runs(df: DataFrame, cols: Sequence[str], series: Series) -> DataFrame:
    """Runs of consecutive nulls in series order: longest, number, mean length, level.

    Row number minus null number is constant inside a run; runs are counted with map-side
    combination, so one long run is no burden.
    """
    sums = {"__rn": F.lit(1), **{f"__k_{i}": F.when(F.col(c).isNull(), 1).otherwise(0) for i, c in enumerate(cols)}}
    numbered = running(df, series, sums)
    marks = F.array(*[F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column"), (F.col("__rn") - F.col(f"__k_{i}")).alias("island"))) for i, c in enumerate(cols)])
    islands = numbered.select(*series.keys, F.explode(F.array_compact(marks)).alias("m")).groupBy(*series.keys, "m").agg(F.count(F.lit(1)).alias("len"))
    return islands.groupBy(*series.keys, F.col("m.column").alias("column")).agg(
        F.max("len").alias("max_run"), F.count(F.lit(1)).alias("runs"), F.avg("len").alias("avg_run")).withColumn(
        "level", severity_band(F.col("max_run"), RUN_LEVELS, "scattered"))


def missing_gaps(df: DataFrame, cols: Sequence[str], time: str, ties: Sequence[str]) -> DataFrame:
    """Time between readings whose value is missing: min, max, mean seconds, first, last, count."""
    marks = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])
    rows = df.select(time, *ties, F.explode(F.array_compact(marks)).alias("column"))
    gap = lambda w: {"gap": F.timestamp_diff("MICROSECOND", F.lag(time, 1).over(w), F.col(time)) / F.lit(1e6)}
    out = bounded_window(rows, Series(["column"], [time, *ties], EVEN), gap, 1)
    return out.groupBy("column").agg(F.min("gap").alias("min_gap"), F.max("gap").alias("max_gap"), F.avg("gap").alias("avg_gap"),
                                     F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("n"))


def location_summary(df: DataFrame, base: str, position: str, label: str) -> DataFrame:
    return df.groupBy(base).agg(F.count(position).alias("n"), F.round(F.min(position), 2).alias("min_pos"),
                                F.round(F.max(position), 2).alias("max_pos"), F.sum(label).alias("positives"))


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Equal-width counts from min to max, the last bin closed; empty bins are there with 0."""
    b = df.agg(F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias("b")).scalar()
    lo, width = F.col("__b.lo"), (F.col("__b.hi") - F.col("__b.lo")) / F.lit(float(bins))
    cell = F.coalesce(F.least(F.floor((F.col(c) - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)), F.lit(0))
    counts = with_scalar(df.filter(F.col(c).isNotNull()), __b=b).groupBy(cell.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    cells = with_scalar(df.sparkSession.range(bins).withColumnRenamed("id", "bin"), __b=b)
    return cells.join(counts, "bin", "left").select(
        "bin", (lo + F.col("bin") * width).alias("left"), F.coalesce("n", F.lit(0)).alias("n"))
