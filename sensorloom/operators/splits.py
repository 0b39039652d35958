"""Splits and folds. Each adds a column and leaves the rows in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.functions.expressions import hash_key, hash_unit
from sensorloom.operators.ordered import EVEN, Series, hash_series, mark_lowest, positions, salted_join
from sensorloom.operators.quantiles import exact_quantiles
from sensorloom.operators.resample import HASH, class_sizes


def _date_ranks(df: DataFrame, date: str) -> DataFrame:
    """Distinct days with their 0-based rank; as many rows as days, whatever the input."""
    days = df.select(F.col(date).cast("date").alias("__day")).filter("__day IS NOT NULL").distinct()
    return days.select("__day", (F.row_number().over(Window.orderBy("__day")) - 1).alias("__rank"))


def cutoff_date(df: DataFrame, date: str, share: float, shift: int = 0) -> Column:
    """Scalar: sorted distinct dates at index int(n * share) + shift."""
    ranks = _date_ranks(df, date)
    at = F.floor((F.max("__rank") + 1) * F.lit(share)) + F.lit(shift)
    index = ranks.agg(at.alias("i")).scalar()
    return ranks.filter(F.col("__rank") == index).agg(F.min("__day").alias("d")).scalar()


def split_dates_3way(df: DataFrame, date: str, train: float = 0.8, val: float = 0.9) -> DataFrame:
    c1, c2 = cutoff_date(df, date, train), cutoff_date(df, date, val)
    return df.withColumn("part", F.when(F.col(date) <= c1, "train").when(F.col(date) <= c2, "val").otherwise("test"))


def split_dates_2way(df: DataFrame, date: str, train: float = 0.8) -> DataFrame:
    return df.withColumn("part", F.when(F.col(date) <= cutoff_date(df, date, train, -1), "train").otherwise("test"))


def split_rows(df: DataFrame, order: Sequence[str], train: float = 0.8) -> DataFrame:
    """First share of the rows in date order; only the rows of the cut-off block are ranked."""
    n = df.agg(F.floor(F.count(F.lit(1)) * F.lit(train)).alias("n")).scalar()
    marked = mark_lowest(df, n, Series([], order, EVEN))
    return marked.withColumn("part", F.when(F.col("chosen"), "train").otherwise("test")).drop("chosen")


def split_years(df: DataFrame, date: str, label: str, keys: Sequence[str], seed: int = 42, few_years: str = "stratified") -> DataFrame:
    """Last year test, the year before it validation, the rest train. With fewer than three years the caller's choice: a
    stratified 80/10/10 split, or an error (``few_years="raise"``)."""
    years = sorted(row[0] for row in df.select(F.year(date)).distinct().collect() if row[0] is not None)
    if len(years) < 3:
        if few_years != "stratified":
            raise ValueError(f"a split by years needs three of them, not {len(years)}")
        return split_stratified(df, label, keys, (("train", 0.8), ("val", 0.9), ("test", 1.0)), seed)
    year = F.year(date)
    return df.withColumn("part", F.when(year == years[-1], "test").when(year == years[-2], "val").otherwise("train"))


def split_group_first_date(df: DataFrame, group: Sequence[str], date: str, train: float = 0.8) -> DataFrame:
    """Whole groups by their first date against the quantile of all first dates."""
    first = df.groupBy(*group).agg(F.datediff(F.min(date), F.lit("1970-01-01").cast("date")).alias("__first"))
    cut = exact_quantiles(first, [], {"q": F.col("__first")}, {"": train}).select("q").scalar()
    side = first.select(*group, F.when(F.col("__first") <= cut, "train").otherwise("test").alias("part"))
    return salted_join(df, side, list(group))


def split_groups_random(df: DataFrame, group: Sequence[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """Whole groups by the hash of their key; a projection."""
    return df.withColumn("part", F.when(hash_unit(seed, *group) < test, "test").otherwise("train"))


def group_kfold(df: DataFrame, group: Sequence[str], k: int, seed: int = 42) -> DataFrame:
    """Fold number of the group, 0 to k - 1; a projection."""
    number = F.conv(F.substring(hash_key(seed, *group), 1, 8), 16, 10).cast("long")
    return df.withColumn("fold", (number % k).cast("int"))


def split_stratified(df: DataFrame, label: str, keys: Sequence[str],
                     parts: Sequence[tuple[str, float]] = (("train", 0.7), ("val", 0.85), ("test", 1.0)),
                     seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """Per class in hash order, cut at the given cumulative shares; rows without a label are left out."""
    rows = df.filter(F.col(label).isNotNull()).withColumn(HASH, hash_key(seed, *keys))
    ranked = positions(rows, hash_series([label], HASH, ties), "__rn")
    n = class_sizes(df, label)[F.col(label)]
    part = F.lit(parts[-1][0])
    for name, upto in reversed(parts[:-1]):
        part = F.when(F.col("__rn") <= F.floor(n * F.lit(upto)), F.lit(name)).otherwise(part)
    return ranked.select(*df.columns, part.alias("part"))


def split_random(df: DataFrame, keys: Sequence[str], cuts: Sequence[tuple[str, float]] = (("train", 0.8), ("val", 0.9), ("test", 1.0)),
                 seed: int = 42) -> DataFrame:
    """Rows by hash against cumulative shares; a projection."""
    u, part = hash_unit(seed, *keys), F.lit(cuts[-1][0])
    for name, upto in reversed(cuts[:-1]):
        part = F.when(u < upto, F.lit(name)).otherwise(part)
    return df.withColumn("part", part)


def expanding_folds_rows(df: DataFrame, order: Sequence[str], k: int = 5) -> DataFrame:
    """Number of the fold that tests the row (-1 for the first train block); fold i trains on fold < i."""
    ranked = positions(df, Series([], order, EVEN), "__rn")
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return _fold(ranked, F.col("__rn") - 1, n, k).drop("__rn")


def expanding_folds_dates(df: DataFrame, date: str, k: int = 5) -> DataFrame:
    """The same over distinct dates, so that a bag of one date stays together."""
    ranks = _date_ranks(df, date)
    n = ranks.agg(F.count(F.lit(1)).alias("n")).scalar()
    # One row per calendar day: small enough to broadcast whatever the size of the rows.
    return _fold(df.join(F.broadcast(ranks), F.col(date).cast("date") == F.col("__day")), F.col("__rank"), n, k).drop("__day", "__rank")


def _fold(df: DataFrame, index: Column, n: Column, k: int) -> DataFrame:
    size = F.floor(n / F.lit(k + 1))
    first = n - size * k
    return df.withColumn("fold", F.when(index < first, -1).otherwise(F.floor((index - first) / F.nullif(size, F.lit(0)))).cast("int"))
