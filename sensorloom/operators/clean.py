"""Projections, filters and predicates on single rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from sensorloom.functions.expressions import clip, finite, window_end


def numeric_columns(df: DataFrame, prefix: str = "", exclude: Sequence[str] = ()) -> list[str]:
    """Numeric columns by type and prefix."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name.startswith(prefix) and f.name not in exclude]


def prefix_rename(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    """Prefix every column but ``keep``."""
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def require_not_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols]))


def date_floor(df: DataFrame, date: str, first: str) -> DataFrame:
    return df.filter(F.col(date) >= F.lit(first).cast("date"))


def trim_to_bounds(readings: DataFrame, date: str, contexts: DataFrame, start: str, end: str) -> DataFrame:
    """Readings inside the overall window of the contexts.

    The bounds are scalar subqueries of the raw column's own type, known before the readings
    are scanned, so the Parquet reader skips row groups by them. One is an aggregate and one a
    top-1: two aggregates would be merged into one struct, which the reader cannot use.
    """
    kind = readings.schema[date].dataType.simpleString()
    lo = contexts.select(F.min(start).cast(kind).alias("lo")).scalar()
    hi = contexts.select(F.date_add(F.col(end), 1).cast(kind).alias("hi")).filter("hi IS NOT NULL").orderBy(F.desc("hi")).limit(1).scalar()
    return readings.filter((F.col(date) >= lo) & (F.col(date) < hi))


def context_window(df: DataFrame, r_date: str, position: str, days: int = 30, width: float | int = 0.02,
                   break_date: str | None = None, rul: str | None = None) -> DataFrame:
    """Add win_start, win_end, pos_start, pos_end."""
    start = F.date_sub(F.col(r_date), days)
    pos = F.col(position)
    return df.select(
        "*", start.alias("win_start"), window_end(r_date, break_date, rul, days).alias("win_end"),
        pos.alias("pos_start"), (pos + F.lit(width)).alias("pos_end"))


def zero_fill(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null to zero of the column's own type, in one projection."""
    types = dict(df.dtypes)
    return df.select(*[F.coalesce(F.col(c), F.lit(0).cast(types[c])).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def group_key(df: DataFrame, choices: Sequence[Sequence[str]]) -> Column:
    """Key from the first choice whose columns all exist, else a constant."""
    for cols in choices:
        if all(c in df.columns for c in cols):
            return F.concat_ws("_", *[F.col(c).cast("string") for c in cols])
    return F.lit("__nogroup__")


def to_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[finite(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def in_section(position: str, start: str, finish: str) -> Column:
    """Whether the reading's own position lies inside its section."""
    return F.coalesce((F.col(position) >= F.col(start)) & (F.col(position) <= F.col(finish)), F.lit(False))


def drop_leakage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.drop(*cols)


def ensure_columns(df: DataFrame, expected: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Expected features in their order, 0.0 where one is missing."""
    return df.select(*keep, *[F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in expected])


def year_month(df: DataFrame, date: str) -> DataFrame:
    return df.select("*", F.year(date).alias("year"), F.month(date).alias("month"))


def clip_columns(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[clip(c, *bounds[c]).alias(c) if c in bounds else F.col(c) for c in df.columns])


def reorder(df: DataFrame, order: Sequence[str], rename: dict[str, str] | None = None) -> DataFrame:
    """Rename, then put the columns in the given order."""
    rename = rename or {}
    back = {new: old for old, new in rename.items()}
    return df.select(*[F.col(back.get(c, c)).alias(c) for c in order])


def feature_groups(cols: Sequence[str], named: dict[str, Sequence[str]]) -> dict[str, list[str]]:
    """Assign columns to named groups; a column in no group forms its own."""
    out = {name: [c for c in cols if c in members] for name, members in named.items()}
    taken = {c for members in out.values() for c in members}
    out.update({c: [c] for c in cols if c not in taken})
    return {k: v for k, v in out.items() if v}
