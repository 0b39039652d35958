"""Scaling and imputation. Parameters come from the training rows and are applied by a scalar
subquery (global) or an equi-join (per base), with the global values as fallback."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.operators.ordered import salted_join, with_scalar
from sensorloom.operators.quantiles import exact_quantiles


def standard_params(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and population deviation; a zero deviation counts as 1."""
    def scale(c: str) -> Column:
        s = F.stddev_pop(c)
        return F.when(s == 0, F.lit(1.0)).otherwise(s)

    return train.groupBy(*by).agg(*[e for c in cols for e in (F.avg(c).alias(f"{c}_centre"), scale(c).alias(f"{c}_scale"))])


def robust_params(train: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Median and interquartile range; a zero range counts as 1."""
    q = exact_quantiles(train, by, {c: F.col(c) for c in cols}, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    def scale(c: str) -> Column:
        iqr = F.col(f"{c}_q3") - F.col(f"{c}_q1")
        return F.when(iqr == 0, F.lit(1.0)).otherwise(iqr)
    return q.select(*by, *[e for c in cols for e in (F.col(f"{c}_q2").alias(f"{c}_centre"), scale(c).alias(f"{c}_scale"))])


def as_scalar(params: DataFrame) -> Column:
    """A one-row parameter table as a struct-valued scalar subquery."""
    return params.select(F.struct("*").alias("p")).scalar()


def params_join(df: DataFrame, params: DataFrame, on: Sequence[str], fallback: Column, names: Sequence[str]) -> DataFrame:
    """Per-base parameters, the global ones where a base has none."""
    local = params.select(*on, *[F.col(n).alias(f"__{n}") for n in names])
    joined = with_scalar(salted_join(df, local, on), __p=fallback)
    return joined.select(*df.columns, *[F.coalesce(F.col(f"__{n}"), F.col("__p")[n]).alias(n) for n in names])


def _replace(df: DataFrame, cols: Sequence[str], make: Callable[[Column, str], Column], params: Column | None = None) -> DataFrame:
    """Replace ``cols``; ``make`` gets the parameters as a struct column and the column name."""
    rows = df if params is None else with_scalar(df, __p=params)
    return rows.select(*[make(F.col("__p"), c).alias(c) if c in cols else F.col(c) for c in df.columns])


def apply_scale(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - centre) / scale with global parameters."""
    return _replace(df, cols, lambda p, c: (F.col(c) - p[f"{c}_centre"]) / p[f"{c}_scale"], as_scalar(params))


def apply_scale_by(df: DataFrame, params: DataFrame, global_params: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """The same per base, with fallback."""
    names = [f"{c}_{s}" for c in cols for s in ("centre", "scale")]
    joined = params_join(df, params, on, as_scalar(global_params), names)
    return _replace(joined, cols, lambda _, c: (F.col(c) - F.col(f"{c}_centre")) / F.col(f"{c}_scale")).drop(*names)


def standard_scale(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scale(df, standard_params(train, cols), cols)


def robust_scale(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    return apply_scale(df, robust_params(train, cols), cols)


def standard_scale_by(df: DataFrame, train: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return apply_scale_by(df, standard_params(train, cols, on), standard_params(train, cols), on, cols)


def robust_scale_by(df: DataFrame, train: DataFrame, on: Sequence[str], cols: Sequence[str]) -> DataFrame:
    return apply_scale_by(df, robust_params(train, cols, on), robust_params(train, cols), on, cols)


def conditional_standardise(df: DataFrame, train: DataFrame, cols: Sequence[str], limit: float = 10.0) -> DataFrame:
    """Standardise only the features with a large mean or deviation."""
    p = as_scalar(train.agg(*[e for c in cols for e in (
        F.avg(c).alias(f"{c}_centre"), (F.stddev_pop(c) + F.lit(1e-6)).alias(f"{c}_scale"))]))
    def one(p: Column, c: str) -> Column:
        large = (p[f"{c}_scale"] > limit) | (F.abs(p[f"{c}_centre"]) > limit)
        return F.when(large, (F.col(c) - p[f"{c}_centre"]) / p[f"{c}_scale"]).otherwise(F.col(c))
    return _replace(df, cols, one, p)


def median_impute(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    p = as_scalar(exact_quantiles(train, [], {c: F.col(c) for c in cols}, {"": 0.5}))
    return _replace(df, cols, lambda m, c: F.coalesce(F.col(c), m[c]), p)
