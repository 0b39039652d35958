"""Built-in column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The date formats to try after a plain date cast, in this order.
DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-M-d",
    "yyyy/MM/dd",
    "yyyy/M/d",
    "MM/dd/yyyy",
    "dd/MM/yyyy",
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parse(c: str | Column, formats: Sequence[str]) -> Column:
    text = col(c).cast("string")
    return F.coalesce(text.try_cast("date").cast("timestamp"), *[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_date_any(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Date by the first way that parses, else null; never raises in ANSI mode."""
    return _parse(c, formats).cast("date")


def parse_epoch_any(c: str | Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Epoch seconds by the first way that parses."""
    return F.unix_timestamp(_parse(c, formats))


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """num / den, null for a zero or null denominator."""
    return col(num) / F.nullif(col(den), F.lit(0.0))


def risk_ratio(x: str | Column, limit: str | Column, absolute: bool = False) -> Column:
    """Share of the limit, 0 where the limit is missing or zero."""
    value = F.abs(col(x)) if absolute else col(x)
    return F.coalesce(safe_ratio(value, limit), F.lit(0.0))


def clip(x: str | Column, lo, hi) -> Column:
    """Keep x inside [lo, hi]; null stays null, a null bound does not bound."""
    x = col(x)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))


def finite(x: str | Column) -> Column:
    """Cast to double; unparsable, NaN and infinite values become null."""
    value = col(x).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def horizon_label(r_date: str | Column, break_date: str | Column, days: int = 30) -> Column:
    """1 when the break comes 0 to ``days`` days after the context date, else 0; null without a break date."""
    gap = F.datediff(col(break_date), col(r_date))
    return F.when(gap.isNull(), F.lit(None)).otherwise(gap.between(0, days).cast("int"))


def window_end(r_date: str | Column, break_date: str | Column | None = None, rul: str | Column | None = None,
               days: int = 30) -> Column:
    """End of a context window: the context date or, in the break-day variant, the break
    date where 1 <= rul <= days and the break comes later."""
    r = col(r_date)
    if rul is None:
        return r
    return F.when(col(rul).between(1, days), F.greatest(r, F.coalesce(col(break_date), r))).otherwise(r)


def compose_key(base: str | Column, position: str | Column, date: str | Column, width: str = "20m") -> Column:
    """base_position_width_date; null if a part is null."""
    return F.concat(
        col(base).cast("string"), F.lit("_"), col(position).cast("string"), F.lit(f"_{width}_"),
        F.date_format(col(date), "yyyy-MM-dd"),
    )


def key_prefix(key: str | Column, parts: int = 3) -> Column:
    """First ``parts`` parts of an underscore key."""
    return F.substring_index(col(key), "_", parts)


def key_date(key: str | Column) -> Column:
    """Last part of an underscore key as a date, null if it is none."""
    return parse_date_any(F.substring_index(col(key), "_", -1), ["yyyy-MM-dd"])


def key_group(key: str | Column) -> Column:
    """All parts of an underscore key but the last."""
    return F.regexp_extract(col(key), "^(.*)_[^_]*$", 1)


def cyclic(date: str | Column) -> dict[str, Column]:
    """Sine and cosine of weekday and month, both counted from 0."""
    dow = (F.dayofweek(col(date)) - 1) / F.lit(7.0)
    month = (F.month(col(date)) - 1) / F.lit(12.0)
    turn = F.lit(2 * 3.1415926)
    return {
        "sin_dow": F.sin(turn * dow), "cos_dow": F.cos(turn * dow),
        "sin_mon": F.sin(turn * month), "cos_mon": F.cos(turn * month),
    }


def hash_key(seed: int, *keys: str | Column) -> Column:
    """md5 of seed and keys: a random-looking order that does not depend on partitioning."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))


def hash_unit(seed: int, *keys: str | Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
