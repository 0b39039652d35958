"""Helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Byte map: A-Z to lower case, digits, letters and bytes of non-ASCII characters kept, the rest to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it again: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bucket_of(n: int | Column, *values: Column) -> Column:
    return F.pmod(F.xxhash64(*values), F.lit(n) if isinstance(n, int) else n)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an identifier's text modulo ``n``; a null identifier counts as the empty text."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def words(text: str) -> list[bytes]:
    """Runs of ASCII letters (lower-cased), digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def start_offsets(counts: DataFrame, keys: list[str], order: str, value: str, block: int = 1024) -> DataFrame:
    """Add ``start``: the sum of ``value`` over smaller ``order`` (whole numbers from 0, one row each) of the same keys.

    Two levels: within blocks of ``block`` numbers, and over the blocks' totals; no task holds more than a block or the totals.
    """
    rows = counts.withColumn("__block", F.floor(F.col(order) / block))
    within = Window.partitionBy(*keys, "__block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "__block").agg(F.sum(value).alias("__total"))
    totals = totals.select(*keys, "__block", F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__before"))
    rows = rows.withColumn("__within", F.coalesce(F.sum(value).over(within), F.lit(0)))
    return rows.join(totals, [*keys, "__block"]).withColumn("start", F.col("__before") + F.col("__within")).drop(
        "__block", "__before", "__within")
