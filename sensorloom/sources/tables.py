"""Scans and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sensorloom.functions.expressions import hash_key
from sensorloom.operators.ordered import hash_series, mark_lowest


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    """Whole catalog table, or whole Parquet path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def scan_sql(spark: SparkSession, text: str, limit: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """SQL scan; a limit needs an order, so that the same rows come back every time."""
    df = spark.sql(text)
    if limit is None:
        return df
    if not order:
        raise ValueError("a limited scan needs an order")
    return df.orderBy(*order).limit(limit)


def load_csv_tables(spark: SparkSession, folder: str, schemas: dict[str, StructType | str]) -> dict[str, DataFrame]:
    """One CSV file or folder per table; absent tables are left out."""
    tables = {}
    for name, schema in schemas.items():
        try:
            tables[name] = spark.read.csv(f"{folder}/{name}.csv", header=True, schema=schema)
        except AnalysisException:
            continue
    return tables


def random_scan(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, ties: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in hash order. A cut-off block is found by counts, so a large ``n``
    is not gathered in one task."""
    hashed = df.withColumn("__h", hash_key(seed, *keys))
    marked = mark_lowest(hashed, F.lit(n), hash_series([], "__h", ties, digits=5))
    return marked.filter("chosen").select(*df.columns)


def choose_source(spark: SparkSession, context: str, training: str, testing: str) -> DataFrame:
    """Testing table for the context ``testing``, otherwise the training table."""
    return scan_table(spark, testing if context == "testing" else training)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def metrics_row(df: DataFrame, model: str, version: str, pipeline: str) -> DataFrame:
    """One-row metrics frame as a model log row, all metrics as text in one column."""
    text = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in df.columns])
    return df.select(F.lit(model).alias("ModelName"), F.lit(version).alias("ModelVersion"),
                     text.alias("ModelMetrics"), F.lit(pipeline).alias("PipelineVersion"))


def append_metrics(row: DataFrame, path: str) -> None:
    row.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def score_table(df: DataFrame, key: str, label: str | None, probability: str | Column) -> DataFrame:
    """The score schema: key, target (null when there is no label), probability."""
    p = F.col(probability) if isinstance(probability, str) else probability
    target = F.col(label).cast("int") if label else F.lit(None).cast("int")
    return df.select(F.col(key).alias("p_key"), target.alias("target"), p.cast("double").alias("probability"))


def table_summary(tables: dict[str, DataFrame], descriptions: dict[str, str] | None = None) -> DataFrame:
    """Rows, columns and missing cells per table, one pass over each."""
    descriptions = descriptions or {}

    def one(name: str, df: DataFrame) -> DataFrame:
        missing = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns])
        width = len(df.columns)
        return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(missing.cast("long")), F.lit(0)).alias("missing")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(width).alias("n_columns"), "missing",
            (F.lit(100.0) * F.col("missing") / F.nullif(F.col("n_rows") * width, F.lit(0))).alias("missing_pct"),
            F.lit(descriptions.get(name, "")).alias("description"))

    return union_all(one(n, df) for n, df in tables.items())


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    """Union by name, never by position."""
    return reduce(lambda a, b: a.unionByName(b), frames)
