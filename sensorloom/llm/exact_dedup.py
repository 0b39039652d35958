"""Exact deduplication by sorting whole texts.

Sampled splitters deal the rows into ranges of the normalised text's first bytes; inside a range an external sort brings
equal texts next to each other, and neighbours are compared in full. A range key ends with a hash of the text, so texts that
share a beginning still spread, and copies of a text that alone would fill a range are cut into chunks by their identifier.
The chunks' summaries (one row each) are then put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, keep, lower_ascii, text_of
from sensorloom.operators.ordered import salted_join


def compare_neighbours(docs: DataFrame, id_column: str, text_column: str, prefix: int, record: list) -> DataFrame:
    """Per row: its chunk's best identifier, size and first row, after the content sort; ``record`` columns are carried along."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), *record)
    # Texts that are equal after lower-casing A-Z are equal after full lower-casing too, which is cheaper.
    rough = F.xxhash64(F.lower("text"))
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunk = max(1, docs.count() // (2 * ranges))  # half of a range
    # At most 2 * ranges groups exceed a chunk, so this table may be broadcast.
    hot = rows.groupBy(rough.alias("rough")).count().where(F.col("count") > chunk).select(
        "rough", F.ceil(F.col("count") / chunk).alias("chunks"))
    more = [c for c in rows.columns if c not in ("doc_id", "text")]
    rows = rows.withColumn("rough", rough).join(F.broadcast(hot), "rough", "left").select(
        "doc_id", "rough", F.coalesce("chunks", F.lit(1)).alias("chunks"),
        lower_ascii(F.substring("text", 1, prefix)).alias("head"), lower_ascii(F.col("text")).alias("norm"), *more)
    rows = rows.withColumn("chunk", bucket_of(F.col("chunks"), F.col("doc_id")))
    ranged = rows.repartitionByRange("head", "rough", "chunk")
    # The range keys are part of the window's keys: no further exchange, one sort, neighbours compared by the whole text.
    equal = Window.partitionBy("head", "rough", "chunk", "norm")
    best_first = equal.orderBy(F.col("doc_id").desc_nulls_last())
    return ranged.select(
        "doc_id", "chunks", F.sha2("norm", 256).alias("text_sha256"), F.first("doc_id").over(best_first).alias("best"),
        F.count(F.lit(1)).over(equal).alias("n"), (F.row_number().over(best_first) == 1).alias("first"), *more)


def exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix: int = 48) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest identifier
    stays (a null identifier only if the group has no other; of rows that repeat it, one). Other columns are not read. An
    empty table gives no rows.
    """
    found = keep(compare_neighbours(docs, id_column, text_column, prefix, []), "exact-dedup")
    # Chunks of one text meet by their digest; only cut groups have more than one.
    cut = found.where("first AND chunks > 1").groupBy("text_sha256").agg(F.max("best").alias("all_best"), F.sum("n").alias("all_n"))
    out = found.where("chunks = 1").withColumns({"all_best": F.col("best"), "all_n": F.col("n")}).unionByName(
        salted_join(found.where("chunks > 1"), cut, ["text_sha256"], ["doc_id"]))
    # Copies with the same identifier share a chunk, so the first row of that chunk is the only one kept.
    return out.select("doc_id", F.col("all_best").alias("keep_id"), F.col("all_n").alias("group_size"),
                      (F.col("first") & F.col("doc_id").eqNullSafe(F.col("all_best"))).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", prefix: int = 48) -> DataFrame:
    """The rows that ``exact_duplicates`` keeps, with all their columns."""
    found = compare_neighbours(docs, id_column, text_column, prefix, [F.struct("*").alias("record")])
    firsts = keep(found.where("first").select("record", "chunks", "text_sha256", "best"), "exact-dedup")
    best = Window.partitionBy("text_sha256").orderBy(F.col("best").desc_nulls_last())
    cut = firsts.where("chunks > 1").withColumn("rank", F.row_number().over(best)).where("rank = 1")  # one row per chunk
    return firsts.where("chunks = 1").select("record.*").unionByName(cut.select("record.*"))


def op3_exact_dedup(spark, sf_dir):
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""
