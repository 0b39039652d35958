"""Global shuffle of records into equal shards, in two passes.

Pass one scatters the records by a seeded hash over buckets that fit in memory. Pass two brings each bucket together, orders
it by a seeded Fisher-Yates shuffle and writes it. The buckets' sequence is then one random order of all records; the shards
are equal cuts of it, so a bucket is written to one or two shards without another exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, start_offsets, table, text_of
from sensorloom.session import scratch_path

SHARDS, SEED, BUCKET_BYTES = 24, 20240607, 8 << 20


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
                    id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``shard, slot, record``: every input row once, as a struct of all its columns.

    Shard sizes differ by at most one row; slots run from 0 without gaps. Equal texts are independent rows. Rows scatter by
    identifier and text together, so a repeated or null identifier spreads over the buckets (rows equal in both share one). A
    null text is kept as null. The order depends on the rows, the seed and the bucket count, not on the joins that Spark picks.
    An empty table gives no rows.
    """
    size = F.octet_length(text_of(text_column)) + 8
    total = docs.agg(F.sum(size.cast("long")).alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows, buckets = total["rows"], max(1, -(-(total["bytes"] or 0) // bucket_bytes))
    ident, text_hash = F.col(id_column), F.xxhash64(text_of(text_column))
    bucket = bucket_of(buckets, F.lit(seed), ident, text_hash)
    starts = start_offsets(docs.groupBy(bucket.alias("__bucket")).count(), [], "__bucket", "count").select("__bucket", "start")
    # The order before the shuffle must not depend on arrival: sorted by identifier and text hash.
    scattered = docs.select(F.struct("*").alias("record"), bucket.alias("__bucket"), ident.alias("__id"),
                            text_hash.alias("__text")).repartition(buckets, "__bucket")
    grouped = scattered.sortWithinPartitions("__bucket", "__id", "__text").groupBy("__bucket").agg(F.collect_list("record").alias("records"))
    # The generator runs on from bucket to bucket of a partition, so the shuffle stands in the exchange's own stage, before the join.
    mixed = grouped.select("__bucket", F.shuffle("records", seed).alias("records")).join(starts, "__bucket").select("start", "records")
    placed = mixed.select("start", F.posexplode("records").alias("at", "record")).select(
        (F.col("start") + F.col("at")).alias("place"), "record")
    cut = placed.select(F.expr(f"cast(place * {shards} div {max(1, rows)} as int)").alias("shard"), "place", "record")
    return cut.select("shard", F.expr(f"place - (shard * {rows}L + {shards - 1}) div {shards}").alias("slot"), "record")


def write_shards(placed: DataFrame, path: str) -> None:
    """Write the shards as Parquet folders ``shard=0`` …; inside a file the rows are in order of their slots."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op5_two_pass_shards(spark, sf_dir):
    path = scratch_path(spark, "shards")
    write_shards(shuffled_shards(table(spark, sf_dir, "documents")), path)
    out = spark.read.schema("slot long, record struct<doc_id: long, text: string>, shard int").parquet(path)
    return out.select(
        F.col("record.doc_id").alias("doc_id"), (F.octet_length(text_of("record.text")) + 8).cast("long").alias("size"),
        F.crc32(text_of("record.text").cast("binary")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


SQL = None
