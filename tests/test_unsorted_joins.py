"""Joins whose larger side needs no sort."""

from pyspark.sql import functions as F

from sensorloom.operators import context


def plan(df):
    return df._jdf.queryExecution().toString()


def test_large_sides_pass_unsorted(spark):
    rows = spark.range(100).select((F.col("id") % 10).alias("k"), F.col("id").alias("v")).union(spark.sql("SELECT CAST(NULL AS BIGINT), 5L"))
    chosen = spark.createDataFrame([(1,), (1,), (7,), (None,)], "k long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        inside, outside = (context.members(rows, chosen, ["k"], keep) for keep in (True, False))
        joined = context.context_left_join(rows, chosen.withColumn("label", F.lit(1)), ["k"], "label")
        for df in (inside, outside, joined):
            assert "SortMergeJoin" not in plan(df) and "ShuffledHashJoin" in plan(df)
        assert (inside.count(), outside.count(), joined.count(), joined.agg(F.sum("label")).first()[0]) == (20, 81, 111, 30)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
