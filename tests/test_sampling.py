"""Exact sizes of the samplers; splits disjoint and whole; weights."""

import collections

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import resample, splits


def frame(spark, n0, n1, strata=3):
    rows = [(i, 0, i % strata) for i in range(n0)] + [(n0 + i, 1, i % 2) for i in range(n1)]
    return spark.createDataFrame(rows, "id int, y int, s int")


def sizes(df):
    return collections.Counter(r.y for r in df.collect())


@pytest.mark.parametrize("n0,n1", [(10, 3), (3, 10), (5, 5)])
def test_sampler_sizes(spark, n0, n1):
    df = frame(spark, n0, n1)
    top = max(n0, n1)
    over = resample.oversample_random(df, "y", ["id"])
    assert sizes(over) == {0: top, 1: top}
    assert over.select("id").distinct().count() == n0 + n1
    assert sizes(resample.undersample_random(df, "y", ["id"])) == {0: min(n0, n1), 1: n1}
    strat = sizes(resample.oversample_stratified(df, "y", ["s"], ["id"], 1.0))
    assert strat[0] == n0 and strat[1] == n0


def test_one_class(spark):
    assert sizes(resample.oversample_random(frame(spark, 4, 0), "y", ["id"])) == {0: 4}
    assert sizes(resample.undersample_random(frame(spark, 4, 0), "y", ["id"])) == {}


def test_undersample_strata(spark):
    # Stratum 0: 4 against 1; stratum 1: no minority; stratum 2: more minority than majority.
    rows = [(i, 0, 0) for i in range(4)] + [(10, 1, 0)] + [(20 + i, 0, 1) for i in range(3)] + [(30, 0, 2)] + [(40 + i, 1, 2) for i in range(3)]
    df = spark.createDataFrame(rows, "id int, y int, s int")
    got = collections.Counter((r.s, r.y) for r in resample.undersample_stratified(df, "y", ["s"], ["id"]).collect())
    assert got == {(0, 0): 1, (0, 1): 1, (2, 0): 1, (2, 1): 3}
    got = collections.Counter((r.s, r.y) for r in resample.undersample_stratified(df, "y", ["s"], ["id"], 2.0).collect())
    assert got == {(0, 0): 2, (0, 1): 1, (2, 0): 1, (2, 1): 3}


def test_samplers_do_not_depend_on_partitions(spark):
    df = frame(spark, 300, 40)
    a, b = (sorted(r.id for r in resample.undersample_random(df.repartition(n), "y", ["id"]).collect()) for n in (1, 16))
    assert a == b


def test_weighted_draw_prefers_heavy_rows(spark):
    df = spark.range(2000).withColumn("w", F.when(F.col("id") < 200, 20.0).otherwise(1.0))
    drawn = resample.weighted_draw(df, "w", 200, ["id"])
    assert drawn.count() == 200 and drawn.filter("id < 200").count() > 80


def test_weights(spark):
    df = frame(spark, 6, 2)
    w = {r.y: r.weight for r in resample.balanced_class_weight(df, "y").collect()}
    assert w == {0: pytest.approx(8 / 12), 1: pytest.approx(2.0)}
    assert resample.pos_weight(df, "y").first().pos_weight == 3.0
    alpha = {r.y: r.weight for r in resample.target_fraction_weight(df, "y", 0.5).collect()}
    assert alpha == {0: 1.0, 1: pytest.approx(3.0)}


def test_split_years_needs_three(spark):
    rows = [(i, i % 2, f"{2018 + i % 2}-01-01") for i in range(40)]
    two = spark.createDataFrame(rows, "id int, y int, t string").withColumn("d", F.to_date("t"))
    got = collections.Counter(r.part for r in splits.split_years(two, "d", "y", ["id"]).collect())
    assert got == {"train": 32, "val": 4, "test": 4}
    three = two.unionByName(two.withColumn("d", F.lit("2020-05-05").cast("date")))
    got = {(r.d.year, r.part) for r in splits.split_years(three, "d", "y", ["id"]).collect()}
    assert got == {(2018, "train"), (2019, "val"), (2020, "test")}


def test_splits_are_whole(spark):
    df = frame(spark, 90, 10).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id") % 10))
    for out in (splits.split_dates_3way(df, "d"), splits.split_dates_2way(df, "d"), splits.split_rows(df, ["d", "id"]),
                splits.split_stratified(df, "y", ["id"]), splits.split_random(df, ["id"]), splits.split_group_first_date(df, ["s"], "d")):
        assert sorted(r.id for r in out.collect()) == list(range(100))
    assert collections.Counter(r.part for r in splits.split_rows(df, ["d", "id"]).collect()) == {"train": 80, "test": 20}
    folds = splits.expanding_folds_rows(df, ["d", "id"], 5)
    assert collections.Counter(r.fold for r in folds.collect()) == {-1: 20, **{i: 16 for i in range(5)}}


@pytest.mark.parametrize("n1", [1, 3])
def test_copies_of_one_row_spread_over_tasks(spark, monkeypatch, n1):
    monkeypatch.setattr(resample, "COPIES_AT_ONCE", 100)
    df = frame(spark, 5003, n1)
    for out in (resample.oversample_random(df, "y", ["id"]), resample.oversample_stratified(df, "y", ["s"], ["id"])):
        out = out.filter("y = 1").withColumn("task", F.spark_partition_id())
        rows = out.collect()
        assert len(rows) == 5003 == len({(r.id, r.copy) for r in rows})
        per_row = collections.Counter(r.id for r in rows)
        assert max(per_row.values()) - min(per_row.values()) <= 1 and all(max(r.copy for r in rows if r.id == i) == n for i, n in per_row.items())
        per_task = collections.Counter(r.task for r in rows)
        assert len(per_task) >= 4 and max(per_task.values()) < 5003 / 2
