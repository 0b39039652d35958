"""Plan checks: no cross joins, no forced broadcasts, bounds reach the reader, no big single task."""

import re

import pytest
from pyspark.sql import functions as F

from sensorloom.operators import clean
from sensorloom.plans import bindings as B
from sensorloom.plans import catalog

# Fits run while the plan is built; their inputs are covered by the other queries.
FITS = {"svm_grid", "density_ratio_weight", "linear_svm", "svm_optimality", "logistic_baseline", "boosted_trees"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - FITS))
def test_no_cross_join(spark, sf, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(catalog.QUERIES[name].run(spark, sf))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    if name != "expanding_folds_dates":  # one row per calendar day
        assert "BroadcastHashJoin" not in text
    # Rows go to a single task only after an aggregate: block counts (with the wanted number
    # beside them) or the cells of a fixed grid.
    for below in re.findall(r"Exchange SinglePartition[^\n]*\n((?:[^\n]*\n){1,3})", text):
        assert "Aggregate" in below or "__wanted" in below or "coalesce(pos" in below, below


def scan_rows(node):
    """Rows that left the scans of an executed plan."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return scan_rows(node.executedPlan())
    if "QueryStage" in node.nodeName():
        return scan_rows(node.plan())
    if node.nodeName().startswith("Scan"):
        return node.metrics().get("numOutputRows").get().value()
    children = node.children()
    return sum(scan_rows(children.apply(i)) for i in range(children.size()))


def test_bounds_skip_files(spark, sf, tmp_path):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("d", F.to_date("l_shipdate"))
    rows.repartitionByRange(16, "d").write.parquet(str(tmp_path / "t"))
    w = B.windows(spark, sf).filter("r_date < DATE '1996-01-01'")
    out = clean.trim_to_bounds(spark.read.parquet(str(tmp_path / "t")), "d", w, "win_start", "win_end")
    kept = out.collect()
    read = scan_rows(out._jdf.queryExecution().executedPlan())
    assert len(kept) <= read < rows.count() / 2
