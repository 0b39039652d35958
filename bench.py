"""Benchmark: one JSON line with the warm median seconds of the headline queries.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query),
BENCH_QUERIES (comma-separated names, or "all").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from sensorloom.plans import bindings, catalog, q_context  # noqa: E402
from sensorloom.session import local_session  # noqa: E402



def chained_lags(spark, sf_dir):
    """Trailing means and lags as one column after the other over plain windows."""
    line = Window.partitionBy("base", "pos").orderBy("d", "ok", "ln")
    df = bindings.readings(spark, sf_dir)
    for n in (7, 30):
        df = df.withColumn(f"qty_avg{n}", F.avg("qty").over(line.rowsBetween(1 - n, 0)))
    for c in ("qty", "disc", "tax"):
        for k in (1, 2, 3):
            df = df.withColumn(f"{c}_lag{k}", F.coalesce(F.lag(c, k).over(line), F.col(f"{c}_lag{k - 1}") if k > 1 else F.col(c)))
    return df


def random_limit(spark, sf_dir):
    """As many majority rows as there are minority rows, by a random sort with a limit."""
    df = bindings.contexts(spark, sf_dir)
    minority = df.filter("label = 1")
    return minority.unionByName(df.filter("label = 0").orderBy(F.rand(42)).limit(minority.count()))


def row_ranking(spark, sf_dir):
    """Running positives by a window over all rows."""
    order = Window.orderBy(F.desc("score"))
    curve = bindings.scores(spark, sf_dir).withColumn("tp", F.sum("label").over(order)).withColumn("seen", F.count(F.lit(1)).over(order))
    return curve.agg(F.sum(F.when(F.col("label") == 0, F.col("tp"))).alias("area"), F.sum(F.col("label") * F.col("tp") / F.col("seen")).alias("steps"))


#: Plans to compare with, which are no queries.
YARDSTICKS = {"context_assembly_all_pairs": q_context.all_pairs_assembly, "rolling_and_lags_chained": chained_lags,
              "undersample_random_limit": random_limit, "ranking_by_rows": row_ranking}
HEADLINE = [
    "context_assembly", "context_assembly_all_pairs", "context_assembly_break_day", "risk_and_spikes", "monthly_limits",
    "rolling_and_lags", "rolling_and_lags_chained", "undersample_random", "undersample_random_limit", "oversample_random",
    "undersample_stratified", "calendar_windows", "ranking_metrics", "ranking_by_rows",
    "best_f1_on_curve", "quality_report", "missing_summary", "exact_duplicates", "iqr_outliers", "trailing_stats", "sequence_summary", "robust_scale_per_base",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(catalog.QUERIES) if wanted == "all" else [n for n in wanted.split(",") if n] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus), memory="12g")
    times: dict[str, float] = {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # The noop sink runs the whole plan and keeps nothing.
            run = YARDSTICKS.get(name) or catalog.QUERIES[name].run
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:] or took), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total warm median query time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": cpus, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
