"""Sequences with several readers are made once, and flattened without being laid out."""

from sensorloom.operators import sequences
from sensorloom.plans import catalog


def plan(df):
    return df._jdf.queryExecution().toString()


def test_sequences_are_made_once(spark, sf):
    for name in ("impute_pad", "mutual_information"):
        assert "lineitem" not in plan(catalog.QUERIES[name].run(spark, sf))  # its readers start from written sequences


def test_flatten_picks_steps(spark):
    rows = [(k, d, None if d == 2 else float(10 * k + d)) for k in (1, 2) for d in range(k + 1)]
    padded = sequences.last_n_padded(spark.createDataFrame(rows, "key int, d int, v double"), ["key"], "d", None, ["d"], ["v"], 4)
    direct = sequences.flatten(padded, ["key"], ["v"], 4)
    assert "Generate" not in plan(direct)
    assert sorted(direct.collect()) == sorted(sequences.flatten(sequences.to_long(padded, ["key"]), ["key"], ["v"], 4).collect())
