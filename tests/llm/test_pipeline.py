import corpus_pipeline
from sensorloom.llm.queries import QUERIES

import __spark_entry__


def test_stages_on_the_smallest_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert set(r.doc_id for r in out.select("doc_id").collect()) <= set(r.doc_id for r in docs.select("doc_id").collect())
        if name != "source_mix":
            assert n * 0.7 < out.count() <= docs.count()
        docs = out
    pieces = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(pieces.columns)
    assert pieces.agg({"length": "sum"}).first()[0] > 0


def test_registered():
    assert {*QUERIES, "pipeline"} <= set(__spark_entry__.queries())
    assert all(any(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 11))
