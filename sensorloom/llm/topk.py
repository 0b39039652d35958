"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of (term, weight). Queries and candidates are dealt to cells of a query block and a candidate block. In
a cell the candidates become postings per term; term by term, the query rows that hold the term scatter their weight times the
postings' into a dense array of scores. Partition selection keeps each query's best of the block, and the blocks' are merged.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, table

QUERY_BLOCK, ROW_BLOCK, TILE = 8192, 8192, 128


def postings(terms: pd.Series, weights: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per term: rows and weights. Zero weights have no posting."""
    n = np.fromiter(map(len, terms), np.int64, len(terms))
    if not n.sum():
        return {}
    row, term, weight = np.repeat(np.arange(len(n)), n), np.concatenate(terms.to_numpy()).astype(np.int64), np.concatenate(weights.to_numpy()).astype(np.int64)
    row, term, weight = row[weight != 0], term[weight != 0], weight[weight != 0]
    order = np.argsort(term, kind="stable")
    row, term, weight = row[order], term[order], weight[order]
    cuts = np.flatnonzero(np.diff(term, prepend=term[:1] - 1)) if len(term) else np.zeros(0, np.int64)
    return {int(term[a]): (row[a:b], weight[a:b]) for a, b in zip(cuts, [*cuts[1:], len(term)])}


def best_of_block(queries: pd.DataFrame, rows: pd.DataFrame, k: int, tile: int = TILE) -> pd.DataFrame:
    """The ``k`` best rows of the block for each query but itself; ties go to the smaller identifier."""
    rows = rows.sort_values("vec_id", kind="stable").reset_index(drop=True)
    ids, of_rows, out = rows["vec_id"].to_numpy(np.int64), postings(rows["terms"], rows["weights"]), []
    for at in range(0, len(queries), tile):
        part = queries.iloc[at:at + tile]
        query_ids, scores = part["vec_id"].to_numpy(np.int64), np.zeros((len(part), len(rows)), np.int64)
        for term, (which, weight) in postings(part["terms"], part["weights"]).items():
            if term in of_rows:
                place, value = of_rows[term]
                if len(place) == len(rows) and len(which) == len(part):  # every row holds the term: no scatter needed
                    scores += weight[:, None] * value
                else:
                    scores[np.ix_(which, place)] += weight[:, None] * value
        for q, query in enumerate(query_ids):
            score, other = scores[q], ids
            if (own := np.searchsorted(ids, [query, query + 1]))[0] < own[1]:
                score, other = np.delete(score, slice(*own)), np.delete(ids, slice(*own))
            if len(score) > k:
                least = np.partition(score, len(score) - k)[len(score) - k]
                above = np.flatnonzero(score > least)
                pick = np.concatenate([above, np.flatnonzero(score == least)[: k - len(above)]])  # in order of identifier
                score, other = score[pick], other[pick]
            out.append(pd.DataFrame({"query_id": query, "vec_id": other, "score": score}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, query_block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score`` of each query's ``k`` best rows by integer inner product, all if there are fewer.

    Both tables have ``vec_id long, terms array<int>, weights array<long>``; a term that a vector lacks counts as 0, so
    lengths may differ. A query does not find rows with its own identifier. A row that stands twice is found twice; a query
    that stands twice is answered once. Products must fit in 64 bits. Empty tables give no rows.
    """
    queries = queries.dropDuplicates(["vec_id"])
    query_blocks, row_blocks = max(1, -(-queries.count() // query_block)), max(1, -(-rows.count() // row_block))
    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    # Every query row meets every candidate row once, in the cell of their two blocks.
    asked = queries.select("vec_id", "terms", "weights", bucket_of(query_blocks, F.col("vec_id"), F.lit(1)).cast("int").alias("qb"), numbers(row_blocks).alias("rb"))
    given = rows.select("vec_id", "terms", "weights", bucket_of(row_blocks, F.col("vec_id"), F.lit(2)).cast("int").alias("rb"), numbers(query_blocks).alias("qb"))
    best = asked.groupBy("qb", "rb").cogroup(given.groupBy("qb", "rb")).applyInPandas(
        lambda q, r: best_of_block(q, r, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def integer_vectors(vectors: DataFrame, scale: int = 256, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Components as floor(scale * x), by position. Vectors that are null or hold a null or non-finite component are left out."""
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_column).alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v")).where(
        F.coalesce(good, F.lit(False)) & F.col("vec_id").isNotNull()).select(
        "vec_id", F.transform("v", lambda x, i: i).alias("terms"), F.transform("v", lambda x: F.floor(x * scale)).alias("weights"))


def op2_exact_top_k(spark, sf_dir):
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
      FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 5"""
