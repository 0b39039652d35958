"""Divergence of sources from each other and from their language, over term counts made by Arrow kernels.

Each task lower-cases and splits its texts, encodes the terms as a dictionary and counts them by hash grouping; what leaves it
are partial counts per (language, source, term). They are merged per term, rare terms go, and what stays is dealt to shards of
bounded size. A shard holds all sources' counts of its terms as columns and yields sums of divergences per pair of sources and
its own highest terms per source; shards add up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import keep, table, text_of
from sensorloom.operators.ordered import salted_join

#: Everything that is no part of a term.
SEPARATORS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
#: Bytes of text split at once, and rows of partial counts held by a task.
SLICE_BYTES, HELD_ROWS = 4 << 20, 1 << 19
#: Counts of a shard, and cells of the dense matrix that a shard builds at once.
SHARD_ROWS, TILE_CELLS = 1 << 15, 1 << 18
PARTIAL = "lang string, source string, term string, n long, docs long"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``SLICE_BYTES`` of text, or one row."""
    ends, at = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def count_terms(batch: pa.RecordBatch) -> pa.Table:
    """Per language, source and term: occurrences and documents; a null term counts the documents alone."""
    parts = pc.split_pattern_regex(pc.ascii_lower(batch.column("text")), SEPARATORS)
    terms = pc.list_flatten(parts).dictionary_encode()
    groups = pa.table({"lang": batch.column("lang"), "source": batch.column("source")})
    words = pa.table({"doc": pc.cast(pc.list_parent_indices(parts), pa.int32()), "code": terms.indices})
    words = words.group_by(["doc", "code"], use_threads=False).aggregate([([], "count_all")])
    # Documents of one group are counted together: the group's number replaces the document's.
    pairs = pa.table({"lang": groups["lang"].combine_chunks().dictionary_encode().indices,
                      "source": groups["source"].combine_chunks().dictionary_encode().indices})
    number = pc.add(pc.multiply(pc.cast(pairs["lang"], pa.int64()), batch.num_rows), pc.cast(pairs["source"], pa.int64()))
    number = number.combine_chunks().dictionary_encode()
    first = pa.array(np.unique(number.indices.to_numpy(), return_index=True)[1])  # a document of each group
    words = pa.table({"group": number.indices.take(words["doc"]), "code": words["code"], "n": words["count_all"]})
    words = words.group_by(["group", "code"], use_threads=False).aggregate([("n", "sum"), ("n", "count")])
    own = first.take(words["group"])
    counts = pa.table({"lang": groups["lang"].take(own), "source": groups["source"].take(own), "term": terms.dictionary.take(words["code"]),
                       "n": words["n_sum"], "docs": words["n_count"]})
    counts = counts.filter(pc.not_equal(counts["term"], ""))  # beside separators at an end
    sizes = groups.group_by(["lang", "source"], use_threads=False).aggregate([([], "count_all")])
    return pa.concat_tables([counts, pa.table({
        "lang": sizes["lang"], "source": sizes["source"], "term": pa.nulls(sizes.num_rows, pa.string()),
        "n": pa.array(np.zeros(sizes.num_rows, np.int64)), "docs": sizes["count_all"]})])


def merged(tables: list[pa.Table]) -> pa.Table:
    out = pa.concat_tables(tables).group_by(["lang", "source", "term"], use_threads=False).aggregate([("n", "sum"), ("docs", "sum")])
    return out.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(["lang", "source", "term", "n", "docs"])


def partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task. Its table is merged as it grows and handed on when full, so memory is bounded."""
    held, rows = [], 0
    for batch in batches:
        for part in slices(batch):
            held.append(count_terms(part))
            rows += held[-1].num_rows
            if rows > 2 * HELD_ROWS:
                held = [merged(held)]
                rows = held[0].num_rows
                if rows > HELD_ROWS:
                    yield from held[0].to_batches()
                    held, rows = [], 0
    if held:
        yield from merged(held).combine_chunks().to_batches()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` of every term (and of a null term per group): one exchange by (language, term)."""
    texts = docs.select(*[text_of(c).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(partial_counts, PARTIAL).repartition("lang", "term")
    return partial.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + 2) / (total + 2 * kept)) by long division in steps of 1000, so that no product leaves 64 bits."""
    divisor = total + 2 * kept
    quotient, rest = np.divmod(count + 2, divisor)
    for _ in range(3):
        step, rest = np.divmod(rest * 1000, divisor)
        quotient = quotient * 1000 + step
    return 1 + quotient


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shard_divergences(counts: pa.Table, groups: pa.Table, top: int) -> pa.Table:
    """Of one shard: the sum over its terms for each pair of sources, and the ``top`` highest terms of each source.

    ``groups`` has every source of the language, with its total, the language's total and its number of kept terms.
    """
    names, total = groups["in_source"].combine_chunks(), groups["total"].to_numpy()
    kept, whole = groups["kept"].to_numpy(), groups["lang_total"].to_numpy()[:1]
    s, sums = len(names), np.zeros((len(names), len(names)), np.int64)
    best_source, best_term, best_value = [], [], []
    if counts.num_rows:
        terms = counts["term"].combine_chunks().dictionary_encode()
        code, source = terms.indices.to_numpy(), pc.index_in(counts["source"].combine_chunks(), names).to_numpy()
        n, order = counts["n"].to_numpy(), np.argsort(code, kind="stable")
        code, source, n = code[order], source[order], n[order]
        # Places of the terms in the order of their UTF-8, for ties.
        place = np.empty(len(terms.dictionary), np.int64)
        place[pc.sort_indices(terms.dictionary).to_numpy()] = np.arange(len(place))
        width = max(1, TILE_CELLS // s)
        for at in range(0, len(place), width):
            a, b = np.searchsorted(code, [at, at + width])
            dense = np.zeros((min(width, len(place) - at), s), np.int64)
            dense[code[a:b] - at, source[a:b]] = n[a:b]
            p = shares(dense, total[None, :], kept[None, :])
            for i in range(s):
                sums[i] += distance(p[:, i:i + 1], p).sum(axis=0)
            q = shares(dense.sum(axis=1), whole, kept[:1])
            for i in range(s):
                row = np.flatnonzero((dense[:, i] > 0) & (p[:, i] > q))
                value = distance(p[row, i], q[row])
                row, value = (x[np.lexsort((place[row + at], -value))[:top]] for x in (row, value))
                best_source.append(np.full(len(row), i))
                best_term.append(row + at)
                best_value.append(value)
        best_source, best_term, best_value = map(np.concatenate, (best_source, best_term, best_value))
        order = np.lexsort((place[best_term], -best_value, best_source))
        nth = np.arange(len(order)) - np.searchsorted(best_source[order], best_source[order])
        best_source, best_term, best_value = (x[order][nth < top] for x in (best_source, best_term, best_value))
        tops = pa.table({"source": names.take(pa.array(best_source)), "item": terms.dictionary.take(pa.array(best_term)), "value": best_value})
    else:
        tops = pa.table({"source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    i, j = np.nonzero(~np.eye(s, dtype=bool))
    pairs = pa.table({"source": names.take(pa.array(i)), "item": names.take(pa.array(j)), "value": sums[i, j]})
    out = pa.concat_tables([t.append_column("part", pa.array([part] * t.num_rows, pa.string())) for part, t in (("pair", pairs), ("term", tops))])
    return out.append_column("lang", pa.array([groups["in_lang"][0].as_py()] * out.num_rows, pa.string())).select(["lang", "source", "part", "item", "value"])


def source_divergences(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (language, source) of ``docs``; reads its columns ``lang, source, text``.

    Part ``pair``: the summed divergence from each other source of the language. Part ``term``: the ``top`` terms by which a
    source exceeds its language. A language keeps the terms of at least ``min_docs`` documents; null counts as the empty string
    in all three columns; a language without kept terms has pairs of value 0, one with a single source has no pairs. Repeated
    rows count as often as they stand. Ties go to the smaller item by UTF-8. An empty table gives no rows.
    """
    merged_counts = term_counts(docs)
    # The counts keep their exchange by (language, term): a source stands once per term, so a row of this holds at most the sources.
    by_term = merged_counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("rows"))
    kept = by_term.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).select("lang", "term", F.posexplode("rows").alias("pos", "row"))
    kept = keep(kept.select("lang", "term", (F.col("pos") == 0).alias("lead"), "row.source", "row.n"), "divergence-counts")
    real = F.col("term").isNotNull()
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if(real & F.col("lead")).alias("leads"), F.count_if(real).alias("cells"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("leads").alias("kept"),
                                       F.greatest(F.lit(1), F.ceil(F.sum("cells") / SHARD_ROWS)).alias("shards"))
    of_groups = groups.join(langs.withColumnRenamed("lang", "of_lang"), F.col("lang") == F.col("of_lang")).select(
        F.col("lang").alias("in_lang"), F.col("source").alias("in_source"), "total", "lang_total", "kept", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("in_shard"))
    of_terms = salted_join(kept.where(real), langs.select("lang", "shards"), ["lang"], ["term"]).select(
        "lang", "source", "term", "n", F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard"))
    found = keep(of_terms.groupBy("lang", "shard").cogroup(of_groups.groupBy("in_lang", "in_shard")).applyInArrow(
        lambda counts, own: shard_divergences(counts, own, top), "lang string, source string, part string, item string, value long"), "divergence-shards")
    pairs = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(
        found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def op11_source_divergence(spark, sf_dir):
    return source_divergences(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS doc,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
w AS (SELECT lang, source, doc, unnest(terms) AS term FROM d),
keep AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN keep USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT lang, count(*) AS v FROM keep GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) x),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // CAST(g.total + 2 * v.v AS HUGEINT) AS BIGINT) AS p
         FROM g JOIN keep k USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, 1 + CAST(CAST(1000000000 AS HUGEINT) * (n + 2) // CAST(total + 2 * v.v AS HUGEINT) AS BIGINT) AS q
          FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN (SELECT lang, sum(total) AS total FROM g GROUP BY lang) USING (lang) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM cell a JOIN cell b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(pair.value, 0) AS BIGINT) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
          UNION ALL
          SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM cell JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10"""
