"""Fixed-size fingerprints of documents by one-permutation MinHash with optimal densification.

Every shingle of five words is hashed once. The hash's leading bits name a bin, and the least hash of each bin stays. An empty
bin takes the value of the first filled bin in an order of its own, which is the same for all texts, so that two texts agree in a
bin with the probability of their Jaccard similarity. Of each value the low-order byte is stored; two unrelated values share it
once in 256 cases, which the estimate corrects.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from sensorloom.llm.common import table, text_of

#: Bins (a power of two), stored bits of each, and words of a shingle.
BINS, BITS, WORDS = 256, 8, 5
LANES = 64 // BITS
#: Places an empty bin tries before all filled bins are ranked for it.
PROBES = 12
#: Rows sampled to cut the documents into runs, for each run, and the most of all.
SAMPLED, MOST_SAMPLED = 16, 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body reads it."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column) -> Column:
    """Hashes of all runs of ``WORDS`` words of the lower-cased text; a shorter text is one run, also one without words."""
    words = F.transform(F.filter(F.split(F.lower(text), SPACES), lambda w: w != ""), lambda w: F.xxhash64(w))
    runs = lambda w: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(w) - WORDS, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WORDS)]))
    return let(words, runs)


def bin_of(x: Column) -> Column:
    return F.shiftright(x, 64 - (BINS - 1).bit_length())


def least_per_bin(hashes: Column) -> Column:
    """Array of the least hash of each bin, in order of bins; an empty bin holds its largest possible hash.

    That hash is put in as a mark, so after sorting each bin has a first element.
    """
    step = (1 << 64) // BINS
    marks = F.array(*[F.lit((b + 1) * step - 1 - (1 << 63)) for b in range(BINS)])
    first = lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1))))
    return let(F.sort_array(F.concat(hashes, marks)), first)


def densified(least: Column) -> Column:
    """Empty bins filled: each takes the first filled bin among ``PROBES`` places drawn by a hash of bin and attempt, or, where all
    of them are empty, the filled bin with the least hash of both bins. Filled bins keep their own."""
    low = (1 << 64 - (BINS - 1).bit_length()) - 1  # the mark of an empty bin has these bits set

    def fill(bins: Column) -> Column:
        filled = lambda v: F.when(v.bitwiseAND(F.lit(low)) != low, v)
        place = lambda i, a: F.pmod(F.xxhash64(i, F.lit(a)), F.lit(BINS)).cast("int")
        def ranked(i: Column) -> Column:
            others = F.filter(F.transform(bins, lambda v, b: F.when(filled(v).isNotNull(), F.struct(F.xxhash64(i, b, F.lit(-1)).alias("r"), v.alias("v")))), lambda x: x.isNotNull())
            return F.array_min(others)["v"]
        return F.transform(bins, lambda v, i: F.coalesce(filled(v), *[filled(F.get(bins, place(i, a))) for a in range(PROBES)], ranked(i)))

    return let(least, fill)


def packed(values: Column) -> Column:
    """The low-order bits of each bin's value, ``LANES`` bins to a long."""
    def lane(v: Column, k: int) -> Column:
        return F.shiftleft(v.bitwiseAND(F.lit((1 << BITS) - 1)), BITS * (LANES - 1 - k))
    return let(values, lambda d: F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lambda i: reduce(
        Column.bitwiseOR, [lane(F.get(d, i * LANES + k), k) for k in range(LANES)])))


def fingerprint(text: Column) -> Column:
    """``array<long>`` of ``BINS`` stored values; equal texts have equal ones, and so have texts that differ in case or spaces only."""
    return packed(densified(least_per_bin(shingle_hashes(text))))


def as_text(prints: Column) -> Column:
    """Hexadecimal digits of the packed fingerprint."""
    return F.array_join(F.transform(prints, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: the share of equal stored values, less what chance gives, 0 to 1."""
    def equal(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for shift in (1 << k for k in range((BITS - 1).bit_length())):  # any set bit of a lane reaches its lowest
            z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
        return F.lit(LANES) - F.bit_count(z.bitwiseAND(F.lit(sum(1 << BITS * k for k in range(LANES)))))

    share = F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x) / float(BINS)
    chance = 1.0 / (1 << BITS)
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def run_of(key: Column, cuts: Column, count: int) -> Column:
    """Number of ``cuts`` (sorted) that are at most ``key``, by bisection."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(count.bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= count) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at))


def with_next(docs: DataFrame, order: Column, columns: list[str], runs: int | None = None) -> DataFrame:
    """Add ``next``, the ``columns`` of the following row in ``order`` as a struct; the last row is followed by the first.

    ``order`` is a struct of whole numbers and booleans without nulls that names a row (rows with equal ones must be alike, and
    stay in one task). Rows are cut into runs at sampled rows; a cut row starts its run, and a copy of it ends the run before.
    One exchange, by run; a window in each. Only sampled keys (at most ``MOST_SAMPLED``) reach the driver.
    """
    runs = runs or 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = docs.withColumn("__key", order)
    keys = keyed.select(F.col("__key").alias("k"))
    first = keys.agg(F.min("k").alias("k")).first()["k"]
    if first is None:
        return docs.withColumn("next", F.struct(*columns))
    chance = keys.orderBy(F.xxhash64("k"), "k").limit(min(SAMPLED * runs, MOST_SAMPLED))
    sampled = sorted(tuple(r["k"]) for r in chance.collect())
    picked = sorted({tuple(first), *(sampled[j * len(sampled) // runs] for j in range(1, runs))})
    kind = keyed.schema["__key"].dataType
    cuts = F.from_json(F.lit(json.dumps([dict(zip(kind.names, p)) for p in picked])), ArrayType(kind))  # folded to one constant
    own = keyed.withColumn("__run", run_of(F.col("__key"), cuts, len(picked)) - 1)
    # A cut row also ends the run before its own; the first row of all ends the last run.
    before = F.when(F.col("__run") > 0, F.col("__run") - 1).otherwise(F.lit(len(picked) - 1))
    places = F.array(F.struct(F.col("__run").alias("run"), F.lit(False).alias("ends")), F.struct(before.alias("run"), F.lit(True).alias("ends")))
    is_cut = F.col("__key") == F.get(cuts, F.col("__run"))
    placed = own.withColumn("__at", F.explode(F.slice(places, F.lit(1), F.when(is_cut, 2).otherwise(1))))
    line = Window.partitionBy("__at.run").orderBy("__at.ends", "__key")
    return placed.withColumn("next", F.lead(F.struct(*columns)).over(line)).where("NOT __at.ends").drop("__key", "__run", "__at")


def compare_with_next(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int | None = None) -> DataFrame:
    """Per document, its fingerprint beside that of the next document and of an edited text.

    The next document has the next smaller identifier (nulls come last; of one identifier, texts by their hash); the last one's
    is the first. In the edited text, the last third of the characters gives way to as many, or all, of the next document's
    first. Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A null text
    counts as empty; two texts without words are alike. Repeated rows each have a row. A single document is its own next. Other
    columns are not read. An empty table gives no rows.
    """
    text = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_of(text_column).alias("text"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("id"),
                     F.xxhash64("text").alias("text"))
    lined = with_next(text.withColumn("prints", fingerprint(F.col("text"))), order, ["text", "prints"], runs)
    cut = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - cut), F.substring(F.col("next.text"), F.lit(1), cut))
    lined = lined.select("doc_id", F.length("text").cast("long").alias("n_chars"), "prints", F.col("next.prints").alias("next_prints"), edited.alias("edited"))
    lined = lined.withColumn("edited_prints", fingerprint(F.col("edited")))
    return lined.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("prints")).alias("fingerprint"),
        as_text(F.col("edited_prints")).alias("edited_fingerprint"), likeness(F.col("prints"), F.col("edited_prints")).alias("near_edited"),
        likeness(F.col("prints"), F.col("next_prints")).alias("near_next"))


def op12_document_fingerprints(spark, sf_dir):
    return compare_with_next(table(spark, sf_dir, "documents"))
