import hashlib
import re
import struct
from collections import Counter

import pytest
import xxhash
from llm_cases import documents, mixed_rows, row
from pyspark.sql import functions as F

from sensorloom.llm import fingerprints as fp

MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_of(*values):
    """Chained 64-bit hash of whole numbers (as 8 bytes), strings and places in an array (as 4 bytes); nulls are skipped."""
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else struct.pack("<q", v)
            seed = xxhash.xxh64(data, seed=seed).intdigest()
    return signed(seed)


def places(spark):
    """The hashes of bin and attempt, and of two bins, from Spark: fixed numbers that no text enters."""
    tried = spark.range(fp.BINS).select([F.pmod(F.xxhash64(F.col("id").cast("int"), F.lit(a)), F.lit(fp.BINS)) for a in range(fp.PROBES)]).collect()
    ranks = {(r[0], r[1]): r[2] for r in spark.range(fp.BINS).selectExpr("cast(id as int) i").join(spark.range(fp.BINS).selectExpr("cast(id as int) b")).select(
        "i", "b", F.xxhash64("i", "b", F.lit(-1))).collect()}
    return tried, ranks


def brute_print(text, tried, ranks):
    words = [hash_of(w) for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    runs = {hash_of(*words[i:i + 5]) for i in range(max(1, len(words) - 4))}
    bins = {}
    for h in runs:
        bins.setdefault((h >> 56) + 128, []).append(h)
    least = {b: min(v) for b, v in bins.items()}
    out = []
    for i in range(fp.BINS):
        if i not in least:
            b = next((p for p in tried[i] if p in least), None)
            b = min(least, key=lambda x: ranks[i, x]) if b is None else b
        else:
            b = i
        out.append(least[b] & 255)
    return bytes(out).hex()


def brute_likeness(a, b):
    same = sum(x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b))) / fp.BINS
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


@pytest.mark.parametrize("runs,parts", [(None, 3), (40, 1), (2, 9)])
def test_against_brute_force(spark, runs, parts):
    rows = [r for r in mixed_rows() if r[0] != 7] + [row(None, "no id here at all"), row(-5, "é日本 " * 50)]
    tried, ranks = places(spark)
    got = {r.doc_id: r for r in fp.compare_with_next(documents(spark, rows).repartition(parts), runs=runs).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    assert len(got) == len(rows)
    for r, following in zip(order, order[1:] + order[:1]):
        text, other = r[1] or "", following[1] or ""
        k = len(text) // 3
        edited = text[:len(text) - k] + other[:k]
        own, changed, nxt = (brute_print(t, tried, ranks) for t in (text, edited, other))
        have = got[r[0]]
        assert (have.n_chars, have.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (have.fingerprint, have.edited_fingerprint) == (own, changed)
        assert abs(have.near_edited - brute_likeness(own, changed)) < 1e-12 and abs(have.near_next - brute_likeness(own, nxt)) < 1e-12


def test_estimates_follow_the_true_similarity(spark):
    import random

    rng = random.Random(2)
    rows, truth = [], []
    shingles = lambda t: {tuple(t[i:i + 5]) for i in range(len(t) - 4)}
    for i in range(300):
        a = [str(rng.random()) for _ in range(rng.choice([30, 100, 700]))]
        b = list(a)
        for _ in range(rng.choice([0, 1, 4, 12, 40])):
            b[rng.randrange(len(b))] = str(rng.random())
        x, y = shingles(a), shingles(b)
        truth.append(len(x & y) / len(x | y))
        rows.append((i, " ".join(a), " ".join(b)))
    df = spark.createDataFrame(rows, "i long, a string, b string").select("i", fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))).alias("j"))
    error = [r.j - truth[r.i] for r in df.collect()]
    assert abs(sum(error) / len(error)) < 0.01 and (sum(e * e for e in error) / len(error)) ** 0.5 < 0.05 and max(map(abs, error)) < 0.2


def test_equal_and_empty_texts(spark):
    texts = ["a b c", "A  b\nC ", "a b c", None, "", " \t ", "d e f g h i", "x" * 5000]
    df = documents(spark, [row(i, t) for i, t in enumerate(texts)])
    got = {r.doc_id: r.fingerprint for r in fp.compare_with_next(df).collect()}
    assert got[0] == got[1] == got[2] and got[3] == got[4] == got[5] and len({got[0], got[3], got[6], got[7]}) == 4


def test_single_repeated_and_no_rows(spark):
    assert fp.compare_with_next(documents(spark, []).limit(0)).count() == 0
    one = fp.compare_with_next(documents(spark, [row(4, "one two three")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    # A third of the rows are one row; some identifiers repeat with other texts.
    rows = [row(5, "same text here")] * 40 + [row(i, f"text {i}") for i in range(60)] + [row(9, f"other {i}") for i in range(20)]
    got = fp.compare_with_next(documents(spark, rows).repartition(5), runs=12).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert sum(r.near_next == 1.0 for r in got if r.doc_id == 5) >= 39


def test_long_text(spark):
    text = "lorem ipsum dolor " * 100_000  # 1.8 MB
    got = fp.compare_with_next(documents(spark, [row(1, text), row(2, text + "x")])).collect()
    assert all(r.near_next > 0.5 for r in got)


def test_one_exchange_of_texts(spark, sf):
    plan = fp.op12_document_fingerprints(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan and "from_json" not in plan
