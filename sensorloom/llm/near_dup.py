"""N-gram Jaccard join by MinHash banding.

Texts with equal n-gram sets form one class representative each. Representatives that share a band of their MinHash signature
meet; bands and rows per band follow from the recall wanted at the threshold. Meeting pairs are verified on their full n-gram
sets. A bucket is never expanded into pairs: its texts meet in blocks of bounded size, a block yields per text the number of
verified partners and the edges of a spanning forest, and a pair counts only in the first band where it meets. Buckets with
the same members as one of an earlier band are left out. Classes are the connected components of the forests' edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, keep, table, text_of, words

NGRAM, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 96
#: Texts and n-grams of a block.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
#: Words hashed at once, bytes of text signed at once, and the bytes from which a word stands for itself by its digest.
PIECE_WORDS, BATCH_BYTES, LONG_WORD = 1 << 16, 1 << 20, 1024
_U = np.uint64


def choose_bands(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most selective rows per band whose bands reach ``recall`` at ``threshold`` within ``most`` hashes."""
    best = None
    for rows in range(1, most + 1):
        bands = ceil(log(1 - recall) / log(1 - threshold**rows))
        if bands * rows <= most:
            best = bands, rows
    if best is None:
        raise ValueError("the recall needs more hashes")
    return best


def mix(x: np.ndarray) -> np.ndarray:
    """Avalanche of 64-bit numbers (finaliser of the splitmix generator, fixed values)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def span_hashes(tokens: list[list[bytes]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-gram of each word list, and the list it stands in; a list of fewer than ``n`` words is one n-gram."""
    counts = np.fromiter(map(len, tokens), np.int64, len(tokens))
    data = np.frombuffer(b"".join(b" ".join(t) + b" " for t in tokens), np.uint8)
    ends = np.flatnonzero(data == 32)  # the space after each word; a text without words leaves a lone space
    # Polynomial hash of every span from prefix sums: sum of byte * base^position, divided by base^start.
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = np.cumprod(np.concatenate([[_U(1)], np.full(len(data), base, _U)]), dtype=_U)
    unpower = np.cumprod(np.concatenate([[_U(1)], np.full(len(data), inverse, _U)]), dtype=_U)
    summed = np.concatenate([[_U(0)], np.cumsum((data.astype(_U) + _U(1)) * power[:-1], dtype=_U)])
    slots = np.maximum(counts, 1)
    word_end = ends
    word_start = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    first_word = np.concatenate([[0], np.cumsum(slots)[:-1]]).astype(np.int64) if len(slots) else slots
    grams = np.where(counts == 0, 0, np.maximum(counts - n + 1, 1))
    doc = np.repeat(np.arange(len(tokens)), grams)
    at = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first_word, grams)
    last = at + np.repeat(np.minimum(counts, n), grams) - 1
    start, end = word_start[at], word_end[last]
    return mix((summed[end] - summed[start]) * unpower[start] + (end - start).astype(_U)), doc


def ngram_hashes(texts: list[str], n: int = NGRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit n-gram hashes of each text, sorted per text, and the offsets at which texts begin (one more at the end).

    A text of fewer than ``n`` words has one n-gram, all its words; a text without words has none. A long text is hashed in
    pieces that overlap by ``n`` - 1 words, so what is held at once is bounded by the piece.
    """
    made: list[np.ndarray] = [np.zeros(0, _U)]
    owners: list[np.ndarray] = [np.zeros(0, np.int64)]
    runs: list[list[bytes]] = []
    owner: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if runs:
            hashes, run = span_hashes(runs, n)
            made.append(hashes)
            owners.append(np.array(owner, np.int64)[run])
        runs.clear()
        owner.clear()
        held = 0

    for d, text in enumerate(texts):
        found = words(text)
        if len(text) > LONG_WORD // 4 and max(map(len, found), default=0) > LONG_WORD:
            found = [w if len(w) <= LONG_WORD else b"\x01" + blake2b(w).hexdigest().encode() for w in found]
        for at in range(0, max(1, len(found) - n + 1), PIECE_WORDS):
            runs.append(found[at:at + PIECE_WORDS + n - 1])
            owner.append(d)
            held += len(runs[-1])
            if held >= PIECE_WORDS:
                flush()
    flush()
    hashes, doc = np.concatenate(made), np.concatenate(owners)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    fresh = np.ones(len(doc), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    doc, hashes = doc[fresh], hashes[fresh]
    return hashes, np.searchsorted(doc, np.arange(len(texts) + 1))


def batches_by_bytes(texts: list[str], most: int = 512) -> Iterator[slice]:
    """Slices of at most ``most`` texts and of bounded bytes (a longer text has one of its own)."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if i > begin and (i - begin == most or held + len(text) > BATCH_BYTES):
            yield slice(begin, i)
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield slice(begin, len(texts))


def band_hashes(hashes: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash signature per text, hashed per band: (texts, bands). Texts without n-grams must be left out."""
    seeds = mix(np.arange(1, bands * rows + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    out = np.zeros((len(offsets) - 1, bands), _U)
    low = (hashes >> _U(32)).astype(np.uint32)
    for band in range(bands):
        for row in range(rows):
            seed = int(seeds[band * rows + row])
            lowest = np.minimum.reduceat((low ^ np.uint32(seed >> 32)) * np.uint32(seed & 0xFFFFFFFF | 1), offsets[:-1])
            out[:, band] = mix(out[:, band] * _U(31) + lowest + _U(row + 1))
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """``doc_id, text_key, set_key, grams, bands`` per row of ``doc_id, text, text_key``; set_key names the n-gram set, null for a
    text without words."""
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in batches_by_bytes(batch["text"].tolist()):
                part = batch.iloc[at]
                hashes, offsets = ngram_hashes(part["text"].tolist(), n)
                full = np.flatnonzero(np.diff(offsets) > 0)
                keys: list[bytes | None] = [None] * len(part)
                made: list[np.ndarray] = [np.zeros(0, np.int64)] * len(part)
                if len(full):
                    begins = np.append(offsets[full], offsets[-1])
                    both = [np.add.reduceat(mix(hashes ^ _U(s)), begins[:-1]) for s in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
                    sizes = np.diff(begins).astype(_U)
                    name = np.stack([*both, sizes], 1)
                    bits = band_hashes(hashes, begins, bands, rows).view(np.int64)
                    for i, d in enumerate(full):
                        keys[d], made[d] = name[i].tobytes(), bits[i]
                yield pd.DataFrame({"doc_id": part["doc_id"].array, "text_key": part["text_key"].array, "set_key": keys, "grams": np.diff(offsets), "bands": made})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInPandas(sign, f"doc_id {kind}, text_key long, set_key binary, grams long, bands array<long>")


def verify(group: pd.DataFrame, left: np.ndarray, right: np.ndarray, band: int, threshold: float, n: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Verified pairs between two position sets (the same set: pairs within it): partners, their copies, forest edges."""
    m = len(group)
    hashes, offsets = ngram_hashes(group["text"].tolist(), n)
    size, doc = np.diff(offsets), np.repeat(np.arange(m), np.diff(offsets))
    _, code = np.unique(hashes, return_inverse=True)
    order = np.argsort(code, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=1))])
    holders = doc[order]
    keys, copies = np.array(group["bands"].tolist(), np.int64), group["copies"].to_numpy(np.int64)
    partners, weight, edges = np.zeros(m, np.int64), np.zeros(m, np.int64), []
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    same = len(left) == len(right) and bool((left == right).all())
    for i in left:
        others = right[right > i] if same else right
        if band and len(others):
            others = others[~(keys[others, :band] == keys[i, :band]).any(1)]  # they met in an earlier band
        if not len(others):
            continue
        mine = code[offsets[i]:offsets[i + 1]]
        if len(others) <= 8:
            shared = np.array([np.isin(code[offsets[j]:offsets[j + 1]], mine, assume_unique=True).sum() for j in others])
        else:  # the holders of each of its n-grams, counted per text
            n_held = cut[mine + 1] - cut[mine]
            held = np.arange(n_held.sum()) + np.repeat(cut[mine] - np.cumsum(n_held) + n_held, n_held)
            shared = np.bincount(holders[held], minlength=m)[others]
        linked = others[shared >= threshold * (size[i] + size[others] - shared) - 1e-9]
        partners[i] += len(linked)
        partners[linked] += 1
        weight[i] += copies[linked].sum()
        weight[linked] += copies[i]
        for j in linked[parent[linked] != root(i)]:
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
                edges.append((i, j))
    return partners, weight, edges


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node of each connected component of ``a, b``.

    Each round gives every node the smallest label among its neighbours' and then its label's label, until none changes; the
    tables of a round are written, so a hot node's rows can be split in the joins.
    """
    both = keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "near-edges")
    labels = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("root")), "near-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        met = labels.join(seen, "node", "left").select("node", "root", F.least("root", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("root").alias("above"))
        after = met.join(up, "new", "left").select("node", F.least("new", "above").alias("root"), (F.least("new", "above") < F.col("root")).alias("moved"))
        after = keep(after, "near-labels")
        if not after.where("moved").limit(1).count():
            return after.select("node", "root")
        labels = after.select("node", "root")


def document_classes(docs: DataFrame, n: int = NGRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK,
                     id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with ``text_key``, a hash that tells the texts of a repeated identifier apart."""
    bands, rows = choose_bands(threshold, recall)
    docs = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), F.xxhash64(text_of(text_column)).alias("text_key"))
    signed = keep(signatures(docs, n, bands, rows), "near-signed")
    named = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = named.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"), F.first("grams").alias("grams"))
    reps = keep(reps.select("set_key", F.col("rep.doc_id").alias("rep"), F.col("rep.text_key").alias("rep_text"), "copies", "bands", "grams"), "near-reps")
    met = reps.select("set_key", "grams", F.posexplode("bands").alias("band", "hash"))
    buckets = met.groupBy("band", "hash").agg(
        F.count(F.lit(1)).alias("m"), F.sum("grams").alias("grams"), F.bit_xor(F.xxhash64("set_key")).alias("h1"), F.bit_xor(F.xxhash64("set_key", F.lit(1))).alias("h2"))
    # Of buckets with the same members, the one of the earliest band.
    buckets = buckets.where("m > 1").groupBy("m", "grams", "h1", "h2").agg(F.min(F.struct("band", "hash")).alias("first")).select("first.band", "first.hash", "m", "grams")
    buckets = keep(buckets, "near-buckets")
    members = met.drop("grams").join(buckets, ["band", "hash"])
    blocks = F.greatest(F.ceil(F.col("m") / block), F.least("m", F.ceil(F.col("grams") / BLOCK_GRAMS)))
    members = keep(members.select("set_key", "band", "hash", blocks.alias("blocks"), bucket_of(blocks, F.col("set_key")).alias("own")), "near-members")
    wanted = reps.join(members.select("set_key").distinct(), "set_key").select("set_key", "rep", "rep_text", "copies", "bands")
    texts = docs.join(wanted, (docs["doc_id"] == wanted["rep"]) & (docs["text_key"] == wanted["rep_text"]))
    texts = texts.select("set_key", "text", "copies", "bands").dropDuplicates(["set_key"])  # repeated rows
    meets = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    meets = meets.select("set_key", "band", "hash", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def check(key, group: pd.DataFrame) -> pd.DataFrame:
        band, _, x, y = key
        group = group.sort_values("set_key", kind="stable").reset_index(drop=True)
        own = group["own"].to_numpy()
        left = np.flatnonzero(own == x)
        right = np.flatnonzero(own == y)
        partners, weight, edges = verify(group, left, right, int(band), threshold, n)
        ids = group["set_key"].tolist()
        some = np.flatnonzero(partners)
        return pd.DataFrame({
            "a": [ids[i] for i in some] + [ids[i] for i, _ in edges],
            "b": [None] * len(some) + [ids[j] for _, j in edges],
            "partners": np.concatenate([partners[some], np.zeros(len(edges), np.int64)]),
            "links": np.concatenate([weight[some], np.zeros(len(edges), np.int64)])})

    found = meets.join(texts, "set_key").groupBy("band", "hash", "x", "y").applyInPandas(check, "a binary, b binary, partners long, links long")
    found = keep(found, "near-found")
    roots = components(found.where("b IS NOT NULL").select("a", "b"))
    # The smallest identifier of each component, met from a written table so that a hot component's rows can be split.
    named_roots = keep(roots.join(reps.select(F.col("set_key").alias("node"), "rep"), "node").groupBy("root").agg(F.min("rep").alias("class_id")), "near-roots")
    roots = roots.join(named_roots, "root").select(F.col("node").alias("set_key"), "class_id")
    linked = found.where("b IS NULL").groupBy(F.col("a").alias("set_key")).agg(F.sum("partners").alias("partners"), F.sum("links").alias("links"))
    classes = reps.select("set_key", "rep", "copies").join(linked, "set_key", "left").join(roots, "set_key", "left")
    classes = keep(classes.select("set_key", F.coalesce("class_id", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"),
                                  F.coalesce("partners", F.lit(0)).alias("partners"), "copies"), "near-classes")
    out = signed.drop("bands").join(classes, "set_key", "left")
    return out.select("doc_id", "text_key", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                      F.coalesce("partners", F.lit(0)).alias("n_partner_texts"), F.coalesce("copies", F.lit(1)).alias("n_copies"))


def near_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """One row per input row: ``doc_id, class_id, n_links, n_partner_texts, n_copies``.

    Two texts link when the Jaccard similarity of their word n-gram sets is at least ``threshold``. ``class_id`` is the smallest
    identifier of the connected component (the texts of a repeated identifier are looked at each by
    itself), ``n_links`` the number of other rows that link to the row, ``n_copies`` that of rows with the same n-gram set, itself
    included, ``n_partner_texts`` that of different linked sets. Texts without words (null,
    empty) link to nothing. Rows with a null identifier link to nothing. An empty table gives no rows; other columns are not read.
    """
    return document_classes(docs, **settings).drop("text_key")


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """One row of each class of near duplicates, that with the smallest identifier, with all its columns.

    Rows with a null identifier and texts without words stay. Rows equal in identifier and text stay or go together. An empty
    table stays empty.
    """
    classes = document_classes(docs, id_column=id_column, text_column=text_column, **settings)
    others = classes.where("doc_id <> class_id").select(F.col("doc_id").alias("__dropped"), F.col("text_key").alias("__text")).distinct()
    same = (docs[id_column] == others["__dropped"]) & (F.xxhash64(F.coalesce(docs[text_column], F.lit(""))) == others["__text"])
    return docs.join(others, same, "left_anti")


def op9_ngram_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = None
