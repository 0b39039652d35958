"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with a context tree over the preceding bytes. A node at depth d has the zeros and ones
seen after d context bytes, whose Krichevsky-Trofimov estimate is mixed with the product of its children's weighted
probabilities, half and half; below the deepest nodes there is only the estimate. With the counts of all training texts, the
mixture's posterior weights along a context's path give the probability of the next bit, and eight of them that of a byte.

Texts lie in hash chunks. A chunk names its distinct contexts with next byte, and its distinct words, with their counts in its
training texts. What it names is dealt into buckets, contexts by their last two bytes and words by a hash, and leaves as one row
of packed numbers per bucket. Counts are summed per bucket over all chunks, trees are weighted per bucket (one sort of its grams
per depth serves all eight decisions), and every chunk gets back the values of what it named. So neither texts nor the model are
gathered anywhere, and the model grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log10

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, crc_mod, keep, table, text_of

DEPTH, CHUNK_BYTES, BATCH_BYTES = 5, 12 << 20, 1 << 19
#: Grams looked at, or words given out, at once.
SLICE = 1 << 18
#: Buckets for every so many chunks: a bucket's packed rows of all chunks stay small however large the corpus is.
BUCKETS, BUCKET_CHUNKS = 256, 4096
TOP = 2  # context bytes that grams weighted together share
EDGE = b"\xff"  # before the first byte and after the last; no text has it in UTF-8
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64


def lowered(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(LOWER_BYTES)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per byte and end of text: the preceding bytes, nearest highest, and the byte itself in the lowest place; the texts' starts."""
    edge = EDGE * DEPTH
    data = np.frombuffer(b"".join(part for t in texts for part in (edge, t, EDGE)), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    starts = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) + np.repeat((np.arange(len(texts)) + 1) * DEPTH, lengths)
    wide = data.astype(_U)
    key = wide.copy()
    for back in range(1, DEPTH + 1):
        key[back:] |= wide[:-back] << _U(8 * (DEPTH + 1 - back))
    return key[at], starts


def batches(texts: list[bytes]):
    """Slices of the texts of about the batch size."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BATCH_BYTES or i == len(texts) - 1:
            yield first, i + 1
            first, size = i + 1, 0


class Lookup:
    """Values of sorted keys by a multiplicative hash; keys that lost their slot to another are searched for."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(16, len(keys).bit_length() + 3)
        self.keys, self.values, self.shift = keys, values, _U(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, asked: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(asked)]
        lost = self.keys[at] != asked
        at[lost] = np.searchsorted(self.keys, asked[lost])
        return self.values[at]


def name_parts(batches_of_chunk: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A chunk's distinct grams (kind 1) and words (kind 0, numbered in order) with their counts in its training texts.

    Beyond the texts only one number per byte is held; what is made from them leaves in slices.
    """
    texts, flags, chunk = [], [], 0
    for rows in batches_of_chunk:
        texts += [lowered(t) for t in rows["text"]]
        flags.append(~rows["held_out"].to_numpy())
        chunk = int(rows["chunk"].iloc[0])
    train = np.concatenate(flags)
    words: Counter[bytes] = Counter()
    others: set[bytes] = set()
    # All grams of the chunk in one sort; a gram takes 56 bits, the lowest tells whether it stands in a training text.
    every = np.empty(sum(map(len, texts)) + len(texts), _U)
    filled = 0
    for first, end in batches(texts):
        key, starts = grams(texts[first:end])
        every[filled:filled + len(key)] = key << _U(1) | np.repeat(train[first:end], np.diff(np.append(starts, len(key)))).astype(_U)
        filled += len(key)
        for text, trains in zip(texts[first:end], train[first:end]):
            if trains:
                words.update(text.split())
            else:
                others.update(text.split())
    texts.clear()
    every.sort()
    at = 0
    while at < len(every):
        # Up to the end of a gram's run.
        last = every[min(at + SLICE, len(every)) - 1] | _U(1)
        part, at = every[at:(end := int(np.searchsorted(every, last, "right")))], end
        keys = part >> _U(1)
        begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.add.reduceat((part & _U(1)).astype(np.int64), begins)
        yield pd.DataFrame({"chunk": chunk, "kind": 1, "number": 0, "gram": keys[begins].astype(np.int64), "word": None, "n": n})
    known = sorted(words.keys() | others)
    for first in range(0, len(known), SLICE):
        some = known[first:first + SLICE]
        yield pd.DataFrame({"chunk": chunk, "kind": 0, "number": np.arange(first, first + len(some)), "gram": 0, "word": some,
                            "n": np.array([words[w] for w in some], np.int64)})


def packed(numbers: np.ndarray) -> bytes:
    """Numbers of eight bytes, their first bytes first, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T).view(kind).ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, as steps from one to the next."""
    return packed(np.diff(keys, prepend=_U(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, _U), dtype=_U)


def packed_words(words: list[bytes]) -> bytes:
    """Words hold no white space."""
    return zlib.compress(b" ".join(words), 1)


def unpacked_words(data: bytes) -> list[bytes]:
    return zlib.decompress(data).split(b" ")


def bucket_of_grams(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Grams that share their context's last two bytes share a bucket."""
    mixed = (keys >> _U(8 * (DEPTH + 1 - TOP))) * _U(40503) & _U(0xFFFF)
    return (mixed * _U(buckets) >> _U(16)).astype(np.int64)


def pack_parts(batches_of_chunk: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    """What ``name_parts`` names, one row per slice and bucket: sorted grams or words in ``body``, their counts in ``n``."""
    for part in name_parts(batches_of_chunk):
        kind, n, words = int(part["kind"].iloc[0]), part["n"].to_numpy(), part["word"].tolist()
        keys = part["gram"].to_numpy(np.int64).astype(_U)
        bucket = bucket_of_grams(keys, buckets) if kind else np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        some, begins = np.unique(bucket[order], return_index=True)
        runs = np.split(order, begins[1:])
        yield pd.DataFrame({"chunk": int(part["chunk"].iloc[0]), "kind": kind, "bucket": some,
                            "body": [packed_keys(keys[at]) if kind else packed_words([words[i] for i in at]) for at in runs],
                            "n": [packed(n[at]) for at in runs]})


def summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their numbers."""
    every, at = np.concatenate(keys), np.concatenate(n)
    order = np.argsort(every, kind="stable")
    every, at = every[order], at[order]
    begins = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    return every[begins], np.add.reduceat(at, begins)


def sum_grams(batches_of_bucket: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bucket's distinct grams with their counts over all chunks, in slices; summed whenever the unsummed outnumber the sums."""
    keys, n, waiting, bucket = [], [], 0, 0
    for rows in batches_of_bucket:
        bucket = int(rows["bucket"].iloc[0])
        for body, counts in zip(rows["body"], rows["n"]):
            keys.append(unpacked_keys(body))
            n.append(unpacked(counts))
            waiting += len(keys[-1])
            if waiting > max(SLICE, len(keys[0])):
                keys, n = map(list, zip(summed(keys, n)))
                waiting = 0
    key, count = summed(keys, n)
    for first in range(0, len(key), SLICE):
        some = slice(first, first + SLICE)
        yield pd.DataFrame({"bucket": [bucket], "body": [packed_keys(key[some])], "n": [packed(count[some])]})


def count_words(batches_of_bucket: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every chunk's words of a bucket with their counts over all chunks; once per bucket, all its words' number in the training
    texts (``tokens``) and how many of them occur there (``seen``). The chunks' rows wait as they are packed."""
    counts: Counter[bytes] = Counter()
    waiting = []
    for rows in batches_of_bucket:
        for body, n in zip(rows["body"], rows["n"]):
            for word, more in zip(unpacked_words(body), unpacked(n).tolist()):
                counts[word] += more
        waiting.append(rows[["chunk", "body"]])
    tokens, seen = sum(counts.values()), sum(n > 0 for n in counts.values())
    for rows in waiting:
        rows = rows.assign(value=[packed(np.fromiter(map(counts.__getitem__, unpacked_words(body)), np.int64)) for body in rows["body"]],
                           tokens=0, seen=0)
        rows.iloc[0, -2:] = tokens, seen
        tokens = seen = 0
        yield rows


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for positive numbers: Stirling's series after a shift."""
    shift = np.log(x)
    for k in range(1, 8):
        shift = shift + np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


#: Log gamma of small counts plus one half and plus one.
_HALF, _WHOLE = (log_gamma(np.arange(1 << 12) + shift) for shift in (0.5, 1.0))


def log_gamma_of(table: np.ndarray, counts: np.ndarray, shift: float) -> np.ndarray:
    out = table[np.minimum(counts, len(table) - 1)]
    large = counts >= len(table)
    out[large] = log_gamma(counts[large] + shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of whole-numbered counts."""
    return log_gamma_of(_HALF, zeros, 0.5) + log_gamma_of(_HALF, ones, 0.5) - log_gamma_of(_WHOLE, zeros + ones, 1.0) - log(np.pi)


def weigh(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log weighted probability of nodes, and the posterior weight of their own estimate; below: sum over their children."""
    own = log_kt(zeros, ones)
    total = np.logaddexp(own, below) - log(2)
    return total, np.exp(own - log(2) - total)


@dataclass(frozen=True)
class Decision:
    """One of a byte's eight decisions: the top level's nodes (last byte, name, zeros, ones, log weighted probability), and per gram
    its node's name, its bit and the bit's probability under the mixture of the depths from the top level on."""

    last: np.ndarray
    name: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray
    total: np.ndarray
    node: np.ndarray
    bit: np.ndarray
    p: np.ndarray


def subtree(keys: np.ndarray, n: np.ndarray, top: int) -> Iterator[Decision]:
    """Weighted trees of the sorted grams' eight decisions, from the deepest context down to ``top`` bytes.

    The distinct grams of every depth are sorted once; a decision's nodes are then runs of neighbours that share the context and
    the byte's higher bits.
    """
    level_keys, level_n, up = [keys], [n], []
    for _ in range(top, DEPTH):
        shorter, at = np.unique(level_keys[-1] >> _U(16) << _U(8) | level_keys[-1] & _U(255), return_inverse=True)
        level_n.append(np.bincount(at, level_n[-1], len(shorter)).astype(np.int64))
        level_keys.append(shorter)
        up.append(at)
    levels = len(level_keys)
    bytes_of = [(k & _U(255)).astype(np.int64) for k in level_keys]
    for level in range(8):
        which, begins, zeros, ones, own, total, bits = [], [], [], [], [], [], []
        for d in range(levels):  # from the deepest
            name = level_keys[d] >> _U(8 - level)
            fresh = np.append(True, name[1:] != name[:-1])
            which.append(np.cumsum(fresh) - 1)
            begins.append(np.flatnonzero(fresh))
            bits.append(bytes_of[d] >> (7 - level) & 1)
            both = np.add.reduceat(level_n[d], begins[d])
            ones.append(np.add.reduceat(level_n[d] * bits[d], begins[d]))
            zeros.append(both - ones[d])
            if d == 0:
                total.append(log_kt(zeros[d], ones[d]))
                own.append(np.ones(len(both)))
            else:
                below = np.bincount(which[d][up[d - 1][begins[d - 1]]], total[d - 1], len(both))
                both_values = weigh(zeros[d], ones[d], below)
                total.append(both_values[0])
                own.append(both_values[1])
        p, left = 0.0, 1.0
        for d in range(levels - 1, -1, -1):  # from the top
            weight = own[d][which[d]]
            seen = np.where(bits[d] == 1, ones[d][which[d]], zeros[d][which[d]])
            estimate = (seen + 0.5) / ((zeros[d] + ones[d])[which[d]] + 1.0)
            if d < levels - 1:
                p, left = p[up[d]], left[up[d]]
            p, left = p + left * weight * estimate, left * (1 - weight)
        node = [(1 << level) | (b >> (8 - level)) for b in (bytes_of[-1][begins[-1]], bytes_of[0])]
        last = (level_keys[-1][begins[-1]] >> _U(8 * top)).astype(np.int64)
        yield Decision(last, node[0], zeros[-1], ones[-1], total[-1], node[1], bits[0], p)


def top_nodes(group: pd.DataFrame) -> pd.DataFrame:
    """Per two-byte context and decision: its last byte, zeros, ones and log probability."""
    group = group.sort_values("gram", kind="stable")
    keys = group["gram"].to_numpy(np.int64).astype(_U)
    return pd.concat([pd.DataFrame({"last": d.last, "node": d.name, "zeros": d.zeros, "ones": d.ones, "below": d.total})
                      for d in subtree(keys, group["n"].to_numpy(np.int64), TOP)])


def unpacked_grams(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"gram": np.concatenate([unpacked_keys(b) for b in rows["body"]]).astype(np.int64),
                         "n": np.concatenate([unpacked(n) for n in rows["n"]])})


class Upper:
    """The two highest levels, no and one context byte: at most 256 x 255 nodes, as arrays by last byte and node."""

    def __init__(self, rows: list):
        zeros, ones, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
        for last, node, z, o, b in rows:
            zeros[last, node], ones[last, node], below[last, node] = z, o, b
        total, self.own1 = weigh(zeros, ones, below)
        self.one1 = (ones + 0.5) / (zeros + ones + 1)
        _, self.own0 = weigh(zeros.sum(0), ones.sum(0), total.sum(0))
        self.one0 = (ones.sum(0) + 0.5) / (zeros.sum(0) + ones.sum(0) + 1)

    def mix(self, last: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        one1, one0 = self.one1[last, node], self.one0[node]
        p = self.own1[last, node] * np.where(bit == 1, one1, 1 - one1) + (1 - self.own1[last, node]) * p
        return self.own0[node] * np.where(bit == 1, one0, 1 - one0) + (1 - self.own0[node]) * p


def byte_model(group: pd.DataFrame, upper: Upper) -> pd.DataFrame:
    """log10 of the probability of each gram's byte after its context."""
    group = group.sort_values("gram", kind="stable")
    keys = group["gram"].to_numpy(np.int64).astype(_U)
    p, last = np.ones(len(keys)), (keys >> _U(8 * DEPTH)).astype(np.int64)
    for d in subtree(keys, group["n"].to_numpy(np.int64), TOP):
        p *= upper.mix(last, d.node, d.bit, d.p)
    return pd.DataFrame({"gram": keys.astype(np.int64), "value": np.log10(p)})


def value_grams(batches_of_rows: Iterator[pd.DataFrame], upper: Upper) -> Iterator[pd.DataFrame]:
    """Values of the grams that the chunks named. Rows come sorted by bucket and chunk; a bucket's sums (chunk -1) are its first."""
    sums, model, bucket = [], None, None
    for rows in batches_of_rows:
        out = []
        for r in rows.itertuples(index=False):
            if r.bucket != bucket:
                sums, model, bucket = [], None, r.bucket
            if r.chunk < 0:
                sums.append(r)
                continue
            if model is None:
                model = byte_model(unpacked_grams(pd.DataFrame(sums)), upper)
                keys, values, sums = model["gram"].to_numpy().astype(_U), model["value"].to_numpy(), []
            out.append((r.chunk, 1, r.body, packed(values[np.searchsorted(keys, unpacked_keys(r.body))])))
        yield pd.DataFrame(out, columns=["chunk", "kind", "body", "value"])


def score_chunk(chunk: pd.DataFrame, values: pd.DataFrame, n_tokens: int, n_words: int, n_train: int) -> pd.DataFrame:
    """Scores of a chunk's texts from the values of its grams (kind 1) and the counts of its words (kind 0)."""
    texts = [lowered(t) for t in chunk["text"]]
    of_grams, of_words = values[values["kind"] == 1], values[values["kind"] == 0]
    keys = np.concatenate([unpacked_keys(b) for b in of_grams["body"]])
    order = np.argsort(keys)
    gram_value = Lookup(keys[order], np.concatenate([unpacked(v, float) for v in of_grams["value"]])[order])
    del order, keys
    index = {w: i for i, w in enumerate(w for b in of_words["body"] for w in unpacked_words(b))}
    # The end token is the last.
    of_word = np.concatenate([*(unpacked(v) for v in of_words["value"]), [n_train]]).astype(float)
    logs = np.log10(of_word + 0.5) - log10(n_tokens + 0.5 * (n_words + 1))
    out = []
    for first, end in batches(texts):
        key, starts = grams(texts[first:end])
        scores = np.add.reduceat(gram_value(key), starts)
        for text, score in zip(texts[first:end], scores):
            at = np.fromiter(map(index.__getitem__, text.split()), np.int64)
            at = np.append(at, len(index))
            out.append((len(at), int((of_word[at] > 0).sum()), float(logs[at].sum()), float(score), -float(score) / log10(2) / (len(text) + 1)))
    made = pd.DataFrame(out, columns=["n_tokens", "n_known", "base_score", "score", "bits_per_byte"])
    made.insert(0, "held_out", chunk["held_out"].array)
    made.insert(0, "doc_id", chunk["doc_id"].array)
    return made


def score_texts(docs: DataFrame, held_out, chunk_bytes: int = CHUNK_BYTES, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    ``held_out`` is a boolean column of ``docs``; the model and the base learn from the other rows. ``score`` is the log10
    probability of the text's bytes, A-Z in lower case, and its end; ``bits_per_byte`` the code length per byte, end included.
    The base is a smoothed unigram over words between ASCII white space and the end token. Null and empty texts are their end
    alone. Without training rows all estimates are uniform. An empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text"), held_out.alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text").cast("long")), F.count(F.when(~F.col("held_out"), 1))).first()
    chunks, n_train = max(1, -(-(size[0] or 0) // chunk_bytes)), size[1]
    # Rows of a repeated or null identifier spread by their text.
    rows = rows.withColumn("chunk", bucket_of(chunks, F.col("doc_id"), F.xxhash64("text")).cast("int"))
    buckets = BUCKETS * -(-chunks // BUCKET_CHUNKS)

    def pack(batches_of_chunk: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return pack_parts(batches_of_chunk, buckets)

    named = keep(rows.groupBy("chunk").applyInPandas(pack, "chunk int, kind int, bucket int, body binary, n binary"), "ctw-named")

    words = named.where("kind = 0").groupBy("bucket").applyInPandas(count_words, "chunk int, body binary, value binary, tokens long, seen long")
    words = keep(words, "ctw-words")
    n_tokens, n_words = words.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("seen"), F.lit(0))).first()
    n_tokens, n_words = n_tokens + n_train, n_words + (n_train > 0)

    of_grams = named.where("kind = 1")
    sums = keep(of_grams.groupBy("bucket").applyInPandas(sum_grams, "bucket int, body binary, n binary"), "ctw-sums")
    nodes = sums.groupBy("bucket").applyInPandas(lambda g: top_nodes(unpacked_grams(g)), "last int, node int, zeros long, ones long, below double")
    nodes = nodes.groupBy("last", "node").agg(F.sum("zeros"), F.sum("ones"), F.sum("below"))
    upper = Upper([tuple(r) for r in nodes.collect()])  # at most 256 x 255 rows
    asked = of_grams.select("bucket", "chunk", "body", F.lit(None).cast("binary").alias("n"))
    asked = asked.unionByName(sums.select("bucket", F.lit(-1).alias("chunk"), "body", "n"))
    asked = asked.repartition("bucket").sortWithinPartitions("bucket", "chunk")
    values = asked.mapInPandas(lambda r: value_grams(r, upper), "chunk int, kind int, body binary, value binary")
    values = values.unionByName(words.select("chunk", F.lit(0).alias("kind"), "body", "value"))
    kind = docs.select(id_column).schema[0].dataType.simpleString()
    scored = rows.groupBy("chunk").cogroup(values.groupBy("chunk")).applyInPandas(
        lambda c, v: score_chunk(c, v, n_tokens, n_words, n_train),
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    return scored.withColumn("train_tokens", F.lit(n_tokens).cast("long"))


def op6_context_tree_weighting(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"), crc_mod("doc_id", 5) == 1)


SQL = None
