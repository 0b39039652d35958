"""Pack tokenised documents into sequences by minimum bin slack.

Documents are cut at the window size; full pieces are sequences of their own. For the rest only the lengths matter, and there
are fewer of them than the window has tokens: a plan is made from the count per length. For each window a bitset of reachable
sums over the remaining lengths, with the longest one set, finds the multiset closest to the window; the counts are traced
back, and the choice is repeated as often as the counts allow. Where no multiset fills the window, one more piece is cut to
close the gap, and its tail goes back to the lengths. The pieces then find their place by their rank among the pieces of equal
length, so one exchange of the rests is all that moves.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorloom.llm.common import bucket_of, keep, start_offsets, table, text_of

WINDOW, END, RANKS, CACHED_WORDS = 1024, 0, "byte_bpe_50k.tiktoken", 450_000


@lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """Function from a text to its ids as little-endian unsigned 32-bit bytes.

    The ranks and the tokenizer file hold one vocabulary; tests compare the ids. A single space before a character that is not
    white space always begins a token, so words between such spaces are encoded on their own and remembered: up to
    ``CACHED_WORDS``, some 90 MB, since a word that is not costs ten times as much. Most words stand once or twice in a corpus:
    those seen again keep their place, up to two thirds of all, and the others make room together when the rest is full.
    """
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    special = {"<|endoftext|>": len(ranks)}
    bpe = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    known: dict[str, bytes] = {}
    recent: dict[str, bytes] = {}

    def whole(text: str) -> bytes:
        return array("I", bpe.encode(text, allowed_special="all")).tobytes()

    def encode(text: str) -> bytes:
        parts = text.split(" ")
        ids = list(map(known.get, parts))
        ids[0] = whole(parts[0])
        if None in ids:
            for i, got in enumerate(ids):
                if got is None:
                    word = parts[i]
                    if not word or word[0].isspace():
                        return whole(text)
                    got = recent.get(word)
                    if got is None:
                        got = whole(" " + word)
                        if len(known) + len(recent) >= CACHED_WORDS:
                            recent.clear()
                        recent[word] = got
                    elif 3 * len(known) < 2 * CACHED_WORDS:
                        known[word] = recent.pop(word)
                    ids[i] = got
        return b"".join(ids)

    return encode


@dataclass(frozen=True)
class Use:
    """Pieces of one length from rank ``first`` on, ``each`` per sequence, in ``times`` sequences from ``sequence`` on.

    ``offset`` is where the first of them stands. A piece that is cut gives its first ``head`` tokens; its tail is a piece of
    the remaining length with rank ``tail`` and up.
    """

    first: int
    each: int
    times: int
    sequence: int
    offset: int
    head: int = 0
    tail: int = 0


def fill(counts: dict[int, int], window: int) -> dict[int, int]:
    """The multiset of remaining lengths, with the longest among them, whose sum is closest to the window from below."""
    longest = max(counts)
    left, room, mask = {**counts, longest: counts[longest] - 1}, window - longest, (1 << (window - longest + 1)) - 1
    lengths = sorted((n for n, c in left.items() if c and n <= room), reverse=True)
    reach, steps = 1, []
    for n in lengths:
        steps.append(reach)
        times, step = min(left[n], room // n), 1
        while times:  # sums with up to that many of n, by doubling
            step = min(step, times)
            reach |= (reach << (step * n)) & mask
            times -= step
            step *= 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, {longest: 1}
    for n, before in zip(reversed(lengths[: len(steps)]), reversed(steps)):
        used = 0
        while not before >> at & 1:
            at -= n
            used += 1
        if used:
            chosen[n] = chosen.get(n, 0) + used
    return chosen


def plan(counts: dict[int, int], window: int) -> tuple[dict[int, list[Use]], int]:
    """Uses per length, in order of rank, and the number of sequences."""
    counts = {n: c for n, c in counts.items() if c}
    taken, made = dict.fromkeys(counts, 0), dict(counts)  # ranks used and ranks given out, per length
    uses: dict[int, list[Use]] = {}
    sequence = 0
    while counts:
        chosen = fill(counts, window)
        gap = window - sum(n * c for n, c in chosen.items())
        cut = 0
        if gap:
            rest = {n: c - chosen.get(n, 0) for n, c in counts.items()}
            cut = max((n for n, c in rest.items() if c and n > gap), default=0)
        need = {**chosen, cut: chosen.get(cut, 0) + 1} if cut else chosen
        times = min(counts[n] // c for n, c in need.items())
        offset = 0
        for n, each in sorted(chosen.items(), reverse=True):
            uses.setdefault(n, []).append(Use(taken[n], each, times, sequence, offset))
            taken[n] += each * times
            offset += n * each
        if cut:
            tail = cut - gap
            uses.setdefault(cut, []).append(Use(taken[cut], 1, times, sequence, offset, gap, made.get(tail, 0)))
            taken[cut] += times
            made[tail], counts[tail] = made.get(tail, 0) + times, counts.get(tail, 0) + times
            taken.setdefault(tail, 0)
        for n, each in need.items():
            counts[n] -= each * times
            if not counts[n]:
                del counts[n]
        sequence += times
    return uses, sequence


def places(uses: dict[int, list[Use]], firsts: dict[int, list[int]], length: int, rank: int) -> Iterator[tuple[int, int, int]]:
    """(length, sequence, offset) of the pieces into which a rest of ``length`` tokens with this rank goes."""
    while length:
        use = uses[length][bisect_right(firsts[length], rank) - 1]
        time, nth = divmod(rank - use.first, use.each)
        head = use.head or length
        yield head, use.sequence + time, use.offset + nth * length
        length, rank = length - head, use.tail + rank - use.first


def cut_documents(docs: DataFrame, window: int, ranks_path: str, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, doc_tokens, full (checksum of each full piece), rest (ids of the last piece), rest_tokens``."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(ranks_path), array("I", [END]).tobytes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = encode(text) + end
                n = len(ids) // 4
                full = n // window
                out.append((n, [zlib.crc32(ids[4 * window * i:4 * window * (i + 1)]) for i in range(full)], ids[4 * window * full:], n - window * full))
            made = pd.DataFrame(out, columns=["doc_tokens", "full", "rest", "rest_tokens"])
            made.insert(0, "doc_id", batch["doc_id"].array)
            yield made

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInPandas(
        cut, f"doc_id {kind}, doc_tokens long, full array<long>, rest binary, rest_tokens int")


def pack(docs: DataFrame, window: int = WINDOW, ranks_path: str | None = None, id_column: str = "doc_id", text_column: str = "text",
         buckets: int | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Every document, null and empty texts included, ends with id 0; each id lies in one piece. All sequences but the last are
    full. Rows that repeat an identifier are documents of their own. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = keep(cut_documents(docs, window, ranks_path or public_tokenizers.path(RANKS), id_column, text_column), "pack-cut")
    counts = {r["rest_tokens"]: r["count"] for r in cut.where("rest_tokens > 0").groupBy("rest_tokens").count().collect()}  # fewer rows than a window has tokens
    uses, sequences = plan(counts, window)
    firsts = {n: [u.first for u in of] for n, of in uses.items()}
    # Ranks within a length: in hash buckets of bounded size, so that no length is a single group.
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    rows = cut.withColumn("bucket", bucket_of(buckets, F.col("doc_id")))
    keys = ["rest_tokens", "bucket"]
    cells = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("full")).alias("n_full"))
    ranks = start_offsets(cells, ["rest_tokens"], "bucket", "n").select(*keys, F.col("start").alias("rank_before"))
    cells = cells.withColumn("cell", F.col("bucket") * window + F.col("rest_tokens"))
    fulls = start_offsets(cells, [], "cell", "n_full").select(*keys, F.col("start").alias("full_before"))
    inside = Window.partitionBy(*keys).orderBy("doc_id", "doc_tokens", F.crc32("rest"))
    rows = rows.withColumn("rank", F.row_number().over(inside) - 1)
    rows = rows.withColumn("fulls", F.sum(F.size("full")).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.size("full"))
    rows = rows.join(ranks, keys).join(fulls, keys).select(
        "doc_id", "doc_tokens", "full", "rest", "rest_tokens", (F.col("rank_before") + F.col("rank")).alias("rank"),
        (F.col("full_before") + F.col("fulls") + sequences).alias("first_full"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, n, full, rest, length, rank, first in batch.itertuples(index=False, name=None):
                start = 0
                for crc in full:
                    out.append((doc, start, window, crc, n, first, 0))
                    start, first = start + window, first + 1
                at = 0
                for piece, sequence, offset in places(uses, firsts, length, rank):
                    out.append((doc, start, piece, zlib.crc32(rest[4 * at:4 * (at + piece)]), n, sequence, offset))
                    start, at = start + piece, at + piece
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return rows.mapInPandas(place, f"doc_id {docs.select(id_column).schema[0].dataType.simpleString()}, start long, length long, "
                                   "ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op1_min_slack_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))


SQL = None
