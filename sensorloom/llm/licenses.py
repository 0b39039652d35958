"""Scan for license notices by an exact set-similarity join of text blocks with templates.

A block is a window of words, as their set: every run of twice as many consecutive words as the template has, line breaks or
not, so a notice lies in one wherever it stands and however it wraps. Blocks may also be the lines of a text. A block matches a
template when it holds at least a share ``threshold`` of the template's words. Words are ordered by the number of blocks that
hold them, over all documents, rarest first. A match then shares one of the template's first words in that order (prefix
filter), has enough words (length filter), and from the rarest of its words on enough ranks and places must remain (positional
filter). Blocks that pass are compared in full.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import table, words

#: Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices looked for by word sets, with their labels.
TEMPLATES = {
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3.": "gpl-3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted.": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": "mpl-2",
}

THRESHOLD = 0.9


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]  # rarest first
    need: int  # shared words of a match
    width: int  # words of a window

    @property
    def prefix(self) -> tuple[bytes, ...]:
        return self.words[: len(self.words) - self.need + 1]


def windows_holding(tokens: list[bytes], vocabulary: set[bytes], width: int) -> dict[bytes, int]:
    """Number of places from which a window of ``width`` words holds each word of the vocabulary."""
    last: dict[bytes, int] = {}
    held: dict[bytes, int] = {}
    for at, w in enumerate(tokens):
        if w in vocabulary:
            held[w] = held.get(w, 0) + min(width, at - last.get(w, -1))
            last[w] = at
    return held


def block_counts(docs: DataFrame, vocabulary: set[bytes], width: int | None = None, text_column: str = "text") -> dict[bytes, int]:
    """Number of blocks, over all documents, that hold each word of a vocabulary (that of the templates, so a bounded result).

    Blocks are the windows of ``width`` words, or the lines of a text where it is None.
    """
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: Counter[bytes] = Counter()
            for text in batch["text"]:
                if width is None:
                    for line in (text or "").split("\n"):
                        seen.update(vocabulary.intersection(words(line)))
                else:
                    seen.update(windows_holding(words(text or ""), vocabulary, width))
            if seen:
                yield pd.DataFrame({"word": [w.decode() for w in seen], "blocks": list(seen.values())})

    found = docs.select(F.col(text_column).alias("text")).mapInPandas(count, "word string, blocks long")
    return {r["word"].encode(): r["n"] for r in found.groupBy("word").agg(F.sum("blocks").alias("n")).collect()}


def build_templates(templates: dict[str, str], counts: dict[bytes, int], threshold: float) -> list[Template]:
    out = []
    for notice, label in templates.items():
        own = sorted(set(words(notice)), key=lambda w: (counts.get(w, 0), w))
        if own:
            out.append(Template(label, tuple(own), max(1, ceil(threshold * len(own) - 1e-9)), 2 * len(words(notice))))
    return out


def match_block(block: set[bytes], templates: list[Template], by_prefix: dict[bytes, list[int]]) -> Iterator[tuple[str, float]]:
    """(label, containment) of each template that the block matches."""
    for k in {k for w in block if w in by_prefix for k in by_prefix[w]}:
        t = templates[k]
        if len(block) < t.need:
            continue
        missed = 0
        for w in t.words:
            missed += w not in block
            if missed > len(t.words) - t.need:
                break
        else:
            yield t.label, (len(t.words) - missed) / len(t.words)


def match_windows(tokens: list[bytes], templates: list[Template], by_prefix: dict[bytes, list[int]]) -> list[tuple[int, str, float]]:
    """(first word, label, containment) of each template's matches in windows of its width of consecutive words.

    From the left, each match takes the fewest words that suffice and the template's missing words right after them, and the next
    begins behind it. Its containment is that of the window from its first word on. A window that matches holds a prefix word as
    its rarest; only words less than a width from one that passes the positional filter are looked at.
    """
    anchored = {k for w in set(tokens).intersection(by_prefix) for k in by_prefix[w]}
    out = []
    for k in anchored:
        t = templates[k]
        width, rank = t.width, {w: i for i, w in enumerate(t.words)}
        held = [(at, rank[w]) for at, w in enumerate(tokens) if w in rank]
        at_most = [at for at, _ in held]
        # Positional filter: with a prefix word as the rarest of a match, the ranks from it on and the template's words less
        # than a width from it must suffice.
        anchors = [at for at, i in held if i <= len(t.words) - t.need and min(
            len(t.words) - i, bisect_left(at_most, at + width) - bisect_right(at_most, at - width)) >= t.need]
        own, first = set(t.words), 0
        while first < len(anchors):
            last = first
            while last + 1 < len(anchors) and anchors[last + 1] - anchors[last] < 2 * width:
                last += 1
            stretch = range(max(0, anchors[first] - width + 1), min(len(tokens), anchors[last] + width))
            found = [(at, tokens[at]) for at in stretch if tokens[at] in own]
            first, low, i, inside = last + 1, 0, 0, Counter()
            while i < len(found) and len(found) >= t.need:
                inside[found[i][1]] += 1
                while found[low][0] <= found[i][0] - width or inside[found[low][1]] > 1:
                    inside[found[low][1]] -= 1
                    if not inside[found[low][1]]:
                        del inside[found[low][1]]
                    low += 1
                i += 1
                if len(inside) >= t.need:
                    begin = found[low][0]
                    near = set(inside)
                    for at, w in found[i:i + width]:
                        if at < begin + width:
                            near.add(w)
                    out.append((begin, t.label, len(near) / len(t.words)))
                    while i < len(found) and found[i][0] < begin + width and found[i][1] not in inside:
                        inside[found[i][1]] += 1
                        i += 1
                    low, inside = i, Counter()
    return sorted(out)


def phrase_places(tokens: list[bytes], phrases: dict[bytes, str]) -> list[tuple[int, str]]:
    """(first word, label) of every place where the words of a phrase stand consecutively."""
    line = b" " + b" ".join(tokens) + b" "
    out = []
    for phrase, label in phrases.items():
        seen, place = 0, 0  # the spaces before ``seen``
        at = line.find(b" " + phrase + b" ")
        while at >= 0:
            place, seen = place + line.count(b" ", seen, at), at
            out.append((place, label))
            at = line.find(b" " + phrase + b" ", at + 1)
    return out


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD, id_column: str = "doc_id", text_column: str = "text", windows: bool = False) -> DataFrame:
    """One row per input row: ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks``.

    Base: places where a phrase's words stand consecutively in the whole text. ``blocks`` lists the matching blocks as (line
    number from 0, label, share of the template's words), with ``windows`` by the line of a match's first word; ``labels`` joins theirs with the base's; ``score`` is the largest
    share, 1 where a phrase stands. Null and empty texts have no words, no labels and score 0. Other columns are not read.
    """
    phrases, templates = PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates
    vocabulary = {w for notice in templates for w in words(notice)}
    width = 2 * max((len(words(notice)) for notice in templates), default=0)
    built = build_templates(templates, block_counts(docs, vocabulary, width if windows else None, text_column), threshold)
    by_prefix: dict[bytes, list[int]] = {}
    for k, t in enumerate(built):
        for w in t.prefix:
            by_prefix.setdefault(w, []).append(k)
    keyed = {b" ".join(words(p)): label for p, label in phrases.items()}

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                lines = [words(line) for line in (text or "").split("\n")]
                tokens = [w for line in lines for w in line]
                places = phrase_places(tokens, keyed)
                if by_prefix.keys().isdisjoint(tokens):
                    blocks = []
                elif windows:
                    ends = list(accumulate(map(len, lines)))
                    blocks = [(bisect_right(ends, at), label, share) for at, label, share in match_windows(tokens, built, by_prefix)]
                else:
                    blocks = [(i, label, share) for i, line in enumerate(lines) for label, share in sorted(match_block(set(line), built, by_prefix))]
                base = {label for _, label in places}
                starts = [at for at, _ in places]
                out.append((len(tokens), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)),
                            ",".join(sorted(base | {b[1] for b in blocks})), 1.0 if places else max((b[2] for b in blocks), default=0.0), blocks))
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
            made = pd.DataFrame(out, columns=names)
            made["first_word"], made["last_word"] = made["first_word"].astype("Int64"), made["last_word"].astype("Int64")
            made["blocks"] = [[dict(zip(("line", "label", "share"), b)) for b in row] for row in made["blocks"]]
            made.insert(0, "doc_id", batch["doc_id"].array)
            yield made

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).mapInPandas(
        scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
              "score double, blocks array<struct<line: int, label: string, share: double>>")


def op8_license_scan(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"), windows=True).withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")
