"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels mark documents; token labels follow from them: a word form or word beginning that stands in far more toxic than clean
training documents is evidence, and a token with evidence in a toxic document is labelled toxic, every other token is not. The
field has two states, a weight per evidence form, a bias and transition weights; it is fitted by gradient ascent on the exact
likelihood of the training segments (sentences, cut at a fixed length). In scoring the chain runs over the whole sentence:
forward-backward goes piece by piece, with messages carried over the cuts, and gives each token's marginal. A document's largest marginal, the sum of those above a floor and its length enter a logistic score; tokens above one half form
the spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import WORD_BYTES, crc_mod, keep, table, text_of

#: The classifier is fitted on a bounded sample: at most so many labelled documents of each class, in hash order.
SAMPLE_TOXIC, SAMPLE_CLEAN, SEED = 4000, 8000, 11
#: Evidence: likelihood ratio statistic against the class rate; every form above it counts, so the sample bounds their number.
MIN_EVIDENCE, PREFIXES = 20.0, (4, 5, 6)
SEGMENT, ROUNDS, RATE, PENALTY, FLOOR, THRESHOLD = 32, 150, 0.1, 1e-5, 0.1, 0.7
CACHED_WORDS = 200_000

_ENDS = b".!?\n"
SENTENCE_BYTES = bytes(10 if b in _ENDS else WORD_BYTES[b] for b in range(256))
_TOKEN = re.compile(rb"[^ \n]+")


def mapped(text: str | None) -> bytes:
    """The text as bytes of the same offsets: words in lower case, sentence ends as line feeds, the rest as spaces."""
    return (text or "").encode("utf-8", "replace").translate(SENTENCE_BYTES)


def forms(word: bytes) -> list[bytes]:
    """A word's forms: the word itself and its beginnings, marked by their kind."""
    return [b"=" + word, *(b"%d" % n + word[:n] for n in PREFIXES if len(word) > n)]


class Coder:
    """Number of a word's strongest evidence form, 0 for a word without."""

    def __init__(self, evidence: dict[bytes, tuple[int, float]]):
        self.evidence, self.known = evidence, {}

    def __call__(self, word: bytes) -> int:
        code = self.known.get(word)
        if code is None:
            found = [self.evidence[f] for f in forms(word) if f in self.evidence]
            code = max(found, key=lambda x: x[1])[0] if found else 0
            if len(self.known) < CACHED_WORDS:
                self.known[word] = code
        return code


@dataclass(frozen=True)
class Field:
    """Weights: ``emit[code]`` for the toxic state (bias at 0 added to all), ``step[a, b]`` from state a to b."""

    emit: np.ndarray
    step: np.ndarray

    def toxic(self, codes: np.ndarray) -> np.ndarray:
        """Factor of the toxic state per token (tokens, segments); that of the other state is 1."""
        return np.exp(np.minimum(self.emit[codes] + np.where(codes > 0, self.emit[0], 0.0), 50.0)).T.copy()

    def passes(self, codes: np.ndarray, lengths: np.ndarray, ahead_of: np.ndarray | None = None, behind: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: marginals of the toxic state (segments, tokens) and of the transitions (tokens - 1, a, b, segments).

        Messages are scaled to sum to one at each token, which keeps products of any length in range. ``ahead_of`` and ``behind``
        (2, segments) are the messages into the first and the last token of pieces of longer chains.
        """
        n, most = codes.shape
        move, toxic = np.exp(self.step), self.toxic(codes)
        enter = np.ones((2, n)) if ahead_of is None else ahead_of
        end = np.ones((2, n)) if behind is None else behind
        inside = np.arange(most)[:, None] < lengths
        ahead, scale = np.empty((most, 2, n)), np.empty((most, n))
        now = np.stack([enter[0], enter[1] * toxic[0]])
        for t in range(most):
            if t:
                now = np.stack([ahead[t - 1, 0] * move[0, 0] + ahead[t - 1, 1] * move[1, 0], (ahead[t - 1, 0] * move[0, 1] + ahead[t - 1, 1] * move[1, 1]) * toxic[t]])
            scale[t] = now.sum(0)
            ahead[t] = now / scale[t]
        p, pairs, back = np.empty((most, n)), np.empty((max(0, most - 1), 2, 2, n)), end
        for t in range(most - 1, -1, -1):
            if t < most - 1:
                after = np.stack([back[0], back[1] * toxic[t + 1]]) / scale[t + 1]
                pairs[t] = ahead[t][:, None] * move[:, :, None] * after[None] * inside[t + 1]
                back = np.where(inside[t + 1], np.stack([move[0, 0] * after[0] + move[0, 1] * after[1], move[1, 0] * after[0] + move[1, 1] * after[1]]), end)
            p[t] = np.where(inside[t], ahead[t, 1] * back[1] / (ahead[t] * back).sum(0), 0.0)
        return p.T, pairs

    def marginals(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state per token; 0 beyond a segment's end."""
        return self.passes(codes, lengths)[0]

    def across(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Each piece as one matrix (pieces, 2, 2): the product of its tokens' factors and the transitions between them, scaled."""
        move, toxic = np.exp(self.step), self.toxic(codes)
        out = np.zeros((len(codes), 2, 2))
        out[:, 0, 0], out[:, 1, 1] = 1.0, toxic[0]
        for t in range(1, int(lengths.max())):
            new = out @ move
            new[:, :, 1] *= toxic[t][:, None]
            out = np.where((t < lengths)[:, None, None], new / new.sum((1, 2), keepdims=True), out)
        return out

    def messages(self, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Messages into the first and last tokens of the consecutive pieces of one chain, from their matrices."""
        move, n = np.exp(self.step), len(pieces)
        first, last = np.ones((n, 2)), np.ones((n, 2))
        for j in range(1, n):
            first[j] = first[j - 1] @ pieces[j - 1] @ move
            first[j] /= first[j].sum()
        for j in range(n - 2, -1, -1):
            last[j] = move @ (pieces[j + 1] @ last[j + 1])
            last[j] /= last[j].sum()
        return first, last


class Plain:
    """Sentences without evidence: their marginals depend on the length alone.

    Messages along equal factors settle, so those of a long sentence's middle are all alike and only the ones before are held.
    """

    def __init__(self, field: Field):
        self.move, self.factor = np.exp(field.step), np.array([1.0, float(field.toxic(np.zeros((1, 1), np.int64))[0, 0])])
        self.ahead, self.back, self.known = [self.factor / self.factor.sum()], [np.full(2, 0.5)], {}
        self.settled = False

    def __call__(self, length: int) -> tuple[float, float]:
        """(largest marginal, sum of those above the floor) of a sentence of so many words."""
        if length not in self.known:
            while len(self.ahead) < length and not self.settled:
                a, b = self.ahead[-1] @ self.move * self.factor, self.move @ (self.back[-1] * self.factor)
                a, b = a / a.sum(), b / b.sum()
                self.settled = max(np.abs(a - self.ahead[-1]).max(), np.abs(b - self.back[-1]).max()) < 1e-15
                self.ahead.append(a)
                self.back.append(b)
            k = len(self.ahead)
            at = np.arange(length) if length <= 2 * k else np.concatenate([np.arange(k + 1), np.arange(length - k, length)])
            times = np.ones(len(at))
            times[min(k, len(at) - 1)] += length - len(at)
            both = np.array(self.ahead)[np.minimum(at, k - 1)] * np.array(self.back)[np.minimum(length - 1 - at, k - 1)]
            p = both[:, 1] / both.sum(1)
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            self.known[length] = float(p.max()), float((p * times)[p >= FLOOR].sum())
        return self.known[length]


def fit_field(codes: np.ndarray, tags: np.ndarray, lengths: np.ndarray, times: np.ndarray, n_codes: int) -> Field:
    """Penalised maximum likelihood of tagged segments that stand ``times`` times each, by Adam on the exact gradient."""
    codes, tags = codes[:, :lengths.max()], tags[:, :lengths.max()]
    weight = np.where(np.arange(codes.shape[1]) < lengths[:, None], times[:, None], 0.0)
    size = n_codes + 1

    def forms_sum(values: np.ndarray) -> np.ndarray:
        out = np.bincount(codes.ravel(), values.ravel(), size)
        out[0] = values.sum()  # the bias
        return out

    seen = forms_sum(tags * weight)
    seen_step = np.array([[(weight[:, 1:] * (tags[:, :-1] == a) * (tags[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)])
    theta, m, v = np.zeros(size + 4), np.zeros(size + 4), np.zeros(size + 4)
    for k in range(1, ROUNDS + 1):
        p, pairs = Field(theta[:size], theta[size:].reshape(2, 2)).passes(codes, lengths)
        want_step = (pairs.sum(0) * times).sum(-1)
        slope = np.concatenate([seen - forms_sum(p * weight), (seen_step - want_step).ravel()]) / times.sum() - PENALTY * theta
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
    return Field(theta[:size], theta[size:].reshape(2, 2))


def segments(data: bytes) -> Iterator[list[bytes]]:
    """The text's sentences as word lists for the fit, cut at the segment length."""
    for line in data.split(b"\n"):
        found = line.split()
        for at in range(0, len(found), SEGMENT):
            yield found[at:at + SEGMENT]


def padded(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    out = np.zeros((len(rows), SEGMENT), np.int64)
    for i, row in enumerate(rows):
        out[i, :len(row)] = row
    return out, np.array([len(r) for r in rows], np.int64)


@dataclass(frozen=True)
class Scorer:
    """The fitted model, as it goes to the executors."""

    evidence: dict[bytes, tuple[int, float]]
    field: Field
    logistic: np.ndarray | None = None

    def measure(self, texts) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
        """Per text: (largest marginal, log of one plus the sum above the floor, log of one plus the words), and its spans."""
        code = Coder(self.evidence)
        plain = Plain(self.field)
        n = len(texts)
        most, total, size = np.zeros(n), np.zeros(n), np.zeros(n)
        waiting: list[list[int]] = []
        owner: list[int] = []
        begins: list[tuple[int, int]] = []  # (text, index of the piece's first token in it)
        chains: list[tuple[int, int]] = []  # sentences of several pieces: their first piece and the one after the last
        for d, text in enumerate(texts):
            data = mapped(text)
            codes = list(map(code, data.split()))
            size[d], at = len(codes), 0
            some = any(codes)
            for line in data.split(b"\n"):
                words = len(line.split())
                if not words:
                    continue
                own = codes[at:at + words] if some else ()
                if any(own):
                    for cut in range(0, words, SEGMENT):
                        waiting.append(own[cut:cut + SEGMENT])
                        owner.append(d)
                        begins.append((d, at + cut))
                    if words > SEGMENT:
                        chains.append((len(waiting) - (words - 1) // SEGMENT - 1, len(waiting)))
                else:
                    high, above = plain(words)
                    total[d] += above
                    most[d] = max(most[d], high)
                at += words
        enter, leave = np.ones((len(waiting), 2)), np.ones((len(waiting), 2))
        if chains:
            linked = [i for a, b in chains for i in range(a, b)]
            whole = np.concatenate([self.field.across(*padded([waiting[i] for i in linked[k:k + 4096]])) for k in range(0, len(linked), 4096)])
            done = 0
            for a, b in chains:
                enter[a:b], leave[a:b] = self.field.messages(whole[done:done + b - a])
                done += b - a
        spans: list[list[tuple[int, int, float]]] = [[] for _ in range(n)]
        for at in range(0, len(waiting), 4096):
            codes, lengths = padded(waiting[at:at + 4096])
            p = self.field.passes(codes, lengths, enter[at:at + 4096].T, leave[at:at + 4096].T)[0]
            who = np.array(owner[at:at + 4096])
            np.add.at(total, who, np.where(p >= FLOOR, p, 0).sum(1))
            np.maximum.at(most, who, p.max(1))
            for row in np.flatnonzero(p.max(1) > 0.5):
                d, first = begins[at + row]
                spans[d] += [(first + int(t), first + int(t) + 1, float(p[row, t])) for t in np.flatnonzero(p[row] > 0.5)]
        for d in (d for d in range(n) if spans[d]):
            spans[d] = self._in_characters(texts[d], spans[d])
        return np.stack([most, np.log1p(total), np.log1p(size)], 1), spans

    @staticmethod
    def _in_characters(text: str, found: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
        joined: list[list] = []
        for first, end, p in sorted(found):
            if joined and joined[-1][1] == first:
                joined[-1][1], joined[-1][2] = end, max(joined[-1][2], p)
            else:
                joined.append([first, end, p])
        raw, places = text.encode("utf-8", "replace"), [m.span() for m in _TOKEN.finditer(mapped(text))]
        return [(len(raw[:places[a][0]].decode("utf-8", "replace")), len(raw[:places[b - 1][1]].decode("utf-8", "replace")), p) for a, b, p in joined]

    def score(self, measures: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(measures @ self.logistic[1:] + self.logistic[0], -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 50) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    if not len(y) or y.min() == y.max():
        return np.concatenate([[4.0 if len(y) and y[0] else -4.0], np.zeros(x.shape[1] if x.ndim == 2 else 3)])
    a = np.concatenate([np.ones((len(x), 1)), x], 1)
    beta, ridge = np.zeros(a.shape[1]), np.diag([1e-6] + [penalty] * x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        step = np.linalg.solve((a * np.maximum(p * (1 - p), 1e-9)[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta


def find_evidence(sample: DataFrame) -> dict[bytes, tuple[int, float]]:
    """Forms with their number and log odds, from counts of the sample's documents per form and class."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch["text"], batch["toxic"]):
                seen[toxic].update({f for w in set(mapped(text).split()) for f in forms(w)})
            made = list(seen[0].keys() | seen[1].keys())
            if made:
                yield pd.DataFrame({"form": made, "clean": [seen[0][f] for f in made], "toxic": [seen[1][f] for f in made]})

    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = sample.mapInPandas(count, "form binary, clean long, toxic long").groupBy("form").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    both, rate = F.col("c") + F.col("t"), n1 / (n1 + n0)
    part = lambda k, share: F.when(k > 0, k * F.log(k / (both * share))).otherwise(0.0)
    ratio = 2 * (part(F.col("t"), rate) + part(F.col("c"), 1 - rate))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    rows = counts.where("t >= 3").select("form", ratio.alias("ratio"), odds.alias("odds")).where(
        (F.col("ratio") >= MIN_EVIDENCE) & (F.col("odds") > 1.5)).orderBy(F.col("ratio").desc(), "form").collect()
    return {bytes(r["form"]): (i + 1, r["odds"]) for i, r in enumerate(rows)}


def tagged_segments(sample: DataFrame, evidence: dict[bytes, tuple[int, float]]):
    """Distinct segments of the sample as codes and tags, with how often each stands."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = Coder(evidence)
        for batch in batches:
            seen: Counter = Counter()
            for text, toxic in zip(batch["text"], batch["toxic"]):
                for words in segments(mapped(text)):
                    codes = np.array([code(w) for w in words], np.int32)
                    seen[codes.tobytes(), int(toxic) if codes.any() else 0] += 1
            if seen:
                yield pd.DataFrame([(c, t, n) for (c, t), n in seen.items()], columns=["codes", "toxic", "n"])

    rows = sample.mapInPandas(cut, "codes binary, toxic int, n long").groupBy("codes", "toxic").agg(F.sum("n").alias("n")).orderBy("codes", "toxic").collect()
    codes, lengths = padded([np.frombuffer(bytes(r["codes"]), np.int32).tolist() for r in rows])
    toxic = np.array([r["toxic"] for r in rows], np.int64)
    return codes, ((codes > 0) & (toxic[:, None] > 0)).astype(np.int64), lengths, np.array([r["n"] for r in rows], float)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer:
    """Fit on ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``); a document labelled twice counts by its larger label."""
    wanted = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    wanted = wanted.withColumn("order", F.xxhash64(F.lit(SEED), "doc_id"))
    pick = lambda toxic, n: wanted.where(F.col("toxic") == toxic).orderBy("order", "doc_id").limit(n)
    chosen = pick(1, SAMPLE_TOXIC).unionByName(pick(0, SAMPLE_CLEAN)).drop("order")  # bounded, so it may be broadcast
    sample = keep(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic"), "toxicity-sample")
    evidence = find_evidence(sample)
    if not evidence:
        return Scorer({}, Field(np.array([-6.0]), np.zeros((2, 2))), fit_logistic(np.zeros((0, 3)), np.zeros(0)))
    codes, tags, lengths, times = tagged_segments(sample, evidence)
    model = Scorer(evidence, fit_field(codes, tags, lengths, times, len(evidence)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m, _ = model.measure(batch["text"].tolist())
            yield pd.DataFrame({"a": m[:, 0], "b": m[:, 1], "c": m[:, 2], "toxic": batch["toxic"]})

    seen = sample.mapInPandas(measure, "a double, b double, c double, toxic int").orderBy("a", "b", "c", "toxic").toPandas()  # a row per sampled document
    return Scorer(evidence, model.field, fit_logistic(seen[["a", "b", "c"]].to_numpy(), seen["toxic"].to_numpy()))


def score_toxicity(docs: DataFrame, model: Scorer, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, score, spans``; spans are (start, end, marginal) in characters of the text.

    Only the text enters a score. Null and empty texts have no spans and the score of a text without words. An empty table gives
    no rows.
    """
    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            measures, spans = model.measure(batch["text"].tolist())
            yield pd.DataFrame({"doc_id": batch["doc_id"].array, "score": model.score(measures),
                                "spans": [[dict(zip(("start", "end", "score"), s)) for s in row] for row in spans]})

    kind = docs.select(id_column).schema[0].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_of(text_column).alias("text")).mapInPandas(
        score, f"doc_id {kind}, score double, spans array<struct<start: int, end: int, score: double>>")


def drop_toxic(docs: DataFrame, model: Scorer, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """The rows whose text scores below the threshold, with all their columns."""
    at = docs.columns.index(text_column)

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            measures, _ = model.measure(batch.column(at).to_pylist())
            yield batch.filter(pa.array(model.score(measures) < threshold))

    return docs.mapInArrow(select, docs.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(crc_mod("doc_id", 3) != 1)


def op4_toxicity_field(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.select("doc_id", "text"), training_labels(table(spark, sf_dir, "labels").select("doc_id", "toxic")))
    return score_toxicity(docs, model).select(
        "doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"))


SQL = None
