import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from llm_cases import documents, mixed_rows
from pyspark.sql import functions as F

from sensorloom.llm import ctw
from sensorloom.llm.common import crc_mod


def log_kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)


class Tree:
    """Plain context-tree weighting of one binary decision: recursion over the contexts seen."""

    def __init__(self, seen):  # (context bytes, nearest first; bit) -> count
        self.counts = defaultdict(lambda: [0.0, 0.0])
        for (context, bit), n in seen.items():
            for d in range(ctw.DEPTH + 1):
                self.counts[context[:d]][bit] += n
        self.below = defaultdict(set)
        for c in self.counts:
            if c:
                self.below[c[:-1]].add(c)

    def weighted(self, c):
        own = log_kt(*self.counts[c])
        if len(c) == ctw.DEPTH:
            return own
        return math.log(0.5) + np.logaddexp(own, sum(self.weighted(x) for x in self.below[c]))

    def predict(self, context, bit, d=0):
        c = context[:d]
        counts = self.counts.get(c, [0.0, 0.0])
        own = (counts[bit] + 0.5) / (sum(counts) + 1)
        if d == ctw.DEPTH:
            return own
        weight = math.exp(math.log(0.5) + log_kt(*counts) - self.weighted(c)) if c in self.counts else 0.5
        return weight * own + (1 - weight) * self.predict(context, bit, d + 1)


def scores(texts, train):
    data = [ctw.lowered(t or "") for t in texts]
    seen = defaultdict(Counter)

    def events(t):
        s = ctw.EDGE * ctw.DEPTH + t + ctw.EDGE
        for p in range(ctw.DEPTH, len(s)):
            context = bytes(reversed(s[p - ctw.DEPTH:p]))
            for level in range(8):
                yield level, (1 << level) | (s[p] >> (8 - level)), context, s[p] >> (7 - level) & 1

    for t, trains in zip(data, train):
        if trains:
            for _, node, context, bit in events(t):
                seen[node][context, bit] += 1
    trees = {node: Tree(s) for node, s in seen.items()}
    out = []
    for t in data:
        out.append(sum(math.log10(trees[node].predict(context, bit)) if node in trees else math.log10(0.5) for _, node, context, bit in events(t)))
    return out


def test_against_plain_recursion(spark):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abA é", k=rng.randrange(12)))) for i in range(25)] + [(30, None), (31, ""), (3, "again")]
    df = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, score double, chunk string")
    got = ctw.score_texts(df, F.col("doc_id") % 5 == 1, chunk_bytes=40)
    want = Counter((i, round(s, 6)) for (i, _), s in zip(rows, scores([t for _, t in rows], [i % 5 != 1 for i, _ in rows])))
    assert Counter((r.doc_id, round(r.score, 6)) for r in got.collect()) == want


def test_bytes_sum_to_one():
    context = int.from_bytes(bytes(range(97, 97 + ctw.DEPTH)), "big")
    keys = np.array([(context << 8) + b for b in range(256)], np.int64)
    n = np.zeros(256, np.int64)
    n[[10, 97, 200]] = [3, 50, 1]
    group = pd.DataFrame({"gram": keys, "n": n})
    upper = ctw.Upper([tuple(r) for r in ctw.top_nodes(group).astype({"node": int}).itertuples(index=False)])
    p = 10 ** ctw.byte_model(group, upper)["value"].to_numpy()
    assert p.sum() == pytest.approx(1) and p.argmax() == 97


def test_base_and_held_out(spark):
    rows = mixed_rows()
    df = documents(spark, rows)
    held = {i for i, in df.where(crc_mod("doc_id", 5) == 1).select("doc_id").collect()}
    counts = Counter()
    split = lambda t: [w for w in ctw.lowered(t or "").split()] + ["end"]
    for r in rows:
        if r[0] not in held:
            counts.update(split(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = ctw.score_texts(df, crc_mod("doc_id", 5) == 1, chunk_bytes=9000).collect()
    assert len(out) == len(rows)
    texts = {r[0]: r[1] for r in rows}
    for r in out:
        tokens = split(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens))
    assert ctw.score_texts(df.limit(0), crc_mod("doc_id", 5) == 1).count() == 0
    none = ctw.score_texts(df.limit(3), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.bits_per_byte == pytest.approx(8) for r in none)


def test_parts_leave_in_slices(monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 50)
    rng = random.Random(4)
    texts = ["".join(rng.choices("ab c", k=rng.randrange(60))) for _ in range(40)] + [""]
    held = [i % 3 == 0 for i in range(len(texts))]
    rows = pd.DataFrame({"chunk": 5, "text": texts, "held_out": held})
    made = list(ctw.name_parts(iter([rows[:7], rows[7:]])))
    assert len(made) > 4 and max(map(len, made)) < 70
    out = pd.concat(made)
    want, words = Counter(), Counter()
    for t, h in zip(texts, held):
        data = ctw.EDGE * ctw.DEPTH + t.encode() + ctw.EDGE
        for p in range(ctw.DEPTH, len(data)):
            want[int.from_bytes(data[p - ctw.DEPTH:p][::-1] + data[p:p + 1], "big")] += not h
        words.update({w: 0 if h else n for w, n in Counter(t.encode().split()).items()})
    got = out[out["kind"] == 1]
    assert dict(zip(got["gram"], got["n"])) == dict(want) and len(got) == len(want)
    named = out[out["kind"] == 0]
    assert named["word"].tolist() == sorted(words) and named["number"].tolist() == list(range(len(words)))
    assert dict(zip(named["word"], named["n"])) == dict(words)


def test_a_chunk_names_one_row_per_bucket(spark, monkeypatch):
    made = {}

    def kept(df, name):
        made[name] = df.persist()
        return made[name]

    monkeypatch.setattr(ctw, "keep", kept)
    monkeypatch.setattr(ctw, "BUCKETS", 3)
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(3))) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ctw.score_texts(df, F.col("doc_id") % 5 == 1, chunk_bytes=120).collect()
    named = made["ctw-named"]
    assert named.select("chunk").distinct().count() > 1
    assert named.groupBy("chunk", "kind", "bucket").count().where("count > 1").count() == 0
    want = dict(enumerate(scores([t for _, t in rows], [i % 5 != 1 for i, _ in rows])))
    assert {r.doc_id: r.score for r in got} == pytest.approx(want)


def test_sums_of_a_bucket(monkeypatch):
    monkeypatch.setattr(ctw, "SLICE", 20)
    rng = np.random.default_rng(8)
    rows, want, words = [], Counter(), Counter()
    for chunk in range(12):
        keys = np.unique(rng.integers(0, 150, 40).astype(np.uint64)) << np.uint64(40)
        n = rng.integers(0, 9, len(keys))
        want.update(dict(zip(keys.tolist(), n.tolist())))
        some = sorted({b"w%d" % k for k in rng.integers(0, 30, 10)})
        of_word = rng.integers(0, 3, len(some))
        words.update(dict(zip(some, of_word.tolist())))
        rows.append((chunk, 4, ctw.packed_keys(keys), ctw.packed(n), ctw.packed_words(some), ctw.packed(of_word)))
    frames = [pd.DataFrame(part, columns=["chunk", "bucket", "grams", "n", "words", "of_word"]) for part in (rows[:5], rows[5:])]
    out = list(ctw.sum_grams(f[["bucket", "n"]].assign(body=f["grams"]) for f in frames))
    assert len(out) > 1
    got = ctw.unpacked_grams(pd.concat(out))
    assert got["gram"].is_monotonic_increasing and dict(zip(got["gram"], got["n"])) == dict(want)
    out = pd.concat(ctw.count_words(f[["chunk"]].assign(body=f["words"], n=f["of_word"]) for f in frames))
    assert (out["tokens"].sum(), out["seen"].sum()) == (sum(words.values()), sum(n > 0 for n in words.values()))
    assert out["chunk"].tolist() == list(range(12))
    for body, value in zip(out["body"], out["value"]):
        assert ctw.unpacked(value).tolist() == [words[w] for w in ctw.unpacked_words(body)]


def test_contexts_weighted_together():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(97, 101, (900, ctw.DEPTH + 1)) @ (256 ** np.arange(ctw.DEPTH + 1)))
    group = pd.DataFrame({"gram": keys, "n": rng.integers(0, 5, len(keys))})
    apart = [g for _, g in group.groupby(group["gram"] // 256 ** (ctw.DEPTH + 1 - ctw.TOP))]
    assert len(apart) > 4
    order = ["last", "node", "zeros", "ones", "below"]
    together = ctw.top_nodes(group).sort_values(order)
    each = pd.concat(map(ctw.top_nodes, apart)).sort_values(order)
    assert np.allclose(together[order].to_numpy(float), each[order].to_numpy(float))
    upper = ctw.Upper([tuple(r) for r in together.groupby(["last", "node"]).sum().reset_index().astype({"node": int})[order].itertuples(index=False)])
    assert np.allclose(ctw.byte_model(group, upper)["value"], pd.concat([ctw.byte_model(g, upper) for g in apart])["value"])
