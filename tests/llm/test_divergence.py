import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from llm_cases import documents, mixed_rows, row

from sensorloom.llm import divergence


def terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def brute(rows, min_docs=10, top=10):
    """Plain integers of any size, term by term."""
    langs = defaultdict(list)
    for _, text, lang, source, *_ in rows:
        langs[lang or ""].append((source or "", Counter(terms(text))))
    out = []
    for lang, docs in langs.items():
        df = Counter(t for _, c in docs for t in c)
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        counts = defaultdict(Counter)
        for source, c in docs:
            counts[source].update({t: c[t] for t in kept})
        whole = sum(counts.values(), Counter())

        def p(c):
            n = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // n for t in kept}

        share, of_all = {s: p(c) for s, c in counts.items()}, p(whole)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in counts:
            pair = [(sum(f(share[s][t], share[o][t]) for t in kept), o) for o in counts if o != s]
            high = [(f(share[s][t], of_all[t]), t) for t in kept if counts[s][t] > 0 and share[s][t] > of_all[t]]
            for part, items, most in (("pair", pair, None), ("term", high, top)):
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1)]
    return Counter(out)


def result(df, **how):
    return Counter(map(tuple, divergence.source_divergences(df, **how).collect()))


def test_against_brute_force(spark, monkeypatch):
    rows = mixed_rows(n=240) + [row(5000 + i, "Ünder Под x1y LONG " * 3, "a" if i % 3 else None, ("fr", None, "")[i % 3]) for i in range(30)]
    rows += [row(6000, "alone", "z", "xx"), row(6001, None, "y", "xx"), row(6002, "only", "one", "single")]
    want = brute(rows)
    assert {r[2] for r in want} == {"pair", "term"} and ("xx", "z", "pair", "y", 0, 1) in want
    df = documents(spark, rows)
    assert result(df) == want
    monkeypatch.setattr(divergence, "SHARD_ROWS", 40)  # many shards
    assert result(df.repartition(11)) == want


def test_lower_bounds_and_top(spark):
    rows = mixed_rows(seed=5, n=60)
    assert result(documents(spark, rows), min_docs=2, top=3) == brute(rows, 2, 3)


def test_empty_table_and_texts(spark):
    assert result(documents(spark, []).limit(0)) == Counter()
    rows = [row(1, None, None, None), row(2, "", "a", None), row(3, "1 2 3", "a", None)]
    assert result(documents(spark, rows)) == brute(rows) == Counter([("", "", "pair", "a", 0, 1), ("", "a", "pair", "", 0, 1)])


@pytest.mark.parametrize("held", [4, 1 << 19])
def test_a_task_hands_on_what_it_cannot_hold(held, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_ROWS", held)
    monkeypatch.setattr(divergence, "SLICE_BYTES", 30)
    batch = pa.record_batch({"lang": ["en"] * 6, "source": ["a", "b"] * 3, "text": ["One two, TWO three", "", "é" * 40 + " two", "x", "two x", "7 8"]})
    got = Counter()
    for part in divergence.partial_counts(iter([batch, batch])):
        for r in part.to_pylist():
            got[r["source"], r["term"]] += r["n"] if r["term"] else r["docs"]
    assert got == Counter({("a", "one"): 2, ("a", "two"): 8, ("a", "three"): 2, ("a", "é" * 40): 2, ("a", "x"): 2, ("b", "x"): 2, ("a", None): 6, ("b", None): 6})


def test_shares_are_exact_for_large_counts():
    import numpy as np

    for count, total, kept in ((10**14, 4 * 10**15, 10**9), (0, 7, 1), (3, 3, 1), (9 * 10**14, 9 * 10**14, 5)):
        assert divergence.shares(np.array([count]), np.array([total]), np.array([kept]))[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)
