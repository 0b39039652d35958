import random
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import documents, mixed_rows, row

from sensorloom.llm.mixing import apply_mix, mixed_words, quotas, source_targets

WORD = re.compile("[^\x20\x09-\x0d]+")


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Shares by weight with the excess over the caps shared again, one round after the other."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, held = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in held]
        if not free:
            break
        level = (total - sum(cap * sizes[s] for s in held)) / sum(weight[s] for s in free)
        more = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not more:
            break
        held |= more
    return {s: float(cap * sizes[s]) if s in held else level * weight[s] for s in order}


def test_targets(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "é": 70, "z": 0, None: 300}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_targets(df).collect()}
    want = targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_quotas_are_highest_quotients(spark):
    cells = [("a", 0, 100.0, 50), ("a", 1, 100.0, 50), ("b", 0, 7.0, 1), ("c", 0, 33.5, 50), ("d", 0, 0.0, 5), ("e", 0, 100.0, 3)]
    df = spark.createDataFrame(cells, "source_no string, shard int, target double, room long")
    for seats in (0, 1, 5, 17, 40, 159, 400):
        want = Counter()
        all_quotients = sorted(((-t / (2 * k + 1), s, c) for s, c, t, room in cells for k in range(room)))
        for _, s, c in all_quotients[:seats]:
            want[s, c] += 1
        got = {(r.source_no, r.shard): r.quota for r in quotas(df, ["source_no", "shard"], seats).collect()}
        assert got == {(s, c): want[s, c] for s, c, *_ in cells}, seats


def test_mix(spark):
    rows = mixed_rows()
    df = documents(spark, rows)
    got = mixed_words(df, block=8, shard_words=500)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    want, taken = targets(sizes), defaultdict(int)
    out = got.collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in rows)
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 8 * (2 + sizes[s] // 500)
    again = mixed_words(df.repartition(5), block=8, shard_words=500).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    assert mixed_words(df.limit(0)).count() == 0
    assert [r.taken for r in mixed_words(documents(spark, rows[-8:-6])).collect()] == [0, 0]  # no words at all


@pytest.mark.parametrize("counts", [
    {f"s{i:02d}": 31 for i in range(30)} | {"large": 40_000},
    {"one": 1, "s31": 31, "s33": 33, "s50": 50, "s64": 64, "s65": 65, "big": 20_000, "more": 30_000},
    {"a": 7, "b": 5, "c": 20},  # a table smaller than a block
    {"a": 40, "b": 3, "c": 90, "d": 500}])
def test_small_sources_take_their_targets(spark, counts):
    rows, n = [], 0
    for source, words in counts.items():
        while words:
            k = min(words, 1 + n % 700)
            rows.append(row(n, " ".join(["w"] * k), source))
            words, n = words - k, n + 1
    want, taken = targets(counts), defaultdict(int)
    for r in mixed_words(documents(spark, rows)).collect():
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    for s, size in counts.items():
        if want[s] == 2 * size:
            assert taken[s] == 2 * size, s
        else:
            assert abs(taken[s] - want[s]) <= max(2, want[s] / 32), s


def test_applied_mix_keeps_columns(spark):
    rows = [r for r in mixed_rows() if r[0] != 7]
    df = documents(spark, rows)
    out = apply_mix(df, block=8)
    assert out.columns == df.columns
    assert set(map(tuple, out.collect())) <= set(map(tuple, df.collect()))
    assert 0 < max(Counter(r.doc_id for r in out.collect()).values()) <= 2


def test_applied_mix_meets_the_targets(spark):
    rng = random.Random(5)
    # Long documents span many blocks, so each one's fraction is near its source's ratio.
    lengths = {"a": lambda: 640, "b": lambda: rng.randrange(2000, 5000), "c": lambda: rng.choice([3, 30, 300, 3000]), "d": lambda: rng.randrange(1, 40), "e": lambda: 1200}
    rows = [row(i, " ".join(["w"] * lengths[s]()), s) for i, s in enumerate(rng.choices("abcde", k=900))]
    sizes, longest = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(r[1].split())
        longest[r[3]] = max(longest[r[3]], len(r[1].split()))
    df = documents(spark, rows)
    for weights, share in (((3, 1, 2), 1.5), ((1,), 0.2), ((1, 3), 0.7)):
        want, got = targets(sizes, weights, share), defaultdict(int)
        out = apply_mix(df, weights=weights, share=share, shard_words=60000).collect()
        for r in out:
            got[r.source] += len(r.text.split())
        assert max(Counter(r.doc_id for r in out).values()) <= 2
        for s in sizes:
            assert abs(got[s] - want[s]) <= (1 + sizes[s] // 60000) * (longest[s] + 128), (weights, s)
    again = apply_mix(df.repartition(7), weights=(1, 3), share=0.7, shard_words=60000).collect()
    assert Counter(r.doc_id for r in again) == Counter(r.doc_id for r in out)
