import random
from collections import Counter

import pytest
from llm_cases import documents, mixed_rows, row

from sensorloom.llm import near_dup
from sensorloom.llm.common import words
from sensorloom.llm.near_dup import choose_bands, components, drop_near_duplicates, near_duplicates


def gram_set(text):
    w = words(text or "")
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = {r[0]: gram_set(r[1]) for r in rows}
    ids, links, root = sorted(sets), Counter(), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


def near_group(n, seed=8):
    """A group of near copies that all differ, and texts at many distances from it."""
    rng = random.Random(seed)
    base = [f"v{rng.randrange(1000)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 1, 2, 3, 6])):
            w[rng.randrange(120)] = f"u{rng.randrange(50)}"
        out.append(row(5000 + i, " ".join(w)))
    return out


@pytest.mark.parametrize("block", [1024, 16])
def test_against_brute_force(spark, block):
    rows = [r for r in mixed_rows() if r[0] != 7] + near_group(60)
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(documents(spark, rows), block=block).collect()}
    assert got == brute(rows)


def test_large_blocks_by_size(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_GRAMS", 1000)
    rows = near_group(40)
    assert {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(documents(spark, rows)).collect()} == brute(rows)


def test_repeated_rows_nulls_and_columns(spark):
    rows = mixed_rows()
    out = near_duplicates(documents(spark, [*rows, row(None, "a b c d e f")])).collect()
    assert len(out) == len(rows) + 1
    want = brute(rows)
    assert all(r.class_id == want[r.doc_id][0] for r in out if r.doc_id is not None)
    df = documents(spark, rows)
    kept = drop_near_duplicates(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for c, _ in want.values()}
    assert near_duplicates(df.limit(0)).count() == 0


def test_bands_reach_the_recall():
    bands, rows = choose_bands(0.8, 0.9999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.9999 and bands * rows <= 96
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999, 10)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 100 for i in range(100, 140)}


def test_identifier_with_two_texts_keeps_both_links(spark):
    rng = random.Random(4)
    a, b = ([f"{c}{rng.randrange(900)}" for _ in range(80)] for c in "pq")
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [row(1, " ".join(a)), row(1, " ".join(b)), row(2, near(a)), row(3, near(b)), row(4, "alone " * 3), row(4, near(b) + " too")]
    for parts in (1, 7):
        got = Counter((r.doc_id, r.class_id, r.n_links) for r in near_duplicates(documents(spark, rows).repartition(parts)).collect())
        assert got == Counter([(1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (4, 4, 0), (4, 1, 2)])
        kept = drop_near_duplicates(documents(spark, rows).repartition(parts)).select("doc_id", "text").collect()
        assert Counter(map(tuple, kept)) == Counter([(1, " ".join(a)), (1, " ".join(b)), (4, "alone " * 3)])


def test_long_texts_in_pieces(monkeypatch):
    rng = random.Random(6)
    texts = [" ".join(f"k{rng.randrange(40)}" for _ in range(k)) for k in (0, 3, 5, 64, 65, 68, 300, 1000)]
    texts += ["z" * 5000 + " " + texts[4], texts[4] + " " + "z" * 5001, "z" * 3000]
    whole = near_dup.ngram_hashes(texts)
    monkeypatch.setattr(near_dup, "PIECE_WORDS", 64)
    pieces = near_dup.ngram_hashes(texts)
    assert (whole[0] == pieces[0]).all() and (whole[1] == pieces[1]).all()
    assert [b - a for a, b in zip(whole[1], whole[1][1:])] == [len(gram_set(t)) for t in texts]
    monkeypatch.setattr(near_dup, "BATCH_BYTES", 2000)
    cuts = list(near_dup.batches_by_bytes(texts, 3))
    assert [i for c in cuts for i in range(len(texts))[c]] == list(range(len(texts))) and len(cuts) > 4


def test_text_of_fifty_megabytes(spark):
    long = " ".join(f"m{i}" for i in range(6_000_000))
    got = {r.doc_id: (r.class_id, r.n_links) for r in near_duplicates(documents(spark, [row(1, long), row(2, long + " end"), row(3, "m1 m2")])).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (3, 0)}
