import random
import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers
import tiktoken
from llm_cases import documents, mixed_rows
from tokenizers import Tokenizer

from sensorloom.llm import packing
from sensorloom.llm.packing import encoder, fill, pack, plan


def test_ids_equal_the_tokenizer_file():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(1)
    parts = ["a", " ", "  ", "\n", "\t", "é", "日本", "don't", "123", "<|endoftext|>", " ", " ", "\x1c", "!", "...", "word", " |", "\r\n", "🙂"]
    texts = ["", " ", "  a", "a ", *(r[1] or "" for r in mixed_rows()), *("".join(rng.choices(parts, k=rng.randrange(20))) for _ in range(800))]
    for text in texts:
        assert array("I", encode(text)).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_fill_is_closest():
    rng = random.Random(2)
    for _ in range(150):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        sums = {max(counts)}
        left = {**counts, max(counts): counts[max(counts)] - 1}
        for n, c in left.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= 40}
        chosen = fill(counts, 40)
        assert sum(n * c for n, c in chosen.items()) == max(sums) and all(c <= counts[n] for n, c in chosen.items())


def test_plan_places_every_token():
    rng = random.Random(3)
    for _ in range(60):
        counts = {rng.randrange(1, 64): rng.randrange(1, 50) for _ in range(rng.randrange(1, 12))}
        uses, sequences = plan(counts, 64)
        total = sum(n * c for n, c in counts.items())
        assert sequences == -(-total // 64)
        assert sum((u.head or n) * u.each * u.times for n, of in uses.items() for u in of) == total
    assert plan({}, 64) == ({}, 0)


def test_pack(spark):
    rows = mixed_rows()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for window in (16, 1024):
        got = pack(documents(spark, rows).repartition(3), window).collect()
        by_doc, by_sequence = defaultdict(list), defaultdict(list)
        for p in got:
            by_doc[p.doc_id].append(p)
            by_sequence[p.sequence_id].append(p)
        ids = {r[0]: tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0] for r in rows}
        copies = Counter(r[0] for r in rows)
        assert by_doc.keys() == ids.keys()
        for doc, pieces in by_doc.items():
            seen = Counter()
            for p in pieces:
                assert p.doc_tokens == len(ids[doc])
                assert p.ids_crc32 == zlib.crc32(array("I", ids[doc][p.start:p.start + p.length]).tobytes())
                seen.update(range(p.start, p.start + p.length))
            assert seen == {i: copies[doc] for i in range(len(ids[doc]))}
        short = 0
        for pieces in by_sequence.values():
            at = 0
            for p in sorted(pieces, key=lambda p: p.offset):
                assert p.offset == at and p.length > 0
                at += p.length
            assert at <= window
            short += at < window
        assert short <= 1
    assert pack(documents(spark, rows).limit(0)).count() == 0


def test_many_words_are_remembered(monkeypatch):
    encode = packing.encoder.__wrapped__(public_tokenizers.path(packing.RANKS))
    text = "a " + " ".join(f"w{i:x}" for i in range(400_000))
    first, calls, plain = encode(text), [], tiktoken.Encoding.encode
    monkeypatch.setattr(tiktoken.Encoding, "encode", lambda self, t, **how: calls.append(t) or plain(self, t, **how))
    assert encode(text) == first and calls == ["a"]


def test_words_seen_once_are_not_kept(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 6)
    encode = packing.encoder.__wrapped__(public_tokenizers.path(packing.RANKS))
    cells = dict(zip(encode.__code__.co_freevars, (c.cell_contents for c in encode.__closure__)))
    once = " ".join(f"rare{i}" for i in range(40))
    first = encode(f"a often {once}")
    assert not cells["known"] and len(cells["recent"]) <= 6
    assert encode("a often") and encode("a often") and "often" in cells["known"]
    assert encode(f"a often {once}") == first and "often" in cells["known"] and len(cells["known"]) + len(cells["recent"]) <= 6
