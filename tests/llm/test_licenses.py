import random
import re

from llm_cases import documents, mixed_rows, row

from sensorloom.llm.licenses import PHRASES, TEMPLATES, THRESHOLD, op8_license_scan, phrase_places, scan_licenses, windows_holding

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_against_brute_force(spark):
    rng = random.Random(7)
    notices = [*TEMPLATES, *PHRASES, "cc-by-nc-CC by nc", "under the MIT license under the mit license", "Licensed under the Apache License"]
    pool = sorted({w for n in notices for w in words(n)}) + ["foo", "bar", "Zürich"]
    rows = mixed_rows()
    for i in range(150):
        parts = [rng.choice(notices) if rng.random() < 0.3 else " ".join(rng.choices(pool, k=rng.randrange(14))) for _ in range(rng.randrange(1, 5))]
        rows.append(row(2000 + i, "".join(p + rng.choice([" ", "\n", ". "]) for p in parts)))
    got = {}
    for r in scan_licenses(documents(spark, rows)).collect():
        got.setdefault(r.doc_id, r)
    for r in rows:
        tokens = words(r[1])
        places = [(i, label) for p, label in PHRASES.items() for i in range(len(tokens)) if tokens[i:i + len(p.split())] == p.split()]
        blocks = []
        for k, line in enumerate((r[1] or "").split("\n")):
            for notice, label in TEMPLATES.items():
                t = set(words(notice))
                if len(t & set(words(line))) >= THRESHOLD * len(t) - 1e-9:
                    blocks.append((k, label))
        base = sorted({label for _, label in places})
        g = got[r[0]]
        assert (g.n_words, g.n_base) == (len(tokens), len(places))
        assert (g.first_word, g.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert g.base_labels == ",".join(base) and g.labels == ",".join(sorted({*base, *(b[1] for b in blocks)}))
        assert sorted((b.line, b.label) for b in g.blocks) == sorted(blocks) and 0 <= g.score <= 1


def test_empty_table(spark):
    assert scan_licenses(documents(spark, mixed_rows()[:1]).limit(0)).count() == 0


def test_notices_that_wrap_and_long_lines(spark, tmp_path):
    wrapped = "/* Redistribution and use in source and binary forms, with or without\n * modification, are permitted */"
    gpl = "This work is licensed under the GNU General\nPublic License, version 3."
    mpl = "foo " * 500 + "This Source Code Form is subject\n# to the terms of the Mozilla\n# Public License, v. 2.0. " + "foo " * 500
    far = " foo foo foo foo foo ".join(words(next(n for n in TEMPLATES if TEMPLATES[n] == "bsd")))
    one_line = "foo " * 10000 + gpl.replace("\n", " ") + " foo" * 10000
    rows = [row(i, t) for i, t in enumerate([wrapped, gpl, mpl, far, "x\n" + gpl + "\n" + gpl, one_line])]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.labels, r.n_blocks, r.score) for r in op8_license_scan(spark, str(tmp_path)).collect()}
    assert got == {0: ("bsd", 1, 1.0), 1: ("gpl-3", 1, 1.0), 2: ("mpl-2", 1, 1.0), 3: ("", 0, 0.0), 4: ("gpl-3", 2, 1.0), 5: ("gpl-3", 1, 1.0)}
    lines = {r.doc_id: [b.line for b in r.blocks] for r in scan_licenses(documents(spark, rows), windows=True).collect()}
    assert lines[2] == [0] and lines[4] == [1, 3]


def test_windows_against_brute_force(spark):
    rng = random.Random(11)
    pool = sorted({w for n in TEMPLATES for w in words(n)})
    rows = []
    for i in range(200):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            notice = words(rng.choice(list(TEMPLATES)))
            if rng.random() < 0.5:
                notice.pop(rng.randrange(len(notice)))
            if rng.random() < 0.6:
                for _ in range(rng.randrange(30)):
                    notice.insert(rng.randrange(len(notice)), rng.choice(pool + ["foo"] * 60))
            parts += notice + ["foo"] * rng.randrange(50)
        rows.append(row(i, "".join(w + rng.choice(["\n", " ", ", "]) for w in parts)))
    found = 0
    for r in scan_licenses(documents(spark, rows), phrases={}, windows=True).collect():
        tokens, want, score = words(rows[r.doc_id][1]), set(), 0.0
        for notice, label in TEMPLATES.items():
            t, width = set(words(notice)), 2 * len(words(notice))
            share = max(len(t & set(tokens[k:k + width])) for k in range(len(tokens))) / len(t)
            if share * len(t) >= THRESHOLD * len(t) - 1e-9:
                want.add(label)
                score = max(score, share)
        assert r.labels == ",".join(sorted(want)) and {b.label for b in r.blocks} == want and r.score <= score + 1e-9
        found += len(want)
    assert found > 100


def test_prose_of_a_templates_words(spark, tmp_path):
    rows = [row(0, "The album was released in May under a new label. The band toured with MIT students, and no license was needed"),
            row(1, "Under the sea a team from MIT released a license plate, the very one from 1998"),
            row(2, "Licensed staff met under oath; the Apache tribe, a version of the tale in 2 parts with 0 endings and no license"),
            row(3, "The tool is released under the MIT License.")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    # The second holds all words of a notice within its ten: the join is of sets, so order cannot tell it from a notice.
    assert {r.doc_id: r.labels for r in op8_license_scan(spark, str(tmp_path)).collect()} == {0: "", 1: "mit", 2: "", 3: "mit"}


def test_windows_holding():
    rng = random.Random(3)
    tokens = [rng.choice([b"a", b"b", b"c", b"x"]) for _ in range(200)]
    for width in (1, 3, 10):
        # A window may begin before the text: it ends at one of the text's words or up to a width behind.
        want = {w: sum(w in tokens[max(0, at):at + width] for at in range(0, len(tokens))) for w in (b"a", b"b")}
        got = windows_holding(tokens, {b"a", b"b"}, width)
        assert got == want


def test_fifty_megabytes_of_phrases():
    tokens = b"under the mit license foo".split() * 2_000_000
    places = phrase_places(tokens, {b"under the mit license": "mit"})
    assert len(places) == 2_000_000 and places[-1] == (len(tokens) - 5, "mit")
