"""Small tables with the awkward cases: nulls, empty and very long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, record string, rank int, start long, "
          "chunk int, bucket int, size long, shard int, head string, word string, n long, rep long, key string, bands string, `end` string, blocks int")
EXTRA = (0.5, True, "r", 1, 2, 3, 4, 5, 6, "h", "w", 7, 8, "k", "b", "e", 9)


def row(doc_id, text, source="a", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def mixed_rows(seed=3, n=120):
    """Random texts with a hot group of copies (a third of the rows), near copies, repeated rows and odd texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)] + ["Été", "naïve", "日本"]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    hot, base = "Hot TEXT " + text(20), text(40)
    out = []
    for i in range(n):
        source = ("a", "b", None, "c", "é")[i % 5] if i % 3 else "a"
        kind = i % 6
        if kind in (0, 1):
            t = hot if i % 4 else hot.lower()
        elif kind == 2:
            words = base.split()
            words[rng.randrange(40)] = rng.choice(vocab)
            t = " ".join(words)
        else:
            t = text(rng.randrange(1, 60))
        out.append(row(i, t, source))
    out += [row(1000, None), row(1001, ""), row(1002, "  \n\t "), row(1003, None, None), row(1004, text(20000), "b"),
            row(1005, "x" * 5000, "b"), row(1006, "<|endoftext|> a  b \n c d"), row(7, out[7][1], out[7][3])]
    return out
