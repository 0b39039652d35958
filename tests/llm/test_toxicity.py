import itertools
import random

import numpy as np
from llm_cases import documents, mixed_rows, row

from sensorloom.llm.toxicity import FLOOR, THRESHOLD, Field, Scorer, drop_toxic, fit, fit_field, score_toxicity


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    field = Field(rng.normal(size=4), rng.normal(size=(2, 2)))
    codes, lengths = rng.integers(0, 4, (5, 6)), np.array([6, 1, 3, 5, 2])
    got = field.marginals(codes, lengths)
    for s in range(5):
        weight, total = np.zeros(6), 0.0
        for tags in itertools.product((0, 1), repeat=int(lengths[s])):
            score = sum(t * (field.emit[c] + (field.emit[0] if c else 0)) for t, c in zip(tags, codes[s])) + sum(field.step[a, b] for a, b in zip(tags, tags[1:]))
            total += np.exp(score)
            weight[:len(tags)] += np.exp(score) * np.array(tags)
        assert np.allclose(got[s], weight / total)


def test_whole_sentences():
    """Sentences of any length, with and without evidence, equal one chain without cuts."""
    rng = np.random.default_rng(8)
    words = ["eins", "zwei", "drei", "vier"]
    for step in (rng.normal(size=(2, 2)), np.array([[2.0, -3.0], [-3.0, 2.5]])):
        field = Field(np.array([-1.5, 3.0, 1.0]), step)
        model = Scorer({b"=zwei": (1, 3.0), b"=drei": (2, 1.0)}, field)
        texts, want = [], []
        for lengths in ((1,), (32,), (33,), (64, 3, 65), (500,), (7, 200, 31)):
            for share in ([1, 0, 0, 0], [0.97, 0.02, 0.01, 0], [0.4, 0.3, 0.2, 0.1]):
                sentences = [rng.choice(4, size=k, p=share) for k in lengths]
                texts.append(". ".join(" ".join(words[w] for w in s) for s in sentences))
                p = [field.marginals(np.where(s == 1, 1, np.where(s == 2, 2, 0))[None], np.array([len(s)]))[0] for s in sentences]
                flat = np.concatenate(p)
                want.append((flat.max(), np.log1p(flat[flat >= FLOOR].sum()), np.log1p(len(flat)), int((flat > 0.5).sum())))
        measures, spans = model.measure(texts)
        assert np.allclose(measures, np.array(want)[:, :3], atol=1e-9)
        for text, found, (_, _, _, n) in zip(texts, spans, want):
            assert sum(len(text[a:b].split()) for a, b, _ in found) == n
        many, spans = model.measure([" ".join((["zwei"] * 3 + ["eins"] * 7) * 30_000), "zwei zwei zwei. " * 9_000])
        p = field.marginals(np.tile([1] * 3 + [0] * 7, 30_000)[None], np.array([300_000]))[0]
        assert np.allclose(many[0], (p.max(), np.log1p(p[p >= FLOOR].sum()), np.log1p(300_000)))
        assert np.isclose(many[1, 1], np.log1p(9_000 * field.marginals(np.array([[1, 1, 1]]), np.array([3]))[0].clip(FLOOR).sum()))
        assert len(spans[1]) in (1, 9_000)


def test_fit_separates():
    codes, lengths = np.array([[1, 0, 2], [0, 0, 0], [2, 2, 0]]), np.array([3, 3, 2])
    field = fit_field(codes, (codes == 1).astype(int), lengths, np.array([50.0, 500.0, 50.0]), 2)
    p = field.marginals(codes, lengths)
    assert p[0, 0] > 0.8 and p[1].max() < 0.05 and p[2].max() < 0.2


def toy(n=400):
    rng = random.Random(5)
    clean = [f"{a}{b}" for a in ("mor", "tel", "san", "vip") for b in ("a", "en", "or", "ist")]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(5, 60))
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "grobak" + rng.choice("abcdef")]))
        rows.append(row(i, " ".join(words) + "."))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_spans(spark):
    rows, labels = toy()
    docs = documents(spark, rows)
    table = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = fit(docs.select("doc_id", "text"), table.where("doc_id < 250"))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    for i, toxic in labels:
        assert (got[i].score >= THRESHOLD) == bool(toxic), i
        for s in got[i].spans:
            assert "idiot" in rows[i][1][s.start:s.end].lower() or "grobak" in rows[i][1][s.start:s.end]
    kept = drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, t in labels if not t}
    odd = documents(spark, mixed_rows()[-8:])
    assert all(0 <= r.score <= 1 and not r.spans for r in score_toxicity(odd, model).collect()) and drop_toxic(odd, model).count() == odd.count()
    assert score_toxicity(docs.limit(0), model).count() == 0
    accents = documents(spark, [row(1, "É… ça, Idiot! é")])
    assert [(s.start, s.end) for s in score_toxicity(accents, model).first().spans] == [(7, 12)]


def test_without_labels(spark):
    docs = documents(spark, mixed_rows()[:10])
    model = fit(docs.select("doc_id", "text"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert all(r.score < THRESHOLD for r in score_toxicity(docs, model).collect())
