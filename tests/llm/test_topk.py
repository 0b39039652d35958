import math
import random

from sensorloom.llm.topk import integer_vectors, top_k


def test_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.0, 0.5, -0.25, 0.1]) for _ in range(rng.choice([0, 3, 8, 8, 8]))]) for i in range(90)]
    rows += [(100 + i, [0.5] * 8) for i in range(60)]  # ties
    rows += [(200, None), (201, [None, 1.0]), (202, [math.nan]), (203, [math.inf]), (5, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, terms string, score int")
    vectors = integer_vectors(df)
    got = {}
    for r in top_k(vectors, vectors.where("vec_id % 10 = 0"), k=5, query_block=4, row_block=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    import numpy as np
    ints = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, e in ints:
        if q % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(e, f)), i) for i, f in ints if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(best)], q
    assert got.keys() == {q for q, _ in ints if q % 10 == 0}


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (50, [2.0])], "vec_id long, embedding array<float>")
    v = integer_vectors(df)
    assert sorted(map(tuple, top_k(v, v).collect())) == [(0, 1, 50, 256 * 512), (50, 1, 0, 256 * 512)]
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0
