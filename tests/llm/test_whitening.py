from fractions import Fraction

import numpy as np
import pytest

from sensorloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, n long, x string, component int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3) for i, v in vectors], SCHEMA)


def cloud(rows, width, seed=1):
    rng = np.random.default_rng(seed)
    points = rng.standard_normal((rows, width)) * np.geomspace(1, 0.05, width) @ rng.standard_normal((width, width)) * 0.2
    return points.astype(np.float32)


def check(got, points, k):
    x = np.floor(1024 * points.astype(float)).astype(np.int64) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    want = centred @ axes / np.sqrt(values)
    have = np.full((n, k), np.nan)
    for r in got:
        have[r.vec_id, r.component - 1] = r.whitened
        assert r.n == n and r.identity_error <= 1e-10
        assert abs(r.explained * (centred ** 2).sum() / n / values[r.component - 1] - 1) < 1e-10
        assert r.deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[r.vec_id], sums))
    assert len(got) == n * k
    sign = np.sign((have * want).sum(axis=0))
    assert np.abs(have * sign - want).max() < 1e-7


@pytest.mark.parametrize("rows,width,parts", [(300, 20, 1), (300, 20, 7), (50, 5, 3), (12, 30, 2)])
def test_against_a_dense_eigensolver(spark, rows, width, parts):
    points = cloud(rows, width)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(points)]).repartition(parts)
    check(whitening.whiten(df).collect(), points, min(8, width))


def test_awkward_rows(spark):
    points = cloud(40, 6)
    odd = [(90, None), (91, []), (92, [1.0, None] + [0.0] * 4), (93, [float("nan")] * 6), (94, [float("inf")] + [0.0] * 5), (95, [1.0, 2.0]), (96, [3e38] * 6)]
    got = whitening.whiten(frame(spark, [*((i, v.tolist()) for i, v in enumerate(points)), *odd])).collect()
    check(got, points, 6)
    # A third of the rows repeat one vector, identifiers may be null, and one direction is constant.
    flat = [(None, [0.5, 0.25, 1.0])] * 20 + [(i, [i / 7, (i * i % 11) / 5, 1.0]) for i in range(40)]
    got = whitening.whiten(frame(spark, flat)).collect()
    assert len(got) == 60 * 2 and {r.component for r in got} == {1, 2} and sum(r.vec_id is None for r in got) == 40
    assert all(r.identity_error < 1e-9 for r in got)


def test_no_directions(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).count() == 0
    assert whitening.whiten(frame(spark, [(i, [0.1, 2.7, 3.3]) for i in range(9)])).count() == 0


def test_deviation_beyond_64_bits():
    rows = np.array([[10**9, 0], [10**10, 5], [7, 7]])
    n, sums = 10**6, np.array([10**12, 10**3])
    exact = [sum((Fraction(n) * int(a) - int(s)) ** 2 for a, s in zip(r, sums)) for r in rows]
    assert whitening.deviations(rows, n, sums).to_pylist() == [int(e) if e < 1 << 63 else None for e in exact]


def operator(matrix, count):
    def product(block):
        count[0] += 1
        return matrix @ block
    return product


@pytest.mark.parametrize("values", [
    np.linspace(2, 1, 200),                                    # no gaps
    np.r_[[100.0] * 3, [50.0] * 4, np.linspace(1, 0, 193)],      # repeated
    np.geomspace(1e6, 1e-6, 200), np.r_[5.0, np.zeros(199)]])
def test_jacobi_davidson_on_wide_operators(values):
    q = np.linalg.qr(np.random.default_rng(3).standard_normal((200, 200)))[0]
    matrix, count = (q * values) @ q.T, [0]
    theta, u = whitening.jacobi_davidson(operator(matrix, count), 200, 8)
    assert np.abs(theta - values[:8]).max() < 1e-12 * values[0] * 10
    assert np.abs(matrix @ u - u * theta).max() < 1e-12 * values[0] and np.abs(u.T @ u - np.eye(8)).max() < 1e-12
    assert count[0] < 400


def test_minres_solves_shifted_systems():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((12, 12))
    a, shifts, rhs = a + a.T, np.array([0.3, -1.0, 9.0]), rng.standard_normal((12, 3))
    got = whitening.minres(lambda b: a @ b, shifts, rhs, lambda b: b, 14)
    for i, s in enumerate(shifts):
        assert np.allclose((a - s * np.eye(12)) @ got[:, i], rhs[:, i], atol=1e-6)
