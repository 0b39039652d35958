import numpy as np
import pytest

from sensorloom.operators import models, svm


def cloud(n=400, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1.0, 20.0, 0.1] + [0.0, 5.0, 3.0]
    y = (x[:, 0] + x[:, 1] / 20 + rng.normal(size=n) > 0.8).astype(int)
    return x, y


def loss(theta, z, sign, weight, c):
    return theta @ theta / 2 + c * (weight * np.maximum(0, 1 - sign * (z @ theta)) ** 2).sum()


def frame(spark, x, y):
    return spark.createDataFrame([(*map(float, a), int(b), i % 3, "extra") for i, (a, b) in enumerate(zip(x, y))], "p double, q double, r double, y int, fold int, x0 string")


@pytest.mark.parametrize("c", [0.1, 1.0, 20.0])
def test_minimum_against_plain_descent(spark, c):
    x, y = cloud()
    model = models.linear_svm(frame(spark, x, y), ["p", "q", "r"], "y", c)
    assert model.converged and model.rounds < 30
    z = np.concatenate([(x - x.mean(0)) / x.std(0), np.ones((len(x), 1))], 1)
    sign, weight = 2.0 * y - 1, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    theta, rate = np.zeros(4), 1 / (1 + 2 * c * np.linalg.norm(z * np.sqrt(weight)[:, None], 2) ** 2)
    for _ in range(60_000):
        gap = np.maximum(0, 1 - sign * (z @ theta))
        slope = theta - 2 * c * (weight * gap * sign) @ z
        theta = theta - rate * slope
        if np.abs(slope).max() < 1e-9:
            break
    got = np.append(model.weights, model.intercept)
    assert loss(got, z, sign, weight, c) <= loss(theta, z, sign, weight, c) + 1e-9
    assert got == pytest.approx(theta, abs=1e-5)


def test_settings_fitted_together_equal_apart(spark):
    x, y = cloud(200, 3)
    df = frame(spark, x, y).repartition(5)
    together = svm.fit(df, ["p", "q", "r"], "y", [(0.5, 0), (2.0, 1), (2.0, svm.NO_FOLD)], "fold")
    for model in together:
        rows = df.filter(f"fold <> {model.fold}")
        alone = models.linear_svm(rows, ["p", "q", "r"], "y", model.c)
        assert alone.weights == pytest.approx(model.weights, abs=1e-8) and alone.intercept == pytest.approx(model.intercept, abs=1e-8)
        assert max(r.gradient for r in svm.optimality(model, rows, "y").collect()) < 1e-9


def test_awkward_rows(spark):
    kind = "p double, q double, y int"
    empty = models.linear_svm(spark.createDataFrame([], kind), ["p", "q"], "y")
    assert not empty.weights.any() and empty.intercept == 0 and empty.converged
    one = models.linear_svm(spark.createDataFrame([(1.0, 2.0, 1), (2.0, 2.0, 1)], kind), ["p", "q"], "y")
    assert one.converged and one.intercept > 0
    odd = spark.createDataFrame([(1.0, None, 1), (float("nan"), 3.0, 0), (3.0, 4.0, None), (-2.0, 3.0, 0)] * 3, kind)
    model = models.linear_svm(odd, ["p", "q"], "y")
    scores = [r.score for r in models.margin_score(model, odd).collect()]
    assert model.converged and len(scores) == 12 and all(0 < s < 1 for s in scores)


def test_grid(spark):
    x, y = cloud(300, 4)
    got = models.svm_grid(frame(spark, x, y).drop("fold"), ["p", "q", "r"], "y", ["p"], cs=(0.25, 5.0)).orderBy("c").collect()
    assert [r.c for r in got] == [0.25, 5.0] and all(r.converged and r.average_precision > 0.6 and 0 < r.threshold < 1 for r in got)
