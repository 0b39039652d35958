"""Fits on Fourier features: Spark's fit without keeping the features."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression

from sensorloom.operators import drift, fourier

GRID = [(0.3, 16), (1.1, 16), (1.1, 24)]


def rows(spark, far=0):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) * [0.6, 0.3, 0.2] + [5.0, 2.0, 1.0]
    x[:far] += 40.0
    x[100:150] = x[50:100]  # equal rows
    return spark.createDataFrame([(int(i % 3 == 0), *map(float, r)) for i, r in enumerate(x)], "label int, x double, y double, z double")


def test_features_are_made_for_the_result_only(spark, monkeypatch):
    called, plain = [], drift.fourier_features
    monkeypatch.setattr(drift, "fourier_features", lambda *args: called.append(args) or plain(*args))
    df = rows(spark).drop("label")
    weights, settings = drift.density_ratio_weight(df.filter("x < 5.2"), df.filter("x >= 4.8"), ["x", "y"], (0.2, 0.5), (8, 4), rounds=4)
    assert len(called) == 1 and settings.count() == 4 and weights.count() == df.filter("x < 5.2").count()


@pytest.mark.parametrize("cells,far", [(False, 0), (True, 0), (True, 7)])
def test_fits_are_those_of_spark(spark, monkeypatch, cells, far):
    monkeypatch.setattr(fourier, "FEATURE_NS", 1e4 if cells else 1e-4)  # which is cheaper: products or features
    df = rows(spark, far)
    cols, n = ["x", "y", "z"], df.count()
    data = fourier.Features(df, cols, GRID, 42)
    assert bool(len(data.layout.cells)) == cells
    models = fourier.logistic_fits(data, 12)
    x = np.array(df.select(cols).collect())
    theta = {}
    margins = fourier.margins(data.layout, models, x, theta)
    for i, (gamma, size) in enumerate(GRID):
        z = fourier.features(x, *fourier.frequencies(3, gamma, size, 42))
        assert np.allclose(data.mean[i], z.mean(0), atol=1e-10) and np.allclose(data.deviation[i], z.std(0, ddof=1), atol=1e-9)
        model = LogisticRegression(featuresCol="f", labelCol="label", regParam=1.0 / n, maxIter=12, standardization=False).fit(
            drift.fourier_features(df, cols, gamma, size, name="f"))
        want = z @ model.coefficients.toArray() + model.intercept
        assert np.allclose(z @ models[i][0] + models[i][1], want, atol=1e-6) and np.allclose(margins[i], want, atol=1e-6)
        assert (margins[i][100:150] == margins[i][50:100]).all()
    scored = fourier.scored(data, models).toPandas()
    assert np.allclose(np.sort(scored["m1"]), np.sort(margins[1]), atol=1e-12)
    assert np.allclose([r[0] for r in df.select(fourier.margin(data, 1, models[1])).collect()], margins[1], atol=1e-12)


def test_one_class_and_values_without_a_feature(spark):
    df = rows(spark).drop("label")
    weights, settings = drift.density_ratio_weight(df, df.limit(0), ["x", "y"], (0.2,), (4,))
    assert {r["weight"] for r in weights.select("weight").collect()} == {0.2} and settings.first()["domain_auc"] == 0.5
    with pytest.raises(ValueError):
        drift.density_ratio_weight(df.limit(0), df.limit(0), ["x", "y"], (0.2,), (4,))
    with pytest.raises(ValueError):
        drift.density_ratio_weight(df.selectExpr("if(x > 5, null, x) AS x", "y"), df, ["x", "y"], (0.2,), (4,))
    weights, _ = drift.density_ratio_weight(df.selectExpr("1.0D AS x", "2.0D AS y"), df.selectExpr("1.0D AS x", "2.0D AS y"), ["x", "y"], (0.2,), (4,))
    assert {round(r["weight"], 9) for r in weights.select("weight").collect()} == {1.0}
