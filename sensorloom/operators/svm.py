"""Linear support vector machine with the squared hinge, which Spark ML lacks.

For class-balanced weights r and rows scaled to z (a constant 1 as last entry, so the intercept is penalised like a weight), the
fit minimises ``|w|^2 / 2 + c * sum(r * max(0, 1 - y * w.z)^2)``. The loss is convex with a piecewise constant second derivative,
so Newton steps with halving end at the one solution after a few rounds. Each round is one pass over the training rows for all
settings at once (penalties and left-out folds): a task sums loss, gradient and curvature of its rows, Spark adds them up by
place, and the driver solves systems as large as the number of features.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.session import written

NO_FOLD = -1
#: A fit ends where the gradient has fallen to this share of the one at zero.
TOLERANCE = 1e-11


@dataclass(frozen=True)
class Scaling:
    """Means and deviations of the fitted rows, and the weights of the two classes."""

    means: np.ndarray
    deviations: np.ndarray
    weights: tuple[float, float]

    def apply(self, x: np.ndarray) -> np.ndarray:
        z = np.where(np.isnan(x), 0.0, (x - self.means) / self.deviations)
        return np.concatenate([z, np.ones((len(x), 1))], 1)


@dataclass(frozen=True)
class SquaredHinge:
    """A fitted machine: weights of the scaled features, how many rounds it took, and its gradient's share of the one at zero."""

    features: tuple[str, ...]
    scaling: Scaling
    weights: np.ndarray
    intercept: float
    c: float
    fold: int
    rounds: int
    gradient: float

    @property
    def converged(self) -> bool:
        return self.gradient <= TOLERANCE

    def terms(self) -> list[dict[str, float]]:
        s = self.scaling
        return [{"w": float(w), "m": float(m), "s": float(d)} for w, m, d in zip(self.weights, s.means, s.deviations)]

    def margin(self) -> Column:
        """Intercept plus the weighted scaled features: one fold over two arrays, so the expression stays small with many features."""
        return dot(raw(self.features), constant(self.terms(), TERMS)) + F.lit(self.intercept)


TERMS = "array<struct<w: double, m: double, s: double>>"


def constant(value, kind: str) -> Column:
    """A literal of a nested type; the optimizer folds it."""
    return F.from_json(F.lit(json.dumps({"v": value})), f"v {kind}")["v"]


def raw(features: Sequence[str]) -> Column:
    """The usable features as an array; one small function sees to all, where a case per feature is too much code to compile."""
    return F.transform(F.array(*[F.col(f).cast("double") for f in features]), lambda x: F.when(~F.isnan(x), x))


def dot(x: Column, terms: Column) -> Column:
    parts = F.zip_with(x, terms, lambda a, t: F.coalesce((a - t["m"]) / t["s"], F.lit(0.0)) * t["w"])
    return F.aggregate(parts, F.lit(0.0), lambda total, p: total + p)


def matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of an array column of equal lengths; a null is not a number."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), width)


def fold_margins(df: DataFrame, models: Sequence[SquaredHinge], fold: str, keep: Sequence[str], vector: str | None = None) -> DataFrame:
    """Each row once per penalty, as ``keep, c, margin``: the margin by the machine that did not see the row's fold.

    ``vector`` names an array column with the features, if they are packed. Terms are added one feature after the other, so equal rows have equal margins.
    """
    width = len(models[0].features)
    rows = df.select(*keep, (F.col(vector) if vector else raw(models[0].features)).alias("__x"), F.col(fold).cast("int").alias("__fold"))
    kept = list(range(len(keep)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, mine = matrix(batch.column(len(kept)), width), batch.column(len(kept) + 1).to_numpy(zero_copy_only=False)
            for m in models:
                at = np.flatnonzero(mine == m.fold)
                z = m.scaling.apply(x[at])
                margin = np.zeros(len(at))
                for j in range(width):
                    margin += z[:, j] * m.weights[j]
                same = [batch.column(i).take(pa.array(at)) for i in kept]
                yield pa.RecordBatch.from_arrays([*same, pa.array(np.full(len(at), m.c)), pa.array(margin + m.intercept)], names=[*keep, "c", "margin"])

    schema = rows.select(*keep).schema.add("c", "double").add("margin", "double")
    return rows.mapInArrow(score, schema)


def scalings(rows: DataFrame, width: int, folds: Sequence[int]) -> dict[int, Scaling]:
    """Scaling without each of the folds, from one pass that counts every fold apart.

    Each feature is a group of its own: a few numbers a group, where hundreds of aggregates side by side are too much code to compile.
    """
    entries = F.concat("x", F.array(F.when(F.col("y") < 0, 0.0), F.when(F.col("y") > 0, 0.0)))
    found = rows.select("fold", F.posexplode(entries).alias("j", "v")).groupBy("fold", "j").agg(
        F.count("v").alias("n"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop("v"), F.lit(0.0)).alias("var"))
    parts: dict[int, dict] = {}
    for r in found.collect():  # a row per fold and feature
        p = parts.setdefault(r["fold"], {"fold": r["fold"], **{name: np.zeros(width + 2) for name in ("n", "mean", "var")}})
        for name in ("n", "mean", "var"):
            p[name][r["j"]] = r[name]
    parts = [{"fold": p["fold"], **{name: p[name][:width] for name in ("n", "mean", "var")}, "n0": int(p["n"][width]), "n1": int(p["n"][width + 1])}
             for _, p in sorted(parts.items())]
    out = {}
    for k in folds:
        used = [p for p in parts if p["fold"] != k]
        n, mean, var = (np.array([p[name] for p in used]).reshape(len(used), width) for name in ("n", "mean", "var"))
        total = np.maximum(n.sum(0), 1)
        centre = (n * mean).sum(0) / total
        spread = np.sqrt((n * (var + (mean - centre) ** 2)).sum(0) / total)
        sizes = [sum(p[c] for p in used) for c in ("n0", "n1")]
        present = sum(s > 0 for s in sizes)
        out[k] = Scaling(centre, np.where(spread > 1e-12, spread, 1.0), tuple(sum(sizes) / (present * s) if s else 0.0 for s in sizes))
    return out


def derivatives(rows: DataFrame, width: int, asked: Sequence[tuple[float, int, Scaling, np.ndarray]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """Loss, gradient and curvature of the hinge part at every asked point (c, fold left out, scaling, point), in one pass."""
    d = width + 1
    upper = np.triu_indices(d)
    size = 1 + d + len(upper[0])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = np.zeros((len(asked), size)), False
        for batch in batches:
            x, y, fold = matrix(batch.column("x"), width), batch.column("y").to_numpy(), batch.column("fold").to_numpy()
            scaled: dict[int, tuple] = {}
            for i, (c, k, scaling, point) in enumerate(asked):
                if k not in scaled:
                    inside = fold != k
                    scaled[k] = scaling.apply(x[inside]), y[inside], np.where(y[inside] > 0, scaling.weights[1], scaling.weights[0])
                z, sign, weight = scaled[k]
                gap = 1.0 - sign * (z @ point)
                on = gap > 0
                z, gap, sign, weight = z[on], gap[on], sign[on], c * weight[on]
                sums[i, 0] += weight @ gap**2
                sums[i, 1:d + 1] -= 2 * (weight * gap * sign) @ z
                sums[i, d + 1:] += (2 * (z * weight[:, None]).T @ z)[upper]
                seen = True
        if seen:
            yield pa.RecordBatch.from_pandas(pd.DataFrame({"at": np.arange(sums.size), "v": sums.ravel()}), preserve_index=False)

    # Settings x features^2 numbers, whatever the number of rows.
    table = rows.mapInArrow(add, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(len(asked) * size)
    sums[table["at"].to_numpy(int)] = table["v"].to_numpy()
    out = []
    for row in sums.reshape(len(asked), size):
        curve = np.zeros((d, d))
        curve[upper] = row[d + 1:]
        out.append((row[0], row[1:d + 1], curve + np.triu(curve, 1).T))
    return out


def fit(train: DataFrame, features: Sequence[str], label: str, settings: Sequence[tuple[float, int]], fold: str | None = None,
        rounds: int = 60, vector: str | None = None) -> list[SquaredHinge]:
    """One machine per setting (penalty c, fold left out; ``NO_FOLD`` for none), all fitted together.

    Rows with a null label take no part; a label over 0 is positive. Without rows, or with one class only, the solution is still the minimum of the
    formula above (zero weights without rows). Extra columns are ignored. ``vector`` names an array column of a written table with the usable
    features; without it they are packed and written, for a table of many columns takes longer to read than one of arrays.
    """
    number = F.col(fold).cast("int") if fold else F.lit(0)
    rows = train.filter(F.col(label).isNotNull()).select(
        (F.col(vector) if vector else raw(features)).alias("x"), F.when(F.col(label) > 0, 1.0).otherwise(-1.0).alias("y"), F.coalesce(number, F.lit(0)).alias("fold"))
    rows = rows if vector else written(rows, "svm-rows")  # read once per round
    width = len(features)
    scaling = scalings(rows, width, sorted({k for _, k in settings}))
    n = len(settings)
    point = [np.zeros(width + 1) for _ in settings]
    value, slope, step, share = [np.inf] * n, [None] * n, [0.0] * n, [np.inf] * n
    move, start, taken, trial = [None] * n, [0.0] * n, [0] * n, list(point)
    left = list(range(n))
    for k in range(1, rounds + 1):
        found = derivatives(rows, width, [(settings[i][0], settings[i][1], scaling[settings[i][1]], trial[i]) for i in left])
        going = []
        for i, (loss, gradient, curve) in zip(left, found):
            loss, gradient = loss + trial[i] @ trial[i] / 2, gradient + trial[i]
            size = float(np.abs(gradient).max())
            if slope[i] is None:
                start[i] = size or 1.0
            elif loss > value[i] + 1e-4 * step[i] * (slope[i] @ move[i]) + 1e-13 * abs(value[i]) and step[i] > 1e-6:
                step[i] /= 2
                trial[i] = point[i] + step[i] * move[i]
                going.append(i)
                continue
            point[i], value[i], slope[i], share[i], taken[i] = trial[i], loss, gradient, size / start[i], k
            if share[i] > TOLERANCE:
                move[i], step[i] = -np.linalg.solve(curve + np.eye(len(gradient)), gradient), 1.0
                trial[i] = point[i] + move[i]
                going.append(i)
        left = going
        if not left:
            break
    return [SquaredHinge(tuple(features), scaling[f], point[i][:-1], float(point[i][-1]), float(c), f, taken[i], share[i])
            for i, (c, f) in enumerate(settings)]


def optimality(model: SquaredHinge, train: DataFrame, label: str) -> DataFrame:
    """Per feature (and the intercept) the mean and deviation the fit used, its weight, and the gradient there per row, summed by
    plain aggregates: zero at the solution."""
    y = F.when(F.col(label) > 0, 1.0).otherwise(-1.0)
    weight = F.when(F.col(label) > 0, model.scaling.weights[1]).otherwise(model.scaling.weights[0])
    scaled = F.zip_with(raw(model.features), constant(model.terms(), TERMS), lambda a, t: F.coalesce((a - t["m"]) / t["s"], F.lit(0.0)))
    weights = [float(w) for w in model.weights]
    rows = train.filter(F.col(label).isNotNull()).select(y.alias("__y"), weight.alias("__r"), scaled.alias("__z"))
    margin = F.aggregate(F.zip_with("__z", constant(weights, "array<double>"), lambda z, w: z * w), F.lit(0.0), lambda total, p: total + p) + F.lit(model.intercept)
    pull = F.lit(2.0 * model.c) * F.col("__r") * F.col("__y") * F.greatest(F.lit(0.0), F.lit(1.0) - F.col("__y") * margin)
    # A group per coordinate: sums of all side by side are too much code to compile.
    listed = rows.select(pull.alias("__pull"), F.concat("__z", F.array(F.lit(1.0))).alias("__z")).select("__pull", F.posexplode("__z").alias("j", "z"))
    sums = listed.groupBy("j").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__pull") * F.col("z")).alias("s"))
    names = [*model.features, "intercept"]
    means, deviations = [*model.scaling.means, 0.0], [*model.scaling.deviations, 1.0]
    known = [{"j": j, "feature": name, "mean": float(m), "deviation": float(d), "weight": w} for j, (name, m, d, w) in enumerate(
        zip(names, means, deviations, [*weights, float(model.intercept)]))]
    known = train.sparkSession.range(1).select(F.inline(constant(known, "array<struct<j: int, feature: string, mean: double, deviation: double, weight: double>>")))
    return known.join(sums, "j", "left").select("feature", "mean", "deviation", "weight", F.abs(
        (F.col("weight") - F.coalesce("s", F.lit(0.0))) / F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).alias("gradient"))
