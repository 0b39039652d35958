"""Logistic fits on random Fourier features, all settings (gamma, size) side by side.

A fit is the one of Spark's ``LogisticRegression`` without standardisation: the same objective over scaled, centred features, the same
limited-memory quasi-Newton steps and the same end. Spark's keeps the features of every row, thousands of numbers of a few columns; here a round is
one pass over the columns themselves for all settings, in which a task adds up loss and gradient of its rows.

A feature ``cos(w.x + b)`` is smooth: within a cell it is a sum of products of Chebyshev polynomials, one per column, whose coefficients fall below
``DROPPED`` after a few degrees. All features of a gamma share the products, which are far fewer than the features and need no cosine. A task turns
weights of features into weights of a cell's products and gradients back, so its rows come sorted by cell. The cells' size is the cheapest for the
rows at hand; rows in cells of too few rows, or all where products would cost more, have their features made.
"""

from __future__ import annotations

from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.session import written

#: Coefficients of products left out; a feature is at most 1 before its scale.
DROPPED = 1e-11
#: Half sides of the cells that are tried, in standard deviations of the widest column.
REACH = (5.0, 3.5, 2.5, 1.75, 1.25, 0.9, 0.6)
#: Nanoseconds: a made feature, a row's loss, and of a row or a cell's feature those of a product, a degree and an ending.
FEATURE_NS, LOSS_NS, PRODUCT_NS, DEGREE_NS, ENDING_NS, CELL_PRODUCT_NS, CELL_DEGREE_NS = 34.0, 50.0, 0.25, 2.0, 5.0, 0.5, 15.0
#: Bytes of a gamma's coefficients at most; rows worked on at once, and numbers of a block; nanoseconds of a task worth its start.
MOST_BYTES, BLOCK, NUMBERS, TASK_NS = 1 << 26, 256, 1 << 21, 2e7

Grid = tuple[tuple[float, int], ...]


def frequencies(width: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies (width x size) and phases of the features."""
    rng = np.random.default_rng(seed)
    return rng.normal(scale=np.sqrt(2.0 * gamma), size=(width, size)), rng.uniform(0.0, 2.0 * np.pi, size)


@lru_cache(maxsize=64)
def waves(width: int, gamma: float, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    return frequencies(width, gamma, size, seed)


def features(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Features of rows; equal rows have equal ones, wherever they stand."""
    at = np.zeros((len(x), len(b)))
    for i in range(len(w)):
        at += x[:, i, None] * w[i]
    return np.sqrt(2.0 / len(b)) * np.cos(at + b)


def polynomials(t: np.ndarray, degrees: int) -> np.ndarray:
    """Chebyshev polynomials (degree x column x row) of places in a cell, from -1 to 1."""
    t = np.ascontiguousarray(t.T)
    out = np.ones((max(2, degrees), *t.shape))
    out[1] = t
    t = 2.0 * t
    for k in range(2, degrees):
        np.multiply(t, out[k - 1], out=out[k])
        out[k] -= out[k - 2]
    return out


def chebyshev(a: np.ndarray) -> np.ndarray:
    """Coefficients of exp(i a t) on [-1, 1], degree x len(a), up to the last one that counts."""
    n = int(np.abs(a).max(initial=0.0) * 1.1) + 24
    at = (np.arange(2 * n) + 0.5) * np.pi / (2 * n)
    c = np.cos(np.outer(np.arange(n), at)) @ np.exp(1j * np.outer(np.cos(at), a)) / n
    c[0] /= 2
    return c[:np.flatnonzero((np.abs(c) > DROPPED).any(1)).max(initial=0) + 1]


class Chart:
    """Features of all gammas as sums of products in a cell around zero with half sides ``half``. A product is a degree of the first column times an
    ending, one degree for each other column. Endings of a gamma are those of the gammas before it and its own."""

    def __init__(self, width: int, grid: Grid, seed: int, half: float, factor: float = 1.0):
        self.grid, self.endings, self.shapes, self.parts = grid, np.zeros((0, width - 1), int), {}, {}
        for gamma in sorted(dict(grid)):
            w, b = (factor * np.concatenate(x, -1) for x in zip(*[waves(width, gamma, s, seed) for g, s in grid if g == gamma]))
            parts = [chebyshev(w[i] * half) for i in range(width)]
            ending = endings(parts)
            if ending is None:
                self.shapes = {}
                return
            known = set(map(tuple, self.endings.tolist()))
            self.endings = np.concatenate([self.endings, np.array([e for e in ending if e not in known], int).reshape(-1, width - 1)])
            self.shapes[gamma], self.parts[gamma] = (max([len(parts[0]), *[s[0] for s in self.shapes.values()]]), len(self.endings)), (w, b, parts)

    def settle(self) -> "Chart":
        """Coefficients by setting: the first column's and the endings', these as pairs of real numbers so that a product of real parts is one of real
        matrices."""
        self.waves, self.first, self.rest = {}, {}, {}
        for gamma, (w, b, parts) in self.parts.items():
            degrees, n = self.shapes[gamma]
            first, rest = np.zeros((degrees, w.shape[1]), complex), np.ones((n, w.shape[1]), complex)
            first[:len(parts[0])] = parts[0]
            for part, at in zip(parts[1:], self.endings[:n].T):
                rest *= np.where((at < len(part))[:, None], part[np.minimum(at, len(part) - 1)], 0.0)
            lo = 0
            for g, size in self.grid:
                if g == gamma:
                    at = slice(lo, lo + size)
                    self.waves[g, size], self.first[g, size] = (w[:, at], b[at]), np.ascontiguousarray(first[:, at])
                    self.rest[g, size] = np.ascontiguousarray(rest[:, at].conj()).view(float)
                    lo += size
        self.parts = {}
        return self

    def waved(self, setting: tuple[float, int], centre: np.ndarray) -> np.ndarray:
        """The first column's coefficients in a cell around ``centre``."""
        w, b = self.waves[setting]
        return self.first[setting] * np.exp(1j * (centre @ w + b))

    def spread(self, setting: tuple[float, int], v: np.ndarray, waved: np.ndarray) -> np.ndarray:
        """Weights of products (degree x ending) from those of the cosines."""
        return (waved * v).view(float) @ self.rest[setting].T

    def gather(self, setting: tuple[float, int], g: np.ndarray, waved: np.ndarray) -> np.ndarray:
        """Sums of cosines from those of products."""
        return ((g @ self.rest[setting]).view(complex).conj() * waved).sum(0).real

    def products(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first column's polynomials and the endings' products, for places in the cell."""
        p = polynomials(t, int(max(self.endings.max(initial=0) + 1, *[s[0] for s in self.shapes.values()])))
        out = np.ones((len(self.endings), len(t)))
        for i, at in enumerate(self.endings.T):
            out *= p[at, i + 1]
        return p[:, 0], out


def endings(coefficients: Sequence[np.ndarray]) -> list[tuple[int, ...]] | None:
    """Degrees of the columns but the first with a coefficient that counts in any feature; None if they are too many."""
    high = [np.maximum.accumulate(np.abs(c)[::-1])[::-1] for c in coefficients]  # never rising with the degree
    found: list[tuple[tuple[int, ...], np.ndarray]] = [((), high[0][0])]
    for i, h in enumerate(high[1:], 1):
        after = np.prod([x[0] for x in high[i + 1:]], axis=0)
        grown = []
        for e, p in found:
            n = max(1, int(np.count_nonzero([(part * p * after).max() > DROPPED for part in h])))
            # The last column's sizes are not needed again.
            grown += [((*e, k), h[k] * p if i + 1 < len(high) else p) for k in range(n)]
        found = grown
        if len(found) * high[0].shape[1] * 16 > MOST_BYTES:
            return None
    return [e for e, _ in found]


@lru_cache(maxsize=2)
def chart(width: int, grid: Grid, seed: int, half: float, factor: float = 1.0) -> Chart:
    """Made once in a process."""
    return Chart(width, grid, seed, half, factor).settle()


@dataclass(frozen=True)
class Layout:
    """What a task needs: the settings, and the cells in use by their places in a lattice around a centre."""

    cols: tuple[str, ...]
    grid: Grid
    seed: int
    centre: np.ndarray
    half: float
    cells: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        """Numbers of the rows' cells, -1 for those of no cell in use."""
        if not len(self.cells) or not len(x):
            return np.full(len(x), -1)
        at = np.clip(np.rint((x - self.centre) / (2.0 * self.half)), -1e15, 1e15).astype(int)
        known = {tuple(c): i for i, c in enumerate(self.cells.tolist())}
        found, back = np.unique(at, axis=0, return_inverse=True)
        return np.array([known.get(tuple(c), -1) for c in found.tolist()])[back.ravel()]

    def middle(self, cell: int) -> np.ndarray:
        return self.centre + 2.0 * self.half * self.cells[cell]

    def chart(self, factor: float = 1.0) -> Chart | None:
        return chart(len(self.cols), self.grid, self.seed, self.half, factor) if len(self.cells) else None

    def blocks(self, x: np.ndarray, cells: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Numbers of a few rows of one cell at a time."""
        most = max(1, min(BLOCK, NUMBERS // max(s for _, s in self.grid)))
        for cell in np.unique(cells):
            rows = np.flatnonzero(cells == cell)
            for at in range(0, len(rows), most):
                yield int(cell), rows[at:at + most]

    def within(self, x: np.ndarray, cell: int) -> np.ndarray:
        return (x - self.middle(cell)) / self.half

    def made(self, x: np.ndarray, setting: int) -> np.ndarray:
        return features(x, *waves(len(self.cols), *self.grid[setting], self.seed))


def columns(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[first:]])


def _sums(rows: DataFrame, task) -> np.ndarray:
    """What the tasks add up, each a vector: a few numbers a feature, whatever the number of rows."""
    found = rows.mapInArrow(lambda batches: iter([pa.RecordBatch.from_arrays([pa.array([task(batches).tobytes()], pa.binary())], names=["sums"])]), "sums binary")
    return np.sum([np.frombuffer(r["sums"]) for r in found.collect()], axis=0)


class Features:
    """Fourier features of the columns of rows with a ``label`` of 0 or 1, for every setting."""

    def __init__(self, rows: DataFrame, cols: Sequence[str], grid: Sequence[tuple[float, int]], seed: int):
        cols, grid = tuple(cols), tuple(grid)
        self.counts = self._described(rows, cols)
        self.layout, tasks = self._laid(rows, cols, grid, seed)
        layout = self.layout

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells = layout.place(columns(batch, 1))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cells, pa.int32()), *batch.columns[1:]], names=["label", "cell", *cols])

        placed = rows.select("label", *cols).mapInArrow(place, "label int, cell int, " + ", ".join(f"`{c}` double" for c in cols))
        # Cells in an order without meaning, so that small and large ones mix in a task.
        mixed = placed.repartitionByRange(tasks, F.xxhash64("cell"), F.xxhash64(*[F.col(f"`{c}`") for c in cols])) if tasks > 1 else placed.coalesce(1)
        self.rows = written(mixed.sortWithinPartitions("cell"), "domain-cells")
        self.mean, self.deviation = self._moments()

    @staticmethod
    def _described(rows: DataFrame, cols: Sequence[str]) -> dict:
        at = [F.col(f"`{c}`") for c in cols]
        bad = sum((F.count(F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 1)) for c in at), F.lit(0))
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("positive"), bad.alias("bad"), *[
            f(c).alias(f"{n}{i}") for i, c in enumerate(at) for n, f in (("mean", F.avg), ("std", F.stddev_pop))]).first()
        if not row["n"]:
            raise ValueError("no rows to fit")
        if row["bad"]:
            raise ValueError(f"{row['bad']} values of {', '.join(cols)} are null or not finite")
        return row.asDict()

    def _laid(self, rows: DataFrame, cols: tuple[str, ...], grid: Grid, seed: int) -> tuple[Layout, int]:
        """The cheapest size of cells, the cells that are worth their products, and into how many tasks a pass is cut."""
        made = sum(size for _, size in grid) * FEATURE_NS
        centre = np.array([self.counts[f"mean{i}"] for i in range(len(cols))])
        spread = max(self.counts[f"std{i}"] for i in range(len(cols))) or 1e-9 * max(1.0, float(np.abs(centre).max()))
        tried = []
        for reach in REACH:
            shapes = Chart(len(cols), grid, seed, reach * spread).shapes
            if shapes:
                row = sum(np.prod(shapes[g]) * PRODUCT_NS + shapes[g][0] * DEGREE_NS for g, _ in grid) + max(n for _, n in shapes.values()) * ENDING_NS
                cell = sum(s * (np.prod(shapes[g]) * CELL_PRODUCT_NS + shapes[g][0] * CELL_DEGREE_NS) for g, s in grid)
                tried.append((reach * spread, float(row), float(cell)))

        def lattice(half: float) -> Column:
            return F.array(*[F.rint((F.col(f"`{c}`") - float(m)) / (2.0 * half)) for c, m in zip(cols, centre)])

        n, loss = self.counts["n"], LOSS_NS * len(grid)
        best, least = None, n * made
        if tried:
            sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), lattice(half).alias("at"), F.lit(row).alias("row"), F.lit(cell).alias("cell"))
                                        for k, (half, row, cell) in enumerate(tried)]))
            cells = rows.select(sizes.alias("s")).select("s.*").groupBy("k", "at").agg(F.count(F.lit(1)).alias("n"), F.max("row").alias("row"), F.max("cell").alias("cell"))
            costs = cells.groupBy("k").agg(F.sum(F.least(F.col("cell") + F.col("n") * F.col("row"), F.col("n") * made)).alias("cost")).collect()  # a row per size
            for r in costs:
                if r["cost"] < least:
                    best, least = r["k"], r["cost"]
        tasks = max(1, min(2 * rows.sparkSession.sparkContext.defaultParallelism, int((least + n * loss) / TASK_NS)))
        if best is None:
            return Layout(cols, grid, seed, centre, 1.0, np.zeros((0, len(cols)), int)), tasks
        half, row, cell = tried[best]
        # Each of these cells saves the time of its products, so they are few beside the rows.
        used = rows.groupBy(lattice(half).alias("at")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * (made - row) > cell).orderBy("at").collect()
        return Layout(cols, grid, seed, centre, half, np.array([r["at"] for r in used]).reshape(-1, len(cols)).astype(int)), tasks

    def _moments(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Mean and sample deviation of the features. The square of a cosine is a cosine of twice the angle."""
        layout, n, ends = self.layout, self.counts["n"], np.cumsum([0, *[s for _, s in self.layout.grid]])

        def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            out, sums = np.zeros((2, ends[-1])), {}
            both = [layout.chart(), layout.chart(2.0)] if len(layout.cells) else []
            whole = bool(both) and bool(both[1].shapes)
            for batch in batches:
                x, cells = columns(batch, 2), batch.column(1).to_numpy()
                for cell, rows in layout.blocks(x, cells if whole else np.full(len(x), -1)):
                    if cell < 0:
                        for i in range(len(layout.grid)):
                            z = layout.made(x[rows], i)
                            out[0, ends[i]:ends[i + 1]] += z.sum(0)
                            out[1, ends[i]:ends[i + 1]] += (z * z).sum(0)
                        continue
                    for k, chart in enumerate(both):
                        first, rest = chart.products(layout.within(x[rows], cell))
                        sums[cell, k] = sums.get((cell, k), 0.0) + first @ rest.T
            for (cell, k), total in sums.items():
                for i, (g, size) in enumerate(layout.grid):
                    degrees, n = both[k].shapes[g]
                    found = both[k].gather((g, size), total[:degrees, :n], both[k].waved((g, size), layout.middle(cell)))
                    out[k, ends[i]:ends[i + 1]] += (total[0, 0] + found) / size if k else np.sqrt(2.0 / size) * found
            return out.ravel()

        first, second = _sums(self.rows, task).reshape(2, -1) / n
        var = np.maximum(second - first * first, 0.0)
        share = np.concatenate([np.full(s, float(s)) for _, s in layout.grid])
        deviation = np.where(var * share > 1e-12, np.sqrt(var * n / max(n - 1, 1)), 0.0)
        return np.split(first, ends[1:-1]), np.split(deviation, ends[1:-1])

    def losses(self, asked: dict[int, tuple[np.ndarray, float]]) -> dict[int, tuple[float, float, np.ndarray]]:
        """Per asked setting, given weights and intercept: the sums of the loss, of the residuals, and of residuals times features."""
        layout, order = self.layout, sorted(asked)
        by_gamma = {g: [i for i in order if layout.grid[i][0] == g] for g in {layout.grid[i][0] for i in order}}
        at = {g: [order.index(i) for i in some] for g, some in by_gamma.items()}
        ends, intercepts = np.cumsum([0, *[2 + layout.grid[i][1] for i in order]]), np.array([asked[i][1] for i in order])

        def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            totals, pull = np.zeros((2, len(order))), [np.zeros(layout.grid[i][1]) for i in order]
            chart, theta, pulled = layout.chart(), {}, {}

            def residual(margin: np.ndarray, y: np.ndarray) -> np.ndarray:
                small = np.exp(-np.abs(margin))
                r = np.where(margin >= 0, 1.0, small) / (1.0 + small) - y
                # A block is short enough for the product of its numbers, from 1 to 2 each.
                totals[0] += np.log((1.0 + small).prod(1)) + np.maximum(margin, 0.0).sum(1) - margin @ y
                totals[1] += r.sum(1)
                return r

            for batch in batches:
                label, x = batch.column(0).to_numpy().astype(float), columns(batch, 2)
                for cell, rows in layout.blocks(x, batch.column(1).to_numpy()):
                    y = label[rows]
                    if cell < 0:
                        r = residual(np.stack([layout.made(x[rows], i) @ asked[i][0] + asked[i][1] for i in order]), y)
                        for k, i in enumerate(order):
                            pull[k] += r[k] @ layout.made(x[rows], i)
                        continue
                    first, rest = chart.products(layout.within(x[rows], cell))
                    if cell not in theta:
                        theta[cell] = {}
                        for g, some in by_gamma.items():
                            theta[cell][g] = np.stack([chart.spread(layout.grid[i], np.sqrt(2.0 / layout.grid[i][1]) * asked[i][0], chart.waved(layout.grid[i], layout.middle(cell)))
                                                       for i in some])
                        pulled[cell] = {g: np.zeros_like(t) for g, t in theta[cell].items()}
                    margin = np.empty((len(order), len(y)))
                    for g, t in theta[cell].items():
                        _, degrees, n = t.shape
                        margin[at[g]] = ((t.reshape(-1, n) @ rest[:n]).reshape(len(t), degrees, -1) * first[:degrees]).sum(1)
                    r = residual(margin + intercepts[:, None], y)
                    for g, t in pulled[cell].items():
                        _, degrees, n = t.shape
                        t += ((r[at[g]][:, None, :] * first[:degrees]).reshape(-1, len(y)) @ rest[:n].T).reshape(t.shape)
            for cell, found in pulled.items():
                for g, sums in found.items():
                    for k, total in zip(at[g], sums):
                        setting = layout.grid[order[k]]
                        pull[k] += np.sqrt(2.0 / setting[1]) * chart.gather(setting, total, chart.waved(setting, layout.middle(cell)))
            return np.concatenate([np.append(totals[:, k], p) for k, p in enumerate(pull)])

        parts = np.split(_sums(self.rows, task), ends[1:-1])
        return {i: (float(p[0]), float(p[1]), p[2:]) for i, p in zip(order, parts)}


def margins(layout: Layout, models: dict[int, tuple[np.ndarray, float]], x: np.ndarray, theta: dict) -> list[np.ndarray]:
    """The margins by every model; ``theta`` keeps cells' weights. Terms are added one after the other, so equal rows have equal margins."""
    out, chart = [np.zeros(len(x)) for _ in models], layout.chart()
    for cell, rows in layout.blocks(x, layout.place(x)):
        first, rest = chart.products(layout.within(x[rows], cell)) if cell >= 0 else (None, None)
        for to, (i, (v, intercept)) in zip(out, models.items()):
            setting = layout.grid[i]
            total = np.zeros(len(rows))
            if cell < 0:
                for term in np.ascontiguousarray((layout.made(x[rows], i) * v).T):
                    total += term
            else:
                if (cell, i) not in theta:
                    theta[cell, i] = chart.spread(setting, np.sqrt(2.0 / setting[1]) * v, chart.waved(setting, layout.middle(cell)))
                for weights, polynomial in zip(theta[cell, i], first):
                    total += (weights[:, None] * rest[:len(weights)]).sum(0) * polynomial
            to[rows] = total + intercept
    return out


class _Failed(Exception):
    """A line search without result, or a history that is not a number."""


Asked = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def _cubic(l: tuple, r: tuple) -> float:
    (lt, ld, lf), (rt, rd, rf) = l, r
    d1 = ld + rd - 3 * (lf - rf) / (lt - rt)
    with np.errstate(invalid="ignore", divide="ignore"):
        d2 = np.sqrt(d1 * d1 - ld * rd)
        t = rt - (rt - lt) * (rd + d2 - d1) / (rd - ld + 2 * d2)
    lo, hi = lt + 0.1 * (rt - lt), lt + 0.9 * (rt - lt)
    return lo if t < lo else hi if t > hi else float(t)


def _search(x: np.ndarray, value: float, grad: np.ndarray, step: np.ndarray, t: float) -> Generator:
    """Step length that meets the strong Wolfe conditions, with the value and gradient there."""
    dd, last = float(grad @ step), None
    if dd > 0:
        raise _Failed

    def phi(t: float) -> Generator:
        nonlocal last
        f, g = yield x + t * step
        last = (f, g)
        return t, float(g @ step), f

    low = (0.0, dd, value)
    bracket = None
    for i in range(10):
        c = yield from phi(t)
        if not np.isfinite(c[2]):
            t /= 2.0
            continue
        if c[2] > value + 1e-4 * t * dd or (c[2] >= low[2] and i > 0):
            bracket = (low, c)
            break
        if abs(c[1]) <= 0.9 * abs(dd):
            return t, *last
        if c[1] >= 0:
            bracket = (c, low)
            break
        low, t = c, t * 1.5
    if bracket is None:
        raise _Failed
    low, high = bracket
    for _ in range(10):
        c = yield from phi(_cubic(high, low) if low[0] > high[0] else _cubic(low, high))
        if c[2] > value + 1e-4 * c[0] * dd or c[2] >= low[2]:
            high = c
            continue
        if abs(c[1]) <= 0.9 * abs(dd):
            return c[0], *last
        if c[1] * (high[0] - low[0]) >= 0:
            high = low
        low = c
    raise _Failed


def lbfgs(x: np.ndarray, rounds: int, memory: int = 10, tolerance: float = 1e-6, window: int = 20) -> Asked:
    """Limited-memory quasi-Newton descent that asks for value and gradient at a point and returns the last one. Steps and end are those of the optimizer
    in Spark's logistic regression."""
    value, grad = yield x
    start, seen, steps, failed, k = value, [np.inf], [], False, 0

    def ended() -> bool:
        return (k >= rounds or (len(seen) >= 2 and abs(value - max(seen)) <= tolerance * start)
                or np.linalg.norm(grad) <= max(tolerance * value, 1e-8))

    while not ended():
        try:
            step, used = grad.copy(), []
            scale = 1.0
            if steps:
                s, d = steps[0]
                scale = (s @ d) / (d @ d)
                if not scale >= 0:
                    raise _Failed
            for s, d in steps:
                used.append((s @ step) / (s @ d))
                if np.isnan(used[-1]):
                    raise _Failed
                step -= used[-1] * d
            step *= scale
            for (s, d), a in zip(reversed(steps), reversed(used)):
                step += (a - (d @ step) / (s @ d)) * s
            step = -step
            t, f, g = yield from _search(x, value, grad, step, 1.0 / np.linalg.norm(step) if k == 0 else 1.0)
            if t * np.linalg.norm(grad) < 1e-10:
                raise _Failed
        except _Failed:
            if failed:
                break
            failed, steps = True, []
            continue
        new = x + t * step
        steps = [(new - x, g - grad), *steps][:memory]
        x, value, grad, failed, k = new, f, g, False, k + 1
        seen = [*seen, value][-window:]
    return x


def logistic_fits(data: Features, rounds: int) -> dict[int, tuple[np.ndarray, float]]:
    """Weights and intercept per setting, with a penalty of ``|weights|^2 / 2`` beside the summed loss."""
    n, positive = data.counts["n"], data.counts["positive"]
    if positive in (0, n):
        return {i: (np.zeros(size), np.inf if positive else -np.inf) for i, (_, size) in enumerate(data.layout.grid)}
    inverse = [np.divide(1.0, s, out=np.zeros_like(s), where=s > 0) for s in data.deviation]

    def plain(i: int, x: np.ndarray) -> tuple[np.ndarray, float]:
        v = x[:-1] * inverse[i]
        return v, float(x[-1] - v @ data.mean[i])

    fits, points, out = {}, {}, {}
    for i, (_, size) in enumerate(data.layout.grid):
        fits[i] = lbfgs(np.append(np.zeros(size), np.log(positive / (n - positive))), rounds)
        points[i] = next(fits[i])
    while fits:
        found = data.losses({i: plain(i, points[i]) for i in fits})
        for i, (loss, rest, pull) in found.items():
            x, scaled = points[i][:-1], points[i][:-1] * inverse[i]
            grad = (pull - data.mean[i] * rest) * inverse[i] / n + scaled * inverse[i] / n
            try:
                points[i] = fits[i].send((loss / n + float(scaled @ scaled) / (2 * n), np.append(grad, rest / n)))
            except StopIteration as end:
                out[i] = plain(i, end.value)
                del fits[i]
    return out


def scored(data: Features, models: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """The label and, per setting, a column ``m<number>`` with the margin."""
    layout, names = data.layout, ["label", *[f"m{i}" for i in models]]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        theta: dict = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(m) for m in margins(layout, models, columns(batch, 2), theta)]], names=names)

    return data.rows.mapInArrow(task, "label int, " + ", ".join(f"{name} double" for name in names[1:]))


def margin(data: Features, setting: int, model: tuple[np.ndarray, float]) -> Column:
    """The margin by one model, of rows with the same columns."""
    layout = data.layout

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        theta: dict = {}
        for xs in batches:
            yield pd.Series(margins(layout, {setting: model}, np.column_stack([x.to_numpy(float) for x in xs]), theta)[0])

    return of(*[F.col(f"`{c}`").cast("double") for c in layout.cols])
