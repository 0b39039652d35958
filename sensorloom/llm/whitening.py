"""Whitening of embeddings: leading eigenvectors of their covariance by Jacobi-Davidson, without forming the covariance.

The driver holds a few columns as long as a vector is wide. Every product of the covariance with such columns is one pass over
the written vectors: a task centres its rows, multiplies them twice and gives its sums, which Spark adds up. Corrections for all
pairs not yet converged are solved together by MINRES, one pass per step for the whole block; Rayleigh-Ritz on the grown
subspace gives new pairs, and a pair whose residual has reached double precision is locked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorloom.llm.common import keep, table

#: Residual, relative to the largest eigenvalue, at which a pair counts as exact: the products' own rounding.
PRECISION = 1e-13
#: MINRES steps per correction, columns of the subspace per wanted pair, and rounds after which it gives up with an error.
INNER, WIDTH, ROUNDS = 4, 5, 200
#: Eigenvalues below this share of the largest are rounding, not directions.
LEAST = 1e-11

Product = Callable[[np.ndarray], np.ndarray]


def matrix_of(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, without a copy."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(vectors: DataFrame, part: Callable[[np.ndarray], np.ndarray], size: int, width: int, kind: str = "double") -> np.ndarray:
    """The sum over all rows' matrices of ``part(rows)``, an array of ``size`` numbers: tasks add their batches, Spark the tasks."""
    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            total = total + part(matrix_of(batch.column(0), width))
        if np.ndim(total):
            yield pa.record_batch({"j": np.arange(size), "s": total})

    parts = vectors.select("x").mapInArrow(share, f"j long, s {kind}")
    out = np.zeros(size, np.int64 if kind == "long" else np.float64)
    for r in parts.groupBy("j").agg(F.sum("s").alias("s")).collect():  # ``size`` rows, whatever the input
        out[r["j"]] = r["s"]
    return out


def centred_product(vectors: DataFrame, centre: np.ndarray, n: int) -> Product:
    """``block -> covariance @ block`` over the rows of column ``x``, centred before they are multiplied."""
    width = len(centre)

    def product(block: np.ndarray) -> np.ndarray:
        def part(rows: np.ndarray) -> np.ndarray:
            rows = rows - centre
            return (rows.T @ (rows @ block)).ravel()

        return summed(vectors, part, block.size, width).reshape(block.shape) / n

    return product


def orthonormal(block: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``block`` beside the given orthonormal columns; dependent columns go."""
    size = np.linalg.norm(block, axis=0)
    block = block[:, size > 0] / size[size > 0]
    for _ in range(2):  # twice is enough
        for basis in against:
            block = block - basis @ (basis.T @ block)
    if not block.shape[1]:
        return block
    q, s, _ = np.linalg.svd(block, full_matrices=False)
    q = q[:, s > 1e-8 * max(1.0, s[0])]
    for basis in against:
        q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0]


def minres(product: Product, shifts: np.ndarray, rhs: np.ndarray, project: Callable[[np.ndarray], np.ndarray], steps: int) -> np.ndarray:
    """Columns t with P (A - shift) P t = rhs, each for its own shift, by ``steps`` steps of MINRES with one product a step.

    Every column runs its own Lanczos recurrence, and minimises its residual by Givens rotations.
    """
    beta = np.linalg.norm(rhs, axis=0)
    safe = lambda x: np.where(x == 0, 1.0, x)
    v, last_v = rhs / safe(beta), np.zeros_like(rhs)
    t, d, last_d = np.zeros_like(rhs), np.zeros_like(rhs), np.zeros_like(rhs)
    eta, next_beta = beta.copy(), np.zeros_like(beta)
    c, last_c, s, last_s = np.ones_like(beta), np.ones_like(beta), np.zeros_like(beta), np.zeros_like(beta)
    for _ in range(steps):
        w = project(product(v) - v * shifts) - last_v * next_beta
        alpha = (v * w).sum(axis=0)
        w = project(w - v * alpha)
        before, next_beta = next_beta, np.linalg.norm(w, axis=0)
        # The new column of the tridiagonal matrix under the last two rotations, then its own.
        epsilon = last_s * before
        delta, gamma = c * last_c * before + s * alpha, c * alpha - s * last_c * before
        rho = np.hypot(gamma, next_beta)
        last_c, last_s, c, s = c, s, gamma / safe(rho), next_beta / safe(rho)
        d, last_d = (v - d * delta - last_d * epsilon) / safe(rho) * (rho > 0), d
        t = t + d * (c * eta)
        eta = -s * eta
        last_v, v = v, w / safe(next_beta) * (next_beta > 1e-14 * beta)
    return t


def jacobi_davidson(product: Product, width: int, wanted: int, seed: int = 7, inner: int = INNER) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive operator, falling, and their unit vectors as columns."""
    wanted = min(wanted, width)
    locked, values = np.zeros((width, 0)), np.zeros(0)
    basis = orthonormal(np.random.default_rng(seed).standard_normal((width, min(width, 2 * wanted))))
    images = product(basis)
    top = 0.0
    for _ in range(ROUNDS):
        theta, y = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        basis, images = basis @ y, images @ y
        top = max(top, *np.abs(theta), *values)
        missing = wanted - len(values)
        ritz, residual = basis[:, :missing], images[:, :missing] - basis[:, :missing] * theta[:missing]
        residual = residual - locked @ (locked.T @ residual)
        exact = np.linalg.norm(residual, axis=0) <= PRECISION * top
        ready = len(exact) if exact.all() else int(np.argmin(exact))  # in order, so none below a pair still moving is locked
        locked, values = np.hstack([locked, ritz[:, :ready]]), np.append(values, theta[:ready])
        if len(values) == wanted:
            return values, locked
        basis, images = basis[:, ready:], images[:, ready:]
        ritz, residual, theta, exact = ritz[:, ready:], residual[:, ready:], theta[ready:], exact[ready:]
        if basis.shape[1] + len(exact) > WIDTH * wanted:  # restart with the best half
            basis, images = basis[:, :WIDTH * wanted // 2], images[:, :WIDTH * wanted // 2]
        fixed = np.hstack([locked, ritz])
        project = lambda b: b - fixed @ (fixed.T @ b)  # noqa: E731, B023
        moving = ~exact
        shifts = theta[:len(exact)][moving]
        correction = minres(product, shifts, -project(residual[:, moving]), project, inner)
        grown = orthonormal(correction, locked, basis)
        if not grown.shape[1] or basis.shape[1] + len(values) >= width:
            # The whole space is spanned: what remains is rounding, renewed by fresh products.
            grown, basis = np.zeros((width, 0)), orthonormal(basis, locked)
            images = product(basis)
        basis, images = np.hstack([basis, grown]), np.hstack([images, product(grown)]) if grown.shape[1] else images
    raise ArithmeticError(f"{wanted - len(values)} pairs had not converged after {ROUNDS} rounds")


def integer_rows(vectors: DataFrame, id_column: str, vector_column: str, scale: int, shift: int) -> DataFrame:
    """``vec_id, x``: entries as floor(scale * entry) + shift, by position."""
    entry = F.col(vector_column).cast("array<double>")
    good = F.forall(entry, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float(1 << 53)))
    return vectors.where(F.coalesce(good, F.lit(False)) & (F.size(vector_column) > 0)).select(
        F.col(id_column).alias("vec_id"), F.transform(entry, lambda c: F.floor(c * scale) + shift).alias("x"))


def deviations(rows: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sum over the dimensions of (n * x - S)^2, in 64 bits where they suffice, else in whole numbers of any size; null beyond 64 bits."""
    if float(n) * np.abs(rows - sums / n).max(initial=0) < 2.0 ** 31 / rows.shape[1]:
        return pa.array(((n * rows - sums) ** 2).sum(axis=1))
    exact = ((n * rows.astype(object) - sums.astype(object)) ** 2).sum(axis=1)
    return pa.array([int(e) if e < 1 << 63 else None for e in exact], pa.int64())


def whiten(vectors: DataFrame, components: int = 8, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 1024,
           shift: int = 100_000) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every vector and component (from 1).

    Vectors that are null or empty, or hold a null, a NaN or an entry not below 2^53 / ``scale`` take no part; of several lengths
    the commonest does (of equally common ones the longest). A repeated row counts and is returned as often as it stands. There
    are at most as many components as dimensions, and none for directions in which all vectors agree (one vector, or equal
    ones, give no rows). ``deviation`` is null where it exceeds 64 bits. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = keep(integer_rows(vectors, id_column, vector_column, scale, shift), "whitening-vectors")
    length = F.size("x")
    common = rows.groupBy(length.alias("width")).count().orderBy(F.desc("count"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width, n = common["width"], common["count"]
    rows = rows.where(length == width)
    sums = summed(rows, lambda r: r.sum(axis=0), width, width, "long")
    centre = sums / n
    trace = summed(rows, lambda r: np.array([((r - centre) ** 2).sum()]), 1, width)[0] / n
    if not trace > LEAST:
        return spark.createDataFrame([], schema)
    values, axes = jacobi_davidson(centred_product(rows, centre, n), width, components)
    axes = axes[:, values > LEAST * values[0]] / np.sqrt(values[values > LEAST * values[0]])
    explained, k = values / trace, axes.shape[1]
    mean = summed(rows, lambda r: ((r - centre) @ axes).sum(axis=0), k, width) / n

    def spread(r: np.ndarray) -> np.ndarray:
        w = (r - centre) @ axes - mean
        return (w.T @ w).ravel()

    error = float(np.abs(summed(rows, spread, k * k, width).reshape(k, k) / n - np.eye(k)).max())

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = matrix_of(batch.column("x"), width)
            each = pa.array(np.repeat(np.arange(len(r)), k))
            yield pa.record_batch({
                "vec_id": pa.array(batch.column("vec_id")).cast(pa.int64()).take(each), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(r)),
                "n": np.full(len(r) * k, n), "deviation": deviations(r, n, sums).take(each), "whitened": ((r - centre) @ axes).ravel(),
                "explained": np.tile(explained[:k], len(r)), "identity_error": np.full(len(r) * k, error)})

    return rows.mapInArrow(project, schema)


def op13_whitened_embeddings(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))
