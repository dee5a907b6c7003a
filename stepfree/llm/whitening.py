"""Embedding whitening with cyclic Jacobi rotations.

Each kept component becomes the integer x = floor(scale * c) + shift. The fit list is every
distinct x vector once. Tasks add up its sums and then its centred scatter; both are sums of
integers, so the covariance is exact before its one rounding and does not depend on the
partitioning. The driver, which holds one dimension x dimension matrix and nothing that
grows with the rows, turns it by symmetric Jacobi rotations until no off-diagonal entry
matters beside its two diagonal ones; that relative test is what keeps small eigenvalues
accurate. Eigenvectors are sorted by falling eigenvalue and sent to the tasks, which project
every row; a last pass over the fit list measures how far the result is from white.

Centring before multiplying: entries are taken less floor(S / n), an integer, and the
fraction R / n that is left of the mean is settled exactly, (n * A - R R') / n^2.

Defined cases: vectors that are null or hold a null or a non-finite component are dropped;
rows that repeat and equal vectors count once in the fit and each get their rows; a vector
shorter than the longest is filled with components of 0; components beyond 2**45 in size
count as that; a ``deviation`` that leaves 64 bits is null; a component without spread
(eigenvalue lost in rounding) has ``whitened`` 0 and no part in ``identity_error``, and where
nothing spreads ``explained`` and ``identity_error`` are 0; null ids stay; no rows or no
components, no result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import finite, matrix_of, stored

#: Largest size of floor(scale * c); sums of products of all rows stay below 38 digits.
LARGEST = 1 << 45


def spread_vectors(vectors: DataFrame, scale: float, shift: int) -> tuple[DataFrame, int]:
    """vec_id and x (array of longs, all of one length) of the usable rows, and that length."""
    used = vectors.select("vec_id", "embedding").where(finite("embedding"))
    d = used.agg(F.max(F.size("embedding"))).first()[0] or 0
    whole = F.transform("embedding", lambda c: F.least(F.lit(LARGEST), F.greatest(F.lit(-LARGEST), F.floor(F.lit(scale) * c.cast("double")))) + F.lit(shift))
    return used.select("vec_id", F.concat(whole, F.array_repeat(F.lit(shift).cast("long"), F.lit(d) - F.size("embedding"))).alias("x")), d


def _decimals(values: list[int]) -> pa.Array:
    return pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and the sum of each dimension, as Python integers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            x = matrix_of(batch.column("x"), np.int64, d)
            n += len(x)
            total = [a + b for a, b in zip(total, x.sum(0).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(total)], ["i", "n", "s"])

    rows = fit.mapInArrow(add, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    return (rows[0]["n"] or 0, [int(r["s"]) for r in rows]) if rows else (0, [0] * d)


def products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact: doubles while every sum stays below 2**53, Python integers beyond."""
    top = int(np.abs(y).max(initial=0))
    if top * top * max(1, len(y)) < 2**53:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def scatter(fit: DataFrame, d: int, centre: list[int]) -> dict[tuple[int, int], int]:
    """Sums of products of the entries less ``centre``, for i <= j."""
    low, (i, j) = np.array(centre, np.int64), np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d), object)
        for batch in batches:
            total = total + products(matrix_of(batch.column("x"), np.int64, d) - low)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), _decimals(total[i, j].tolist())], ["i", "j", "v"])

    sums = fit.mapInArrow(add, "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    return {(a, b): int(v) for a, b, v in zip(*(sums[c].to_pylist() for c in ("i", "j", "v")), strict=True)}


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix with no negative eigenvalue.

    A sweep turns every pair of dimensions once, as rounds of a tournament: the pairs of a round
    share no dimension, so its rotations are applied together. Entries within rounding of
    sqrt(a_ii a_jj) are left alone; a sweep without a rotation ends it.
    """
    d = len(matrix)
    a, vectors = matrix.astype(np.float64).copy(), np.eye(d)
    seats = np.arange(d + d % 2)
    for _ in range(sweeps):
        turned = False
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = np.minimum(p, q)[real], np.maximum(p, q)[real]
            off = a[p, q]
            big = np.abs(off) > np.finfo(float).eps * np.sqrt(np.abs(a[p, p] * a[q, q]))
            p, q, off = p[big], q[big], off[big]
            if len(p):
                turned = True
                theta = (a[q, q] - a[p, p]) / (2 * off)
                t = np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                kept_p, kept_q = a[p, p] - t * off, a[q, q] + t * off
                rows_p, rows_q = a[p], a[q]
                a[p], a[q] = c[:, None] * rows_p - s[:, None] * rows_q, s[:, None] * rows_p + c[:, None] * rows_q
                for m in (a, vectors):
                    left, right = m[:, p], m[:, q]
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
                a[p, p], a[q, q] = kept_p, kept_q
                a[p, q] = a[q, p] = 0.0
            seats = np.r_[seats[:1], seats[-1:], seats[1:-1]]
        if not turned:
            break
    values = np.diag(a).copy()
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


class Whitening:
    """What a fit found: n, the sums S, and of the leading components the eigenvalue, share and column of the projection (0 without spread)."""

    def __init__(self, n: int, sums: list[int], covariance: np.ndarray, most: int) -> None:
        self.n, self.sums = n, sums
        self.centre = [s // n for s in sums]
        self.rest = [s % n for s in sums]
        values, vectors = jacobi(covariance)
        k = min(most, len(values))
        trace = float(np.trace(covariance))
        self.values = np.maximum(values[:k], 0.0)
        self.spread = self.values > len(values) * np.finfo(float).eps * max(float(values[0]), 0.0)
        self.explained = self.values / trace if trace > 0 else np.zeros(k)
        self.project = np.where(self.spread, vectors[:, :k] / np.sqrt(np.where(self.spread, self.values, 1.0)), 0.0)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - np.array(self.centre, np.int64)) - np.array([r / self.n for r in self.rest])) @ self.project

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S)^2."""
        y = x - np.array(self.centre, np.int64)
        top = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if top * top * max(1, x.shape[1]) < 2**63:
            z = self.n * y - np.array(self.rest, np.int64)
            return (z * z).sum(1).tolist()
        z = self.n * y.astype(object) - np.array(self.rest, object)
        return [v if v < 2**63 else None for v in (z * z).sum(1)]


def identity_error(fit: DataFrame, model: Whitening, d: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity, over components with spread."""
    k = len(model.values)
    i, j = np.triu_indices(k + 1)  # the last place holds ones, for the sums

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = model.whitened(matrix_of(batch.column("x"), np.int64, d))
            w = np.c_[w, np.ones(len(w))]
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], ["i", "j", "v"])

    rows = fit.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    at = {(r["i"], r["j"]): r["v"] / model.n for r in rows}
    used = np.flatnonzero(model.spread).tolist()
    return max((abs(at[a, b] - at[a, k] * at[b, k] - (a == b)) for a in used for b in used if a <= b), default=0.0)


def whiten(vectors: DataFrame, scale: float = 64.0, shift: int = 1_000_000, components: int = 16) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error of each usable row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, d = spread_vectors(vectors, scale, shift)
    if not d:
        return spark.createDataFrame([], schema)
    fit = stored(rows.select("x").distinct(), "fit")
    n, sums = totals(fit, d)
    centre = [s // n for s in sums]
    rest = [s % n for s in sums]
    covariance = np.zeros((d, d))
    for (i, j), v in scatter(fit, d, centre).items():
        covariance[i, j] = covariance[j, i] = (n * v - rest[i] * rest[j]) / (n * n)  # integers: one rounding
    model = Whitening(n, sums, covariance, components)
    error = identity_error(fit, model, d)
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix_of(batch.column("x"), np.int64, d)
            m = len(x)
            row = pa.array(np.repeat(np.arange(m), k))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n)),
                    pa.array(model.deviation(x), pa.int64()).take(row), pa.array(model.whitened(x).ravel()), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, error)),
                ], schema.replace(",", "").split()[::2],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
