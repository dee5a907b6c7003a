"""Product codes of vectors, the nearest codebook entry found through a vector-approximation file.

Every position of a vector lies in one of ``parts`` equal consecutive parts, and each part has a
codebook of ``entries`` entries. Assigning works on the approximation first: entry coordinates
are quantised to BITS bits, as cells with about equally many entries whose least and largest
coordinate are known. For a query part a lookup table holds the least and the largest squared
difference to each cell of each position; added up over the positions (a product of the table
with the entries' 0/1 cell matrix) they bound the distance to each entry from below and above.
Entries whose lower bound is above the least upper bound are out; the rest are refined with
integer distances, the least one wins and ties go to the lower index. Bounds are widened by
more than doubles can round, so they never lose an entry.

Training is a job a round: tasks assign their rows and add up counts and sums of each entry,
Spark adds these over tasks, and the driver divides. It holds entries x dimension numbers,
whatever the number of rows.

Defined cases: vectors that are null or hold a null or a non-finite component are dropped; the
first codebook takes the smallest ids, nulls last, repeated ids in the order of their vectors;
with fewer rows than ``entries`` it has as many entries as rows; all vectors are filled with
components of 0 to the longest's length, and that to a multiple of ``parts``; components count
as 2**60 in size at most; an ``error`` or ``label_error`` that leaves 64 bits is null; empty
vectors have code 0 of every part and no error; no rows, no result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import attach, finite, matrix_of, stored

#: Bits of an approximated coordinate, and vectors that are bounded at once.
BITS, BLOCK = 4, 1024
#: Beyond this size of coordinates squared distances are counted in Python integers.
PLAIN = 1 << 26
LARGEST = float(1 << 60)


def integers(column: pa.Array, scale: float, width: int) -> np.ndarray:
    """floor(scale * x) as integers, rows filled with zeros to ``width``."""
    return np.clip(np.floor(scale * matrix_of(column, np.float64, width)), -LARGEST, LARGEST).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, exact."""
    if max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0))) > PLAIN or a.shape[1] > 512:
        a, b = a.astype(object), b.astype(object)
    return ((a - b) ** 2).sum(1)


class Approximation:
    """The cells of one codebook's coordinates."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        n, d = entries.shape
        order = np.argsort(entries, axis=0, kind="stable")
        cells = min(1 << BITS, n)
        bounds = np.arange(cells + 1) * n // cells
        sorted_ = np.take_along_axis(entries, order, 0)
        self.low, self.high = sorted_[bounds[:-1]].astype(float), sorted_[bounds[1:] - 1].astype(float)  # cells x positions
        cell = np.empty((n, d), np.int64)
        np.put_along_axis(cell, order, np.repeat(np.arange(cells), np.diff(bounds))[:, None].repeat(d, 1), 0)
        #: 1 where an entry's coordinate lies in a cell: (positions * cells) x entries.
        self.places = (cell.T[:, None, :] == np.arange(cells)[None, :, None]).reshape(d * cells, n).astype(float)

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distances, queries x entries, by one lookup table a query."""
        q = queries.astype(float)[:, :, None]
        below, above = self.low.T[None] - q, q - self.high.T[None]
        top = max(np.abs(q).max(initial=0), np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0))
        slack = top * 2.0**-50 if top >= 2.0**52 else 0.0  # doubles below that hold integers exactly
        least = np.maximum(np.maximum(below, above) - slack, 0) ** 2
        most = (np.maximum(np.abs(below), np.abs(above)) + slack) ** 2
        shape = (len(queries), -1)
        return (least.reshape(shape) @ self.places) * (1 - 1e-9), (most.reshape(shape) @ self.places) * (1 + 1e-9)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each query, ties to the lower one, and its squared distance."""
        index, distance = np.zeros(len(queries), np.int64), []
        for at in range(0, len(queries), BLOCK):
            q = queries[at : at + BLOCK]
            lower, upper = self.bounds(q)
            who, entry = np.nonzero(lower <= upper.min(1)[:, None])  # by query, entries rising
            exact = squared(q[who], self.entries[entry])
            start = np.searchsorted(who, np.arange(len(q)))
            least = np.minimum.reduceat(exact, start)
            first = np.minimum.reduceat(np.where(exact == least[who], entry, len(self.entries)), start)
            index[at : at + len(q)] = first
            distance.append(least)
        return index, np.concatenate(distance) if distance else np.zeros(0, np.int64)


def first_entries(rows: DataFrame, scale: float, parts: int, width: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the ``entries`` smallest ids."""
    chosen = rows.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    return np.split(integers(chosen["embedding"].combine_chunks().cast(pa.list_(pa.float64())), scale, width), parts, axis=1)


def trained(rows: DataFrame, books: list[np.ndarray], scale: float, width: int, rounds: int) -> list[np.ndarray]:
    """The codebooks after ``rounds`` rounds of assigning and averaging; an entry without a part stays."""
    parts, step = len(books), width // len(books)

    for _ in range(rounds):
        files = [Approximation(b) for b in books]

        def add(batches: Iterator[pa.RecordBatch], files: list[Approximation] = files) -> Iterator[pa.RecordBatch]:
            counts = [np.zeros(len(f.entries), np.int64) for f in files]
            high, low = ([np.zeros(f.entries.shape, np.int64) for f in files] for _ in range(2))  # sums of the halves above and below bit 32
            for batch in batches:
                for p, part in enumerate(np.split(integers(batch.column("embedding"), scale, width), parts, axis=1)):
                    index, _ = files[p].nearest(part)
                    counts[p] += np.bincount(index, minlength=len(counts[p]))
                    np.add.at(high[p], index, part >> 32)
                    np.add.at(low[p], index, part & 0xFFFFFFFF)
            for p, n in enumerate(counts):
                used = np.flatnonzero(n)
                sums = [[Decimal(int(h) * 2**32 + int(x)) for h, x in zip(high[p][u], low[p][u], strict=True)] for u in used]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(used), p), pa.int32()), pa.array(used, pa.int32()), pa.array(n[used]), pa.array(sums, pa.list_(pa.decimal128(38, 0)))], ["part", "entry", "n", "sums"]
                )

        counted = rows.select("embedding").mapInArrow(add, "part int, entry int, n long, sums array<decimal(38,0)>")
        total = counted.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(step)])
        books = [b.copy() for b in books]
        for r in total.collect():  # a row for each used entry
            books[r["part"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(step)]
    return books


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def coded(vectors: DataFrame, scale: float = 1024.0, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each usable row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    doubles = F.col("embedding").cast("array<double>").alias("embedding")
    rows = vectors.select("vec_id", "embedding", "label").where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), "label", doubles)
    length = rows.agg(F.max(F.size("embedding"))).first()[0]
    if length is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    width = -(-max(1, length) // parts) * parts
    books = trained(rows, first_entries(rows, scale, parts, width, entries), scale, width, rounds)
    files = [Approximation(b) for b in books]
    digits = np.array([f"{e:02x}" for e in range(entries)])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, "", dtype=object), np.zeros(batch.num_rows, np.int64)
            for file, part in zip(files, np.split(integers(batch.column("embedding"), scale, width), parts, axis=1), strict=True):
                index, distance = file.nearest(part)
                code += digits[index].astype(object)
                error = error.astype(object) + distance if distance.dtype == object or error.dtype == object else error + distance
            errors = pa.array([e if e < 2**63 else None for e in error.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), errors], ["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    found = stored(rows.mapInArrow(assign, f"vec_id long, label {kind}, code string, error long"), "codes")
    whole = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = found.groupBy("label").agg(F.when(F.count_if(F.col("error").isNull()) == 0, whole).try_cast("long").alias("label_error"))
    sums = stored(sums, "labels")
    return attach(found, sums, ["label"], sums.count(), F.xxhash64("vec_id"), "left").select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def op12_code_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
