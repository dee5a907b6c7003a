"""SimHash near-duplicates, fingerprints compared bit-sliced.

Fingerprints. Words become lower-case (A-Z), every run of ``n`` words is a shingle, repeats
included, and a bit is set where over half of the shingles' 64-bit hashes have it. Equal
fingerprints are one from here on, so exact copies cost nothing further.

Candidates. Cut into CUTS segments, two fingerprints that differ in at most ``radius`` bits agree
in at least CUTS - radius of them; every choice of so many segments is a table, and fingerprints
with equal bits there share a bucket in it. Buckets of over LARGEST members are cut into blocks,
and each pair of blocks is a bucket of its own; the others are whole. Nothing is left out, and
as any pair within the radius is a link wherever it is met, a task compares whole runs of
small buckets at once.

Comparison. A run's fingerprints are stored vertically: 64 bit planes, a lane for each
fingerprint. For a query, planes that its bit is xored into are added, four at a time, into
bitwise counters by carry-save adders, which moves 64 distances by a word operation. Lanes form
blocks; as soon as all lanes of a block have exceeded the radius, the block is abandoned
for that query. Of the links in a run a task hands on a spanning forest only.

Defined cases: with fewer than ``n`` words the whole sequence is one shingle; null, empty and
blank texts have fingerprint zero and link like any other; rows that repeat and repeated ids are
rows of their own; null ids are allowed (a component's name is its smallest id that is not
null, null if there is none); no rows, no result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import attach, documents, lower_words, stored
from stepfree.llm.jaccard import components

#: Segments of a fingerprint; with a radius of 4 any two of them make a table.
CUTS = 6
#: Members of a block of a bucket too large to be compared whole.
LARGEST = 16_384
#: Fingerprints of a run, lanes of a block (64 a word), queries at once.
RUN, LANES, QUERIES = 512, 256, 128
#: Shingles whose bits are counted at once.
SHINGLES = 1 << 16
U = np.uint64


def fingerprint(text: str | None, n: int = 4, seed: int = 42) -> int:
    """The SimHash of a text; bits are counted in blocks of shingles."""
    ws = lower_words(text)
    if not ws:
        return 0
    joined = b" ".join(ws)
    if len(ws) < n:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, ws), np.int64, len(ws)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    digest = xxhash.xxh64_intdigest
    total, m = np.zeros(64, np.int64), len(ws) - n + 1
    for at in range(0, m, SHINGLES):
        first, last = starts[at : min(m, at + SHINGLES)].tolist(), ends[at + n - 1 : min(m, at + SHINGLES) + n - 1].tolist()
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)), U, len(first))
        total += planes_of_bits(h).sum(1, dtype=np.int64)
    return sum(1 << b for b in np.flatnonzero(2 * total > m).tolist())


def planes_of_bits(values: np.ndarray) -> np.ndarray:
    """64 x len(values): bit j of every value."""
    return np.unpackbits(np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id, fp (signed long) of each row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t, n) for t in batch.column("text").to_pylist()), U, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: sum and carry bits of three words."""
    u = a ^ b
    return u ^ c, (a & b) | (u & c)


class Lanes:
    """Fingerprints as bit planes, in blocks of LANES."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        pad = -len(values) % LANES
        bits = planes_of_bits(np.r_[values, np.zeros(pad, U)])
        self.planes = np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(U).reshape(64, -1, LANES // 64)
        unused = np.r_[np.zeros(len(values), np.uint8), np.ones(pad, np.uint8)]
        self.unused = np.packbits(unused, bitorder="little").view(U).reshape(-1, LANES // 64)

    def within(self, first: int, last: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, lane) of places with first <= query < last and query < lane whose fingerprints differ in at most ``radius`` bits."""
        queries = self.values[first:last]
        blocks = np.arange(first // LANES, self.planes.shape[1])
        who, block = (x.ravel() for x in np.meshgrid(np.arange(len(queries)), blocks, indexing="ij"))
        width = max(2, radius.bit_length())  # counters hold what the radius needs; a carry beyond stays in ``over``
        over = self.unused[block]
        count = [np.zeros_like(over) for _ in range(width)]
        mask = np.where(planes_of_bits(queries).astype(bool), ~U(0), U(0))
        for j in range(0, 64, 4):
            x = [self.planes[j + k][block] ^ mask[j + k][who][:, None] for k in range(4)]
            count[0], a = added(count[0], x[0], x[1])
            count[0], b = added(count[0], x[2], x[3])
            count[1], carry = added(count[1], a, b)
            for k in range(2, width):
                count[k], carry = count[k] ^ carry, count[k] & carry
            over |= carry
            if j >= 12:
                out = over | self.above(count, radius)
                alive = (out != ~U(0)).any(1)
                if not alive.all():
                    who, block, over, count = who[alive], block[alive], over[alive], [c[alive] for c in count]
                if not len(who):
                    break
        inside = ~(over | self.above(count, radius))
        item, lane = np.nonzero(np.unpackbits(inside.view(np.uint8), axis=1, bitorder="little"))
        query, lane = first + who[item], block[item] * LANES + lane
        ahead = query < lane
        return query[ahead], lane[ahead]

    @staticmethod
    def above(count: list[np.ndarray], radius: int) -> np.ndarray:
        """Lanes whose counter is above ``radius``, compared from the highest bit down."""
        more, same = np.zeros_like(count[0]), ~np.zeros_like(count[0])
        for k in reversed(range(len(count))):
            if radius >> k & 1:
                same &= count[k]
            else:
                more |= same & count[k]
                same &= ~count[k]
        return more


def forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) that span what the fingerprints' pairs within the radius join: at most one less than there are."""
    lanes = Lanes(values)
    label = np.arange(len(values))
    found: list[tuple[int, int]] = []
    for first in range(0, len(values), QUERIES):
        query, lane = lanes.within(first, min(first + QUERIES, len(values)), radius)
        apart = label[query] != label[lane]
        query, lane = query[apart], lane[apart]
        if not len(query):
            continue
        _, once = np.unique(label[query] * len(values) + label[lane], return_index=True)
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while x in parent:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        for i in once.tolist():
            a, b = root(int(label[query[i]])), root(int(label[lane[i]]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                found.append((int(query[i]), int(lane[i])))
        to = np.arange(len(values))
        for x in list(parent):
            to[x] = root(x)
        label = to[label]
    at = np.array(found, np.int64).reshape(-1, 2)
    return values[at[:, 0]], values[at[:, 1]]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Whole buckets of rows sorted by ``bucket``, small ones together until RUN rows; buckets of one row are left out."""
    kept: list[np.ndarray] = []
    size = 0
    held: list[np.ndarray] = []  # rows of the bucket that may go on in the next batch
    last = None

    def shut() -> None:
        nonlocal held, size
        whole = np.unique(np.concatenate(held)) if held else np.zeros(0, U)
        held = []
        if len(whole) > 1:
            kept.append(whole)
            size += len(whole)

    for batch in batches:
        bucket, fp = batch.column("bucket").to_numpy(), batch.column("fp").to_numpy().view(U)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
            if bucket[a] != last:
                shut()
                last = bucket[a]
                if size >= RUN:
                    yield np.unique(np.concatenate(kept))
                    kept, size = [], 0
            held.append(fp[a:b])
    shut()
    if kept:
        yield np.unique(np.concatenate(kept))


def buckets(fps: DataFrame, radius: int) -> DataFrame:
    """bucket, fp: every fingerprint in its bucket of each table, and with large buckets in that of each pair of blocks."""
    edges = [64 * k // CUTS for k in range(CUTS + 1)]
    masks = [sum(((1 << edges[s + 1]) - (1 << edges[s])) for s in chosen) for chosen in combinations(range(CUTS), CUTS - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keys = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(signed)])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    large = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > LARGEST).select("key", F.ceil(F.col("n") / LARGEST).alias("blocks"))
    large = stored(large, "large")
    n = large.count()
    if not n:
        return keyed.select(F.col("key").alias("bucket"), "fp")
    placed = attach(keyed, large, ["key"], n, F.col("fp"), "left").withColumn("block", F.pmod(F.xxhash64("fp", "key"), F.col("blocks")))
    other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pairs = placed.select("key", "fp", "block", other.alias("other"))
    bucket = F.when(F.col("other").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
    return pairs.select(bucket.alias("bucket"), "fp")


def links(fps: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between different fingerprints that join all pairs within the radius."""
    if not 0 <= radius < CUTS:
        raise ValueError(f"a radius from 0 to {CUTS - 1} is covered by {CUTS} segments")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for values in runs(batches):
            a, b = forest(values, radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    sorted_ = buckets(fps, radius).repartition("bucket").sortWithinPartitions("bucket")
    return sorted_.mapInArrow(near, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (smallest doc_id reached by links) of each row of ``docs`` (doc_id, text)."""
    rows = stored(fingerprints(docs, n), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    comps = components(stored(links(fps.select("fp"), radius), "links"))
    named = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left").where("n > 1 or comp is not null").select("fp", "least", F.coalesce("comp", "fp").alias("comp"))
    named = stored(named, "named")
    names = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    names = stored(named.select("fp", "comp").join(names, "comp").select("fp", "component_id"), "names")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    out = attach(rows, names, ["fp"], names.count(), F.xxhash64("doc_id"), "left")
    return out.select("doc_id", text, F.coalesce("component_id", "doc_id").alias("component_id"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
