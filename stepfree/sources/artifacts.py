"""Stored graphs: shards as compact, signed artifacts, and releases that readers see whole.

An artifact is a shard's edges, or a chunk of them where a shard has more than CHUNK, column
by column: whole numbers as differences in variable length, texts by dictionary, truth values
as bits, null masks, all compressed. Its SHA-256 stands in the manifest of a release.

A release writes artifacts to a new folder, then its manifest (one row an artifact, with the
folder that holds it), and at last a numbered commit file, by renaming a finished draft to a
name that must be free. Readers take the highest commit: they see the release before or the
one after, never parts of both, and what an interrupted release has left behind is seen by
none. Replacing shards writes new artifacts for the touched shards only; the new manifest
takes over the rows of all others.

Reading checks every artifact's digest and fails on one that is missing or changed; ``validate``
lists them instead.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfree.operators.graph import graph, sharded
from stepfree.registry import query
from stepfree.shared import new_folder, stored
from stepfree.sources.pbf import varints, zigzag
from stepfree.views import with_views

#: Edges of an artifact, at most about.
CHUNK = 50_000
MAGIC = b"SFG1"
SHARD = ("shard_y", "shard_x")


class NoRelease(LookupError):
    """There is no such release."""


# the format


def varint_bytes(values: np.ndarray) -> bytes:
    """Unsigned numbers in variable length: seven bits a byte, the highest bit says that another follows."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 10):
        size += v >= np.uint64(1) << np.uint64(7 * k)
    own = np.repeat(np.arange(len(v)), size)
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out = (v[own] >> (7 * place).astype(np.uint64)).astype(np.uint8) & 127
    return (out | np.where(place < size[own] - 1, 128, 0).astype(np.uint8)).tobytes()


def signed_bytes(values: np.ndarray) -> bytes:
    v = values.astype(np.int64)
    return varint_bytes(((v << 1) ^ (v >> 63)).view(np.uint64))


def encoded(table: pa.Table) -> bytes:
    """The columns of a table: longs, ints, doubles, booleans and texts, any of them null."""
    columns, body = [], []
    for field in table.schema:
        column = table[field.name].combine_chunks()
        valid = np.asarray(column.is_valid())
        if pa.types.is_integer(field.type):
            x = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = [signed_bytes(np.diff(x, prepend=0))]
        elif pa.types.is_floating(field.type):
            parts = [column.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8").tobytes()]
        elif pa.types.is_boolean(field.type):
            parts = [np.packbits(column.fill_null(False).to_numpy(zero_copy_only=False)).tobytes()]
        elif pa.types.is_string(field.type):
            d = column.fill_null("").dictionary_encode()
            texts = [t.encode() for t in d.dictionary.to_pylist()]
            parts = [varint_bytes(np.array([len(t) for t in texts], np.uint64)), b"".join(texts), varint_bytes(d.indices.to_numpy())]
        else:
            raise TypeError(f"{field.name}: no format for {field.type}")
        parts.append(np.packbits(valid).tobytes() if not valid.all() else b"")
        columns.append({"name": field.name, "type": str(field.type), "sizes": [len(p) for p in parts]})
        body += parts
    head = json.dumps({"rows": table.num_rows, "columns": columns}).encode()
    return MAGIC + zlib.compress(struct.pack("<I", len(head)) + head + b"".join(body), 6)


def decoded(data: bytes) -> pa.Table:
    """The table that ``encoded`` made ``data`` of."""
    if data[:4] != MAGIC:
        raise ValueError("not a graph artifact, or of another version")
    raw = zlib.decompress(data[4:])
    (size,) = struct.unpack("<I", raw[:4])
    head, at = json.loads(raw[4 : 4 + size]), 4 + size
    n, out = head["rows"], {}
    for c in head["columns"]:
        parts = []
        for size in c["sizes"]:
            parts.append(raw[at : at + size])
            at += size
        null = ~np.unpackbits(np.frombuffer(parts[-1], np.uint8), count=n).astype(bool) if parts[-1] else None
        kind = {"int64": pa.int64(), "int32": pa.int32(), "double": pa.float64(), "bool": pa.bool_(), "string": pa.string()}[c["type"]]
        if c["type"] in ("int64", "int32"):
            values = np.cumsum(zigzag(varints(parts[0]))) if n else np.zeros(0, np.int64)
        elif c["type"] == "double":
            values = np.frombuffer(parts[0], "<f8")
        elif c["type"] == "bool":
            values = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=n).astype(bool)
        else:
            ends = np.cumsum(varints(parts[0]).astype(np.int64))
            texts = np.array([parts[1][b - s : b].decode() for s, b in zip(varints(parts[0]).tolist(), ends.tolist(), strict=True)], dtype=object)
            values = texts[varints(parts[2]).astype(np.int64)] if n else np.array([], dtype=object)
        out[c["name"]] = pa.array(values, kind, mask=null)
    return pa.table(out)


# artifacts


def artifacts(edges: DataFrame) -> DataFrame:
    """shard_y, shard_x, chunk, n, payload of edges (id, shard_y, shard_x, ...), sorted by id in each."""
    chunks = edges.groupBy(*SHARD).agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = edges.join(chunks, [*SHARD]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("chunks")

    def one(table: pa.Table) -> pa.Table:
        key = {c: table[c].slice(0, 1) for c in (*SHARD, "chunk")}
        body = table.drop_columns([*SHARD, "chunk"]).sort_by("id")
        return pa.table({**key, "n": pa.array([body.num_rows], pa.int64()), "payload": pa.array([encoded(body)], pa.binary())})

    return dealt.groupBy(*SHARD, "chunk").applyInArrow(one, "shard_y long, shard_x long, chunk int, n long, payload binary")


def edges_of(found: DataFrame, schema: T.StructType) -> DataFrame:
    """The edges of artifacts (shard_y, shard_x, payload)."""
    names = [f.name for f in schema if f.name not in SHARD]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                table = decoded(batch.column("payload")[k].as_py())
                shard = {c: pa.array(np.full(table.num_rows, batch.column(c)[k].as_py()), pa.int64()) for c in SHARD}
                yield from pa.table({**{c: table[c] for c in names}, **shard}).to_batches()

    kinds = ", ".join(f"`{c}` {schema[c].dataType.simpleString()}" for c in names)
    return found.select(*SHARD, "payload").mapInArrow(rows, f"{kinds}, shard_y long, shard_x long")


# releases

_MANIFEST = "shard_y long, shard_x long, chunk int, n long, bytes long, digest string, folder string"
_STORED = "shard_y long, shard_x long, chunk int, n long, payload binary"


class GraphStore:
    """Releases of a graph below a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def releases(self) -> list[int]:
        path, store = self._path("commits")
        names = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def commit(self, release: int | None = None) -> dict:
        """What the commit file of a release (the latest, if none is named) says."""
        known = self.releases()
        number = release if release is not None else known[-1] if known else None
        if number not in known:
            raise NoRelease(f"{self.folder} has no release {number if number is not None else ''}")
        (row,) = self.spark.read.text(f"{self.folder}/commits/{number:08d}", wholetext=True).collect()
        return json.loads(row["value"])

    def manifest(self, release: int | None = None) -> DataFrame:
        return self.spark.read.schema(_MANIFEST).parquet(self.commit(release)["manifest"])

    def prepare(self, edges: DataFrame) -> DataFrame:
        """Write the artifacts of edges to a new folder; their manifest rows."""
        folder = f"{self.folder}/artifacts/{uuid.uuid4().hex}"
        artifacts(edges).write.parquet(folder)
        kept = self.spark.read.schema(_STORED).parquet(folder)
        return kept.select(*SHARD, "chunk", "n", F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.lit(folder).alias("folder"))

    def publish(self, manifest: DataFrame, schema: T.StructType) -> int:
        """Write a manifest, then commit it under the next number; another release that took the number meanwhile is an error."""
        folder = f"{self.folder}/manifests/{uuid.uuid4().hex}"
        manifest.write.parquet(folder)
        kept = self.spark.read.schema(_MANIFEST).parquet(folder)
        n, edges, mark = kept.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.bit_xor(F.xxhash64(*SHARD, "chunk", "digest")), F.lit(0))).first()
        number = (self.releases() or [0])[-1] + 1
        text = json.dumps({"release": number, "manifest": folder, "artifacts": n, "edges": edges, "mark": mark, "schema": schema.json()})
        self._rename(text, f"commits/{number:08d}")
        return number

    def _rename(self, text: str, name: str) -> None:
        draft, store = self._path(f"drafts/{uuid.uuid4().hex}")
        out = store.create(draft)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._path(name)
        store.mkdirs(target.getParent())
        jvm = self.spark.sparkContext._jvm
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        # without an option to overwrite, renaming to a name that is taken fails
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, none)

    def release(self, edges: DataFrame) -> int:
        """A release of exactly these edges (id, ..., shard_y, shard_x)."""
        return self.publish(self.prepare(edges), edges.schema)

    def replace(self, edges: DataFrame, region: DataFrame) -> int:
        """A release in which the shards of ``region`` (shard_y, shard_x) hold ``edges`` and nothing else, and all others are as before.

        Edges outside the region are an error.
        """
        before = self.commit()
        if edges.join(region, [*SHARD], "left_anti").limit(1).count():
            raise ValueError("there are edges outside the region they replace")
        if T.StructType.fromJson(json.loads(before["schema"])).simpleString() != edges.schema.simpleString():
            raise ValueError("the columns differ from those of the release")
        rest = self.manifest().join(region.distinct(), [*SHARD], "left_anti")
        return self.publish(rest.unionByName(self.prepare(edges)), edges.schema)

    def _found(self, release: int | None) -> DataFrame:
        """Manifest rows with their payload, null where it is missing, and how many rows the folder has for it."""
        manifest = self.manifest(release)
        folders = [r["folder"] for r in manifest.select("folder").distinct().collect()]  # one for each release that still counts
        there = None
        for folder in folders:
            path, store = self._path(folder.removeprefix(f"{self.folder}/"))
            if store.exists(path):
                part = self.spark.read.schema(_STORED).parquet(folder).select(*SHARD, "chunk", "payload", F.lit(folder).alias("folder"))
                there = part if there is None else there.unionByName(part)
        if there is None:
            return manifest.withColumn("payload", F.lit(None).cast("binary"))
        return manifest.join(there, [*SHARD, "chunk", "folder"], "left")

    def read(self, release: int | None = None, region: DataFrame | None = None) -> DataFrame:
        """The edges of a release (of some shards of it); an artifact that is missing or changed fails the read."""
        schema = T.StructType.fromJson(json.loads(self.commit(release)["schema"]))
        found = self._found(release)
        if region is not None:
            found = found.join(region.distinct(), [*SHARD], "left_semi")
        name = F.concat_ws(", ", *SHARD, "chunk")
        sound = F.when(F.col("payload").isNull(), F.raise_error(F.concat(F.lit("missing artifact "), name))).when(
            F.sha2("payload", 256) != F.col("digest"), F.raise_error(F.concat(F.lit("damaged artifact "), name))
        )
        checked = found.withColumn("payload", F.coalesce(sound.cast("binary"), F.col("payload")))
        return edges_of(checked, schema).select(*schema.names)

    def validate(self, release: int | None = None) -> DataFrame:
        """shard_y, shard_x, chunk, status (ok, missing, damaged) of every artifact of a release."""
        status = F.when(F.col("payload").isNull(), "missing").when(F.sha2("payload", 256) != F.col("digest"), "damaged").otherwise("ok")
        return self._found(release).select(*SHARD, "chunk", status.alias("status"))

    def sound(self, release: int | None = None) -> bool:
        """Whether the manifest is the one that was committed and all its artifacts are sound."""
        commit = self.commit(release)
        n, mark = self.manifest(release).agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*SHARD, "chunk", "digest")), F.lit(0))).first()
        return (n, mark) == (commit["artifacts"], commit["mark"]) and self.validate(release).where("status != 'ok'").isEmpty()


def shard_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the graph with their shards."""
    nodes, edges = graph(spark, sf_dir)
    return sharded(nodes, edges).select(*edges.columns, *SHARD)


_SHARDED = "s as (select e.*, floor((a.lat + b.lat) / 2 / 0.01e0)::bigint as shard_y, floor((a.lon + b.lon) / 2 / 0.01e0)::bigint as shard_x from edge e join node a on a.id = e.src join node b on b.id = e.dst)"
_BAND = "shard_y % 3 = 0"


def _store(spark: SparkSession, sf_dir: str) -> GraphStore:
    store = GraphStore(spark, new_folder(spark, "graph"))
    store.release(shard_edges(spark, sf_dir))
    return store


@query("sink_artifact", with_views(f"with {_SHARDED} select shard_y, shard_x, 0::integer as chunk, count(*) as n from s group by 1, 2"))
def sink_artifact(spark, sf_dir):
    """The artifacts of all edges, as their manifest lists them."""
    return _store(spark, sf_dir).manifest().select(*SHARD, "chunk", "n")


@query("read_artifact", with_views(f"with {_SHARDED} select * from s"))
def read_artifact(spark, sf_dir):
    """All edges with all columns, through artifacts."""
    return _store(spark, sf_dir).read()


def _lit(spark: SparkSession, sf_dir: str) -> GraphStore:
    """Two releases: all edges, then the shards of every third row replaced by well-lit edges, without those with stairs."""
    store = _store(spark, sf_dir)
    edges = shard_edges(spark, sf_dir).where(_BAND)
    store.replace(edges.where("not has_stairs").withColumn("lighting", F.lit(1.0)), edges.select(*SHARD))
    return store


@query("sink_replace", with_views(f"with {_SHARDED} select id, shard_y, shard_x, case when {_BAND} then 1e0 else lighting end as lighting from s where not ({_BAND} and has_stairs)"))
def sink_replace(spark, sf_dir):
    """The graph after a load that touches a third of its shards."""
    return _lit(spark, sf_dir).read().select("id", *SHARD, "lighting")


@query("graph_release", with_views(f"""with {_SHARDED} select 1 as release, count(*) as edges, count(distinct (shard_y, shard_x)) as shards from s
union all select 2, count(*) filter (not ({_BAND} and has_stairs)), count(distinct (shard_y, shard_x)) filter (not ({_BAND} and has_stairs)) from s"""))
def graph_release(spark, sf_dir):
    """Edges and shards of both releases, counted by reading them."""
    store = _lit(spark, sf_dir)
    counted = lambda r: store.read(r).agg(F.lit(r).alias("release"), F.count("*").alias("edges"), F.countDistinct(*SHARD).alias("shards"))
    return counted(1).unionByName(counted(2))


@query("graph_validate", with_views(f"with {_SHARDED} select shard_y, shard_x, 'ok' as status from s where not ({_BAND} and has_stairs) group by 1, 2"))
def graph_validate(spark, sf_dir):
    """Every shard of the second release, read again and held against its digest."""
    return stored(_lit(spark, sf_dir).validate(), "validated").select(*SHARD, "status")
