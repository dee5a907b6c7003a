"""Map extracts in protocol-buffer blobs (``.osm.pbf``), as a Python data source and a writer.

A file is a run of blobs, each with its length in front and compressed alone. Planning walks
over the lengths only, without reading the blobs, and deals runs of about BYTES to input
partitions; each task seeks to its run. Dense nodes are decoded column by column: variable
length integers of a whole block at once, zigzag, running sums. Files are reached by URI, so
they may lie in any store that pyarrow knows.

Read: nodes (plain and dense), ways and their tags; relations and object metadata are
passed over. Blobs may be raw or zlib; a feature or a compression that is not known is an error,
as is a file that ends inside a blob.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id long, lat double, lon double, refs array<long>, tags map<string,string>"
#: Bytes of blobs (about) that a task reads, and objects that the writer puts in a blob.
BYTES, OBJECTS = 32 << 20, 8000
#: Fixed values of the format: nanodegrees to a step of coordinates, features that are understood.
GRANULARITY = 100
FEATURES = {b"OsmSchema-V0.6", b"DenseNodes"}


# reading of protocol buffers


def fields(data: memoryview | bytes) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of each field of a message; values are integers or bytes."""
    data, at, end = memoryview(data), 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            if at + size > end:
                raise ValueError("a field ends beyond its message")
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def varints(data: memoryview | bytes) -> np.ndarray:
    """All variable-length integers of a packed field, as unsigned numbers."""
    raw = np.frombuffer(data, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    last = np.flatnonzero(raw < 128)
    start = np.r_[0, last[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(start, last - start + 1)
    return np.add.reduceat((raw & 127).astype(np.uint64) << (7 * place).astype(np.uint64), start)


def zigzag(values: np.ndarray) -> np.ndarray:
    return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)


def unpacked(blob: bytes) -> bytes:
    """The content of a blob."""
    for number, value in fields(blob):
        if number == 1:
            return bytes(value)
        if number == 3:
            return zlib.decompress(value)
        if number in (4, 5, 6, 7):
            raise ValueError("blobs are compressed in a way other than zlib")
    return b""


def objects(block: bytes) -> Iterator[tuple]:
    """The rows of a primitive block."""
    strings, groups, step, lat0, lon0 = [], [], GRANULARITY, 0, 0
    for number, value in fields(block):
        if number == 1:
            strings = [bytes(v).decode() for n, v in fields(value) if n == 1]
        elif number == 2:
            groups.append(value)
        elif number == 17:
            step = value
        elif number == 19:
            lat0 = value - (1 << 64 if value >> 63 else 0)
        elif number == 20:
            lon0 = value - (1 << 64 if value >> 63 else 0)
    degrees = lambda origin, steps: (origin + step * steps) / 1e9
    named = lambda keys, values: {strings[k]: strings[v] for k, v in zip(keys, values, strict=True)}
    for group in groups:
        for number, value in fields(group):
            if number not in (1, 2, 3):
                continue
            got = dict(fields(value))
            if number == 2:
                ids, lats, lons = (np.cumsum(zigzag(varints(got.get(f, b"")))) for f in (1, 8, 9))
                tags = _dense_tags(varints(got.get(10, b"")).tolist(), len(ids), strings)
                for i, y, x, t in zip(ids.tolist(), degrees(lat0, lats).tolist(), degrees(lon0, lons).tolist(), tags, strict=True):
                    yield "node", i, y, x, None, t
                continue
            tags = named(varints(got.get(2, b"")).tolist(), varints(got.get(3, b"")).tolist())
            if number == 1:
                i, y, x = (int(zigzag(np.array([got[f]], np.uint64))[0]) for f in (1, 8, 9))
                yield "node", i, degrees(lat0, y), degrees(lon0, x), None, tags
            else:
                i = got[1] - (1 << 64 if got[1] >> 63 else 0)
                yield "way", i, None, None, np.cumsum(zigzag(varints(got.get(8, b"")))).tolist(), tags


def _dense_tags(flat: list[int], n: int, strings: list[str]) -> list[dict]:
    """Tags of dense nodes: pairs of string numbers, a 0 after each node; nothing at all where no node has any."""
    if not flat:
        return [{} for _ in range(n)]
    out, own, at = [], {}, 0
    while at < len(flat):
        if flat[at] == 0:
            out.append(own)
            own, at = {}, at + 1
        else:
            own[strings[flat[at]]] = strings[flat[at + 1]]
            at += 2
    return out


# the data source


def _opened(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    store, at = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else store.get_file_info(pafs.FileSelector(at))
    return store, sorted((f for f in found if f.type == pafs.FileType.File and f.base_name.endswith(".pbf")), key=lambda f: f.path)


class Run(InputPartition):
    """Data blobs of a file: (offset, size) of each."""

    def __init__(self, path: str, file: str, blobs: list[tuple[int, int]]) -> None:
        self.path, self.file, self.blobs = path, file, blobs


def blob_places(source: pa.NativeFile, size: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, offset and size of each blob; blobs themselves are skipped."""
    at = 0
    while at < size:
        source.seek(at)
        head = source.read(4)
        if len(head) < 4:
            raise ValueError("the file ends inside a blob")
        (length,) = struct.unpack(">i", head)
        got = dict(fields(source.read(length)))
        if at + 4 + length + got[3] > size:
            raise ValueError("the file ends inside a blob")
        yield bytes(got[1]), at + 4 + length, got[3]
        at += 4 + length + got[3]


class PbfReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Run]:
        store, files = _opened(self.path)
        runs = []
        for file in files:
            with store.open_input_file(file.path) as source:
                now, held = [], 0
                for kind, at, size in blob_places(source, file.size):
                    if kind == b"OSMHeader":
                        source.seek(at)
                        unknown = {bytes(v) for n, v in fields(unpacked(source.read(size))) if n == 4} - FEATURES
                        if unknown:
                            raise ValueError(f"{file.path} needs {unknown}")
                    elif kind == b"OSMData":
                        now.append((at, size))
                        held += size
                        if held >= self.size:
                            runs.append(Run(self.path, file.path, now))
                            now, held = [], 0
                if now:
                    runs.append(Run(self.path, file.path, now))
        return runs or [Run(self.path, "", [])]

    def read(self, partition: Run) -> Iterator[tuple]:
        if not partition.blobs:
            return
        store, _ = _opened(self.path)
        with store.open_input_file(partition.file) as source:
            for at, size in partition.blobs:
                source.seek(at)
                yield from objects(unpacked(source.read(size)))


class PbfSource(DataSource):
    """``spark.read.format("osmpbf").load(file or folder)``; option ``runBytes``: bytes of blobs a task."""

    @classmethod
    def name(cls) -> str:
        return "osmpbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PbfReader:
        return PbfReader(self.options["path"], int(self.options.get("runbytes", BYTES)))


def scan(spark: SparkSession, path: str, run_bytes: int = BYTES) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon, tags) and ways (id, refs, tags), as the XML scan gives them."""
    spark.dataSource.register(PbfSource)
    rows = spark.read.format("osmpbf").option("runBytes", str(run_bytes)).load(path)
    return rows.where("kind = 'node'").select("id", "lat", "lon", "tags"), rows.where("kind = 'way'").select("id", "refs", "tags")


# writing


def _number(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _number(number << 3) + _number(value)
    return _number(number << 3 | 2) + _number(len(value)) + value


def _signed(values: list[int]) -> bytes:
    """Differences, zigzag, packed."""
    return b"".join(_number((d << 1) ^ (d >> 63)) for d in np.diff(np.array(values, np.int64), prepend=0).tolist())


def _blob(kind: bytes, content: bytes) -> bytes:
    body = _field(2, len(content)) + _field(3, zlib.compress(content))
    head = _field(1, kind) + _field(3, len(body))
    return struct.pack(">i", len(head)) + head + body


def block(nodes: list[tuple], ways: list[tuple]) -> bytes:
    """A primitive block of nodes (id, lat, lon, tags) as dense nodes and of ways (id, refs, tags)."""
    number: dict[str, int] = {"": 0}
    place = lambda text: number.setdefault(text, len(number))
    groups = b""
    if nodes:
        tags = [x for *_, t in nodes for x in [*(place(s) for kv in sorted(t.items()) for s in kv), 0]]
        steps = lambda k: [round(n[k] * 1e9 / GRANULARITY) for n in nodes]
        dense = _field(1, _signed([n[0] for n in nodes])) + _field(8, _signed(steps(1))) + _field(9, _signed(steps(2)))
        groups += _field(2, _field(2, dense + (_field(10, b"".join(map(_number, tags))) if any(tags) else b"")))
    if ways:
        packed = b""
        for i, refs, t in ways:
            keys, values = (b"".join(_number(place(kv[k])) for kv in sorted(t.items())) for k in (0, 1))
            packed += _field(3, _field(1, i) + _field(2, keys) + _field(3, values) + _field(8, _signed(refs)))
        groups += _field(2, packed)
    return _field(1, b"".join(_field(1, s.encode()) for s in number)) + groups


def write(rows: DataFrame, folder: str) -> int:
    """Rows of SCHEMA as files below ``folder``, one for each partition; returns their number.

    A task writes under a name of its own and renames at the end, so a task that is lost or
    run twice leaves no file that counts. Coordinates are kept to 1e-7 degrees.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        store, base = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        store.create_dir(base)
        name = f"{base}/part-{part:05d}.osm.pbf"
        draft = f"{base}/{uuid.uuid4().hex}.draft"
        with store.open_output_stream(draft) as out:
            out.write(_blob(b"OSMHeader", b"".join(_field(4, f) for f in sorted(FEATURES))))
            for batch in batches:
                table = batch.to_pylist()
                for at in range(0, len(table), OBJECTS):
                    some = table[at : at + OBJECTS]
                    nodes = [(r["id"], r["lat"], r["lon"], dict(r["tags"] or ())) for r in some if r["kind"] == "node"]
                    out.write(_blob(b"OSMData", block(nodes, [(r["id"], r["refs"] or [], dict(r["tags"] or ())) for r in some if r["kind"] == "way"])))
        store.move(draft, name)
        yield pa.RecordBatch.from_arrays([pa.array([name])], ["file"])

    return rows.mapInArrow(save, "file string").agg(F.countDistinct("file")).first()[0]
