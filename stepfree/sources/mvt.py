"""Vector tiles: features by tile, clipped, in the tile's own steps, as protocol-buffer bytes.

Spark places features: a point in its tile, a line in every tile that its box touches. Lines are
clipped to the tile and its margin, coordinates become whole steps of the tile, and geometry is
written as move and line commands with zigzag differences. The features of a tile are written in
parts, by many tasks that know the tile's values; as its bytes are one value, one group puts them together.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions import geo
from stepfree.registry import query
from stepfree.sources.pbf import _field, _number, fields, varints, zigzag
from stepfree.views import register, with_views

#: Fixed values of the format: steps of a tile, and steps beyond its sides that lines are kept to.
EXTENT, MARGIN = 4096, 64
MOVE, LINE = 1, 2


def tile_place(lon: np.ndarray, lat: np.ndarray, zoom: int, x: int, y: int) -> np.ndarray:
    """Steps east and south of the tile's north-western corner, not rounded."""
    n = 2.0**zoom
    east = ((lon + 180) / 360 * n - x) * EXTENT
    rad = np.radians(np.clip(lat, -85.05112878, 85.05112878))
    south = ((1 - np.log(np.tan(rad) + 1 / np.cos(rad)) / math.pi) / 2 * n - y) * EXTENT
    return np.stack([east, south], 1)


def clipped(a: np.ndarray, b: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray] | None:
    """The part of a stretch inside a square, or nothing."""
    d, t0, t1 = b - a, 0.0, 1.0
    for k in (0, 1):
        if d[k] == 0:
            if not low <= a[k] <= high:
                return None
            continue
        u, v = sorted(((low - a[k]) / d[k], (high - a[k]) / d[k]))
        t0, t1 = max(t0, u), min(t1, v)
    return None if t0 > t1 else (a + t0 * d, a + t1 * d)


def commands(points: list[tuple[int, int]]) -> bytes:
    """Geometry of a point, or of a line through several."""
    steps = np.diff(np.array([(0, 0), *points], np.int64), axis=0)
    flat = ((steps << 1) ^ (steps >> 63)).tolist()
    out = [1 << 3 | MOVE, *flat[0]]
    if len(flat) > 1:
        out += [(len(flat) - 1) << 3 | LINE, *(v for s in flat[1:] for v in s)]
    return b"".join(map(_number, out))


def _value(v: object) -> bytes:
    if isinstance(v, bool):
        return _field(7, int(v))
    if isinstance(v, int):
        return _field(6, (v << 1) ^ (v >> 63))  # zigzag
    if isinstance(v, float):
        return _number(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def feature(number: int, points: list[tuple[int, int]], tags: list[int]) -> bytes:
    """A feature as a field of its layer; ``tags``: places of keys and values by turns."""
    return _field(2, _field(1, number) + _field(2, b"".join(map(_number, tags))) + _field(3, 1 if len(points) == 1 else 2) + _field(4, commands(points)))


def enclosed(name: str, body: bytes, keys: list[str], values: list[bytes]) -> bytes:
    """The layer of features that are written already."""
    table = b"".join(_field(3, k.encode()) for k in keys) + b"".join(_field(4, v) for v in values)
    return _field(3, b"".join((_field(15, 2), _field(1, name.encode()), body, table, _field(5, EXTENT))))


def layer(name: str, features: list[tuple[int, list[tuple[int, int]], dict]]) -> bytes:
    """A layer of features (id, points, attributes); null attributes are left out."""
    keys: dict[str, int] = {}
    values: dict[bytes, int] = {}
    body = []
    for number, points, attributes in features:
        tags = [t for k, v in attributes.items() if v is not None for t in (keys.setdefault(k, len(keys)), values.setdefault(_value(v), len(values)))]
        body.append(feature(number, points, tags))
    return enclosed(name, b"".join(body), list(keys), list(values))


def features_of(content: bytes) -> Iterator[tuple[int, list[tuple[int, int]], dict]]:
    """The features (id, points, attributes) of a layer, one after the other: a tile may hold very many."""
    keys, values = [], []
    for number, value in fields(content):
        if number == 3:
            keys.append(bytes(value).decode())
        elif number == 4:
            ((kind, v),) = fields(value)
            values.append({1: lambda v: bytes(v).decode(), 3: lambda v: struct.unpack("<d", v)[0], 6: lambda v: (v >> 1) ^ -(v & 1), 7: bool}[kind](v))
    for number, value in fields(content):
        if number != 2:
            continue
        f = dict(fields(value))
        tags, flat = varints(f.get(2, b"")).tolist(), varints(f[4])
        runs, at = [], 0
        while at < len(flat):
            n = int(flat[at]) >> 3
            runs.append(zigzag(flat[at + 1 : at + 1 + 2 * n]).reshape(-1, 2))
            at += 1 + 2 * n
        points = np.cumsum(np.concatenate(runs), 0).tolist()
        yield f.get(1, 0), [tuple(p) for p in points], {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}


def layers(tile: bytes) -> Iterator[tuple[str, bytes]]:
    """Name and content of each layer of a tile."""
    for _, content in fields(tile):
        yield next((bytes(v).decode() for n, v in fields(content) if n == 1), ""), content


def decoded(tile: bytes) -> dict[str, list[tuple[int, list[tuple[int, int]], dict]]]:
    """The layers of a tile, each with its features (id, points, attributes)."""
    return {name: list(features_of(content)) for name, content in layers(tile)}


#: Features of a tile (about) that a task writes.
PART = 50_000


def tiles(rows: DataFrame, zoom: int, name: str, attributes: list[str]) -> DataFrame:
    """x, y, tile (bytes), features of rows (id, lat, lon and, for lines, lat2, lon2, ...attributes); rows without a place are left out."""
    line = "lat2" in rows.columns
    ends = ["lat", "lon", "lat2", "lon2"] if line else ["lat", "lon"]
    placed = rows.dropna(subset=["id", *ends]).select("id", *ends, *attributes)
    if line:
        pad = MARGIN / EXTENT / 2.0**zoom * 360  # degrees of longitude; latitudes are denser, so it reaches there too
        xs = F.sequence(geo.tile_x(F.least("lon", "lon2") - pad, zoom), geo.tile_x(F.greatest("lon", "lon2") + pad, zoom))
        ys = F.sequence(geo.tile_y(F.greatest("lat", "lat2") + pad, zoom), geo.tile_y(F.least("lat", "lat2") - pad, zoom))
        placed = placed.withColumn("x", F.explode(xs)).withColumn("y", F.explode(ys))
    else:
        placed = placed.withColumn("x", geo.tile_x(F.col("lon"), zoom)).withColumn("y", geo.tile_y(F.col("lat"), zoom))

    keyed = placed.withColumn("x", F.col("x").cast("long")).withColumn("y", F.col("y").cast("long"))
    codes = [f"value_{k}" for k in range(len(attributes))]

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = []
            for c in attributes:
                found = batch.column(c).dictionary_encode()
                coded.append(pa.array([_value(v) for v in found.dictionary.to_pylist()], pa.binary()).take(found.indices))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("x", "y", "id", *ends)), *coded], ["x", "y", "id", *ends, *codes])

    schema = ", ".join(["x long", "y long", "id long", *(f"{c} double" for c in ends), *(f"{c} binary" for c in codes)])
    known = keyed.select("x", "y", F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in ends], *attributes).mapInArrow(valued, schema)
    most = keyed.groupBy("x", "y").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    known = known.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(-(-most // PART) or 1)))
    values = known.select("x", "y", F.explode(F.array_compact(F.array(*codes) if codes else F.array().cast("array<binary>"))).alias("value")).distinct()
    place = ["x", "y", "part"]
    given = known.select(*place).distinct().join(values, ["x", "y"]).toDF("of_x", "of_y", "of_part", "value")

    def written(part: pa.Table, own: pa.Table) -> pa.Table:
        """The features of a part of a tile; places of values are those in the whole tile's order."""
        x, y = part["x"][0].as_py(), part["y"][0].as_py()
        at = {v: k for k, v in enumerate(sorted(own["value"].to_pylist()))}
        a = tile_place(part["lon"].to_numpy(), part["lat"].to_numpy(), zoom, x, y)
        b = tile_place(part["lon2"].to_numpy(), part["lat2"].to_numpy(), zoom, x, y) if line else None
        dots = None if line else np.minimum(np.floor(a), EXTENT - 1).astype(int).tolist()
        ids, out = [], []
        for k, (i, *found) in enumerate(zip(*(part[c].to_pylist() for c in ("id", *codes)), strict=True)):
            if line:
                cut = clipped(a[k], b[k], -MARGIN, EXTENT + MARGIN)
                points = [tuple(np.floor(p + 0.5).astype(int).tolist()) for p in cut] if cut else []
                if len(set(points)) < 2:
                    continue  # outside, or shorter than a step
            else:
                points = [tuple(dots[k])]
            ids.append(i)
            out.append(feature(i, points, [t for n, v in enumerate(found) if v is not None for t in (n, at[v])]))
        n = len(ids)
        return pa.table({"x": pa.array([x] * n, pa.int64()), "y": pa.array([y] * n, pa.int64()), "id": pa.array(ids, pa.int64()), "body": pa.array(out, pa.binary()), "value": pa.nulls(n, pa.binary())})

    def joined(group: pa.Table) -> pa.Table:
        own = sorted(group["value"].drop_null().to_pylist())
        body = group.filter(pc.is_valid(group["body"])).sort_by([("id", "ascending"), ("body", "ascending")])
        if not len(body):
            return group.select(["x", "y"]).slice(0, 0).append_column("tile", pa.array([], pa.binary())).append_column("features", pa.array([], pa.int64()))
        tile = enclosed(name, b"".join(v for chunk in body["body"].chunks for v in chunk.to_pylist()), attributes, own)
        one = lambda v, kind: pa.array([v], kind)
        return pa.table({"x": one(group["x"][0].as_py(), pa.int64()), "y": one(group["y"][0].as_py(), pa.int64()), "tile": one(tile, pa.binary()), "features": one(len(body), pa.int64())})

    # the group of a tile only puts together what many tasks have written
    parts = known.groupBy(*place).cogroup(given.groupBy("of_x", "of_y", "of_part")).applyInArrow(written, "x long, y long, id long, body binary, value binary")
    whole = parts.unionByName(values.select("x", "y", F.lit(None).cast("long").alias("id"), F.lit(None).cast("binary").alias("body"), "value"))
    return whole.groupBy("x", "y").applyInArrow(joined, "x long, y long, tile binary, features long")


@query("sink_mvt", with_views("""with t as (select id, hazard_type, floor((lon + 180) / 360 * 16384)::bigint as x, floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384)::bigint as y from hazard)
select x, y, count(*) as features, count(distinct hazard_type) as kinds, sum(id)::bigint as ids from t group by x, y"""))
def sink_mvt(spark, sf_dir):
    """Tiles of all hazards at zoom 14, counted by what their bytes decode to."""
    register(spark, sf_dir, "hazard")
    made = tiles(spark.table("hazard"), 14, "hazards", ["hazard_type", "status"])

    def summed(tile):
        n, kinds, ids = 0, set(), 0
        for _, content in layers(memoryview(tile.as_buffer()).cast("B")):
            for i, _, a in features_of(content):
                n, ids = n + 1, ids + i
                kinds.add(a["hazard_type"])
        return n, len(kinds), ids

    def read(batches):
        for batch in batches:
            sums = [summed(t) for t in batch.column("tile")]
            n, kinds, ids = (pa.array([s[k] for s in sums], pa.int64()) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), n, kinds, ids], ["x", "y", "features", "kinds", "ids"])

    return made.mapInArrow(read, "x long, y long, features long, kinds long, ids long")
