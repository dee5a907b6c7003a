"""Protocol-buffer extracts: what was written is read, the same as through XML; damaged files are refused."""

from __future__ import annotations

import struct
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from stepfree.shared import new_folder
from stepfree.sources import osm, pbf

NODES = [(5, 52.4862, -1.8904, {"highway": "crossing", "name": "Straße ½"}), (3, -89.9999999, 179.9999999, {}), (9_000_000_000, 0.0, 0.0, {"a": "b"}), (-7, 1e-7, -1e-7, {})]
WAYS = [(8, [5, 3, 9_000_000_000, 5], {"highway": "steps"}), (-2, [], {}), (2**40, [3], {"x": "y", "y": "x"})]


def rows_of(nodes, ways):
    return [("node", i, y, x, None, t) for i, y, x, t in nodes] + [("way", i, None, None, r, t) for i, r, t in ways]


def near(found, wanted):
    key = lambda r: (r[0], r[1])
    for f, w in zip(sorted(found, key=key), sorted(wanted, key=key), strict=True):
        assert (f[0], f[1], f[4], dict(f[5] or {})) == (w[0], w[1], w[4], w[5])
        assert all(a == b or abs(a - b) < 1e-9 for a, b in zip(f[2:4], w[2:4], strict=True))


def test_blocks():
    near(list(pbf.objects(pbf.block(NODES, WAYS))), rows_of(NODES, WAYS))
    bare = [(i, y, x, {}) for i, y, x, _ in NODES]
    near(list(pbf.objects(pbf.block(bare, []))), rows_of(bare, []))
    assert list(pbf.objects(pbf.block([], []))) == []


def test_offsets_and_plain_nodes():
    """Coordinates with an origin and a step of their own, in a node that is not dense."""
    zig = lambda v: (v << 1) ^ (v >> 63)
    node = pbf._field(1, zig(-4)) + pbf._field(2, b"\x01") + pbf._field(3, b"\x02") + pbf._field(8, zig(-25)) + pbf._field(9, zig(7))
    block = pbf._field(1, b"".join(pbf._field(1, s) for s in (b"", b"k", b"v"))) + pbf._field(2, pbf._field(1, node)) + pbf._field(17, 1000) + pbf._field(19, 500) + pbf._field(20, -3000)
    assert list(pbf.objects(block)) == [("node", -4, (500 - 25000) / 1e9, (7000 - 3000) / 1e9, None, {"k": "v"})]


@pytest.mark.parametrize("run_bytes", [1, 1 << 20])
def test_round_trip(spark, monkeypatch, run_bytes):
    rows = [("node", i, 50 + i / 1e4, -i / 1e4, None, {"n": str(i)} if i % 3 == 0 else {}) for i in range(500)] + [("way", i, None, None, list(range(i, i + i % 7)), {"highway": "path"}) for i in range(200)]
    df = spark.createDataFrame(rows, pbf.SCHEMA).repartition(3)
    folder = "file://" + new_folder(spark, "pbf") if run_bytes == 1 else new_folder(spark, "pbf")
    assert pbf.write(df, folder) == 3
    nodes, ways = pbf.scan(spark, folder, run_bytes)
    got = [("node", r["id"], r["lat"], r["lon"], None, r["tags"]) for r in nodes.collect()] + [("way", r["id"], None, None, r["refs"], r["tags"]) for r in ways.collect()]
    near(got, rows)


def test_one_partition_for_a_run(spark):
    df = spark.createDataFrame([("node", i, 1.0, 2.0, None, {}) for i in range(pbf.OBJECTS + 5)], pbf.SCHEMA).coalesce(1)
    folder = new_folder(spark, "pbf")
    pbf.write(df, folder)
    assert pbf.scan(spark, folder, 1)[0].rdd.getNumPartitions() == len(pbf.PbfReader(folder, 1).partitions()) > 1
    assert len(pbf.PbfReader(folder, 1 << 30).partitions()) == 1


def test_same_as_xml(spark):
    path = str(Path(__file__).parent / "data" / "mini.osm")
    nodes, ways = osm.scan(spark, path)
    rows = nodes.select(F.lit("node").alias("kind"), "id", "lat", "lon", F.lit(None).cast("array<long>").alias("refs"), "tags").unionByName(
        ways.select(F.lit("way").alias("kind"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), "refs", "tags")
    )
    folder = new_folder(spark, "pbf")
    pbf.write(rows, folder)
    again = osm.edges(*pbf.scan(spark, folder)).drop("tags")
    first = osm.edges(nodes, ways).drop("tags")
    key = ["way_id", "src", "dst"]
    assert again.select(*key).exceptAll(first.select(*key)).count() == first.select(*key).exceptAll(again.select(*key)).count() == 0
    assert [r["surface"] for r in again.orderBy(*key).collect()] == [r["surface"] for r in first.orderBy(*key).collect()]


def test_damage(spark, tmp_path):
    good = pbf._blob(b"OSMHeader", pbf._field(4, b"OsmSchema-V0.6")) + pbf._blob(b"OSMData", pbf.block(NODES, WAYS))
    for name, data, error in (
        ("cut.osm.pbf", good[:-3], "ends inside"),
        ("new.osm.pbf", pbf._blob(b"OSMHeader", pbf._field(4, b"HistoricalInformation")), "needs"),
    ):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError, match=error):
            pbf.PbfReader(str(tmp_path / name), 1).partitions()
    with pytest.raises(FileNotFoundError):
        pbf.PbfReader(str(tmp_path / "none.osm.pbf"), 1).partitions()
    body = pbf._field(2, 3) + pbf._field(4, b"lzma")
    with pytest.raises(ValueError, match="other than zlib"):
        pbf.unpacked(body)
    assert pbf.unpacked(pbf._field(1, b"raw")) == b"raw" and pbf.unpacked(pbf._field(3, zlib.compress(b"z"))) == b"z"
    assert struct.unpack(">i", good[:4])[0] < 64
    (tmp_path / "empty").mkdir()
    assert pbf.scan(spark, str(tmp_path / "empty"))[0].count() == 0


def test_walkable(spark):
    cases = [
        ({"highway": "footway"}, True), ({"highway": "Crossing"}, True), ({"highway": "cycleway"}, False), ({"highway": "cycleway", "foot": "designated"}, True), ({"highway": "trunk", "foot": "yes"}, False),
        ({"highway": "path", "foot": "no"}, False), ({"highway": "path", "access": "private"}, False), ({"highway": "path", "access": "private", "foot": "yes"}, True),
        ({"highway": "path", "access": "no", "foot": "designated"}, False), ({"highway": "path", "barrier": "Wall"}, False), ({"foot": "yes"}, False), ({"highway": "bridleway", "foot": "YES"}, True),
    ]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, tags map<string,string>")
    assert [r["w"] for r in df.orderBy("k").select(osm.walkable(F.col("tags")).alias("w")).collect()] == [w for _, w in cases]
