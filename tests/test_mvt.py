"""Vector tiles: bytes that decode to the clipped geometry."""

from __future__ import annotations

import math
import random

import numpy as np

from stepfree.sources import mvt


def test_layer_round_trip():
    features = [(1, [(0, 4095)], {"t": "ramp ½", "n": -5, "f": True, "d": 0.25, "none": None}), (2**40, [(-64, 5), (4160, 5), (7, 7)], {}), (3, [(4, 4)], {"t": "ramp ½", "n": 0})]
    got = mvt.decoded(mvt.layer("hazards", features) + mvt.layer("other", []))
    assert got == {"hazards": [(i, p, {k: v for k, v in a.items() if v is not None}) for i, p, a in features], "other": []}


def test_commands_are_those_of_the_format():
    """The format's own example of a line: (2, 2), (2, 10), (10, 10)."""
    assert list(mvt.commands([(2, 2), (2, 10), (10, 10)])) == [9, 4, 4, 18, 0, 16, 16, 0]
    assert list(mvt.commands([(25, 17)])) == [9, 50, 34]


def test_clipping():
    rng = random.Random(2)
    for _ in range(300):
        a, b = (np.array([rng.uniform(-30, 30), rng.uniform(-30, 30)]) for _ in range(2))
        if rng.random() < 0.2:
            b[0] = a[0]
        part = mvt.clipped(a, b, -10, 10)
        inside = [a + (b - a) * t / 4000 for t in range(4001)]
        inside = [p for p in inside if (np.abs(p) <= 10).all()]
        if part is None:
            assert not inside
        elif inside:
            assert np.abs(part[0] - inside[0]).max() < 0.03 and np.abs(part[1] - inside[-1]).max() < 0.03


def test_points_and_lines(spark):
    rng = random.Random(6)
    rows = [(i, rng.uniform(52.45, 52.5), rng.uniform(-1.95, -1.85), rng.choice(["a", None])) for i in range(200)] + [(900, None, -1.9, "a"), (901, 52.46, -1.9, "b"), (901, 52.46, -1.9, "b")]
    points = spark.createDataFrame(rows, "id long, lat double, lon double, kind string").repartition(3)
    for zoom in (3, 14):
        found = {}
        for r in mvt.tiles(points, zoom, "p", ["kind"]).collect():
            for i, ((px, py),), a in mvt.decoded(bytes(r["tile"]))["p"]:
                assert 0 <= px < 4096 and 0 <= py < 4096
                n = 2**zoom * 4096
                lon = (r["x"] * 4096 + px) / n * 360 - 180
                lat = math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (r["y"] * 4096 + py) / n))))
                found.setdefault(i, []).append((lat, lon, a.get("kind")))
        assert sorted(found) == sorted({r[0] for r in rows if r[1] is not None}) and len(found[901]) == 2
        step = 360 / 2**zoom / 4096
        for i, lat, lon, kind in rows:
            if lat is not None:
                assert abs(found[i][0][0] - lat) <= step and abs(found[i][0][1] - lon) <= step and found[i][0][2] == kind
    line = spark.createDataFrame([(1, 52.40, -1.95, 52.50, -1.80), (2, 52.4, -1.9, 52.4, -1.9)], "id long, lat double, lon double, lat2 double, lon2 double")
    cut = mvt.tiles(line, 14, "l", []).collect()
    assert len(cut) > 8 and all(i == 1 for r in cut for i, *_ in mvt.decoded(bytes(r["tile"]))["l"])
    for r in cut:
        ((_, ends, _),) = mvt.decoded(bytes(r["tile"]))["l"]
        true = mvt.tile_place(np.array([-1.95, -1.80]), np.array([52.40, 52.50]), 14, r["x"], r["y"])
        d = (true[1] - true[0]) / np.linalg.norm(true[1] - true[0])
        for p in ends:
            away = np.array(p) - true[0]
            assert -64 <= p[0] <= 4160 and -64 <= p[1] <= 4160 and abs(away[0] * d[1] - away[1] * d[0]) < 1
    assert mvt.tiles(points.where("false"), 14, "p", ["kind"]).count() == 0


def test_a_full_tile_is_written_in_parts(spark, monkeypatch):
    """A tile of several parts holds all its features in order of id, with the tile's values."""
    monkeypatch.setattr(mvt, "PART", 100)
    rows = [(k, 52.46, -1.9, f"v{k % 7}" if k % 5 else None, k / 4) for k in range(1, 1001)]
    df = spark.createDataFrame(rows, "id long, lat double, lon double, kind string, share double").repartition(4)
    made = mvt.tiles(df, 14, "p", ["kind", "share"])
    assert "cogroup" in made._jdf.queryExecution().toString().lower()
    (tile,) = made.collect()
    got = mvt.decoded(bytes(tile["tile"]))["p"]
    assert tile["features"] == 1000 and [i for i, *_ in got] == list(range(1, 1001))
    assert all(a.get("kind") == r[3] and a["share"] == r[4] for (_, _, a), r in zip(got, rows, strict=True))


def test_query_at_sf0_001(spark, same):
    from stepfree import registry

    assert same(registry.all_queries()["sink_mvt"](spark, "/root/testdata/sf0.001"), registry.all_oracles()["sink_mvt"]) > 10
