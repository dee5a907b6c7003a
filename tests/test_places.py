"""Profiles from tags, merged with updates; gates, percentiles and the scalability fit; widened corridors and meshes."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stepfree.functions.profile import ENTRANCE, PATH, PHOTO, RESTROOM, UPDATE_PHOTO, combined, merged, type_of, with_profile
from stepfree.operators.mesh import END, MOST, START, grids, meshes
from stepfree.operators.reports import feed
from stepfree.operators.risk import excessive, variants
from stepfree.operators.shardstats import LIMITS, percentile_nearest, quality_gates, usl_fit
from stepfree.operators.tiers import widened
from stepfree.sources.tables import read_jsonl_placed

def now():
    return F.lit("2026-05-01 00:00:00").cast("timestamp")


def built(spark, *places):
    """Profiles of (tags, asset type, observed at)."""
    rows = [(k, *p) for k, p in enumerate(places)]
    df = spark.createDataFrame(rows, "asset_id long, tags map<string,string>, asset_type string, observed_at timestamp")
    return {r["asset_id"]: r["profile"] for r in with_profile(df, now()).collect()}


def test_profile_of_a_toilet(spark):
    tags = {
        "amenity": "toilets", "Wheelchair": " Yes ", "toilets:wheelchair": "no", "toilets:grab_rails": "yes", "toilets:door:width": "95 cm", "door:width": "0,85 metres", "changing_table": "no",
        "fee": "yes", "male": "yes", "female": "yes", "image": "https://x.example/1", "mapillary": "a b*~", "note": "side door", "check_date": "2026-04", "kerb": "Rolled", "name": "North", "blank": "  ",
    }
    p = built(spark, (tags, "amenity:toilets", None))[0]
    assert p["schema_version"] == "accessibility-profile.v1" and p["last_verified_at"] == datetime(2026, 4, 1)
    assert p["path"]["kerb_height_metres"] == 0.03 and p["path"]["has_curb_ramp"] is True and p["path"]["has_step_free_access"] is True and p["path"]["wheelchair_access"] == "yes"
    (door,), (room,) = p["entrances"], p["restrooms"]
    assert door["name"] == "North" and door["door_width_metres"] == 0.85 and door["step_free"] is True
    assert (room["wheelchair_accessible"], room["has_grab_bars"], room["has_changing_table"], room["requires_key"], room["gender_access"]) == (False, True, False, True, "male;female")
    assert room["door_width_metres"] == pytest.approx(0.95)
    assert [(x["source"], x["url"], x["caption"], x["verification_status"]) for x in p["photos"]] == [
        ("osm-image", "https://x.example/1", "side door", "osm-tagged"), ("mapillary", "https://www.mapillary.com/app/?pKey=a%20b%2A~", "side door", "osm-tagged"),
    ]
    # a kerb makes it a pedestrian place too
    assert p["missing_fields"] == ["entrance", "incline_percent", "smoothness", "surface", "tactile_paving", "width_metres"]
    assert p["raw_tag_count"] == 16 and p["evidence_tags"]["wheelchair"] == "Yes" and "name" not in p["evidence_tags"]
    known = len(p["evidence_tags"])
    assert p["confidence"] == pytest.approx(0.10 + 0.65 * known / (known + 6) + 0.20 + 0.10 + 0.10, abs=6e-4) and p["verification_status"] == "verified"


def test_profile_defined_cases(spark):
    old = datetime(2020, 1, 1)
    p = built(
        spark, (None, None, None), ({}, "highway:footway", old), ({"highway": "steps", "incline": "-9 %"}, "highway:steps", None), ({"barrier": "Gate"}, "barrier:gate", None),
        ({"barrier": "kerb", "kerb:height": "20mm"}, "barrier:kerb", None), ({"sloped_curb": "no", "kerb": "flush", "incline": "up", "check_date": "soon"}, "highway:crossing", None),
    )
    assert p[0]["missing_fields"] == ["last_verified_at"] and p[0]["confidence"] == 0.1 and p[0]["entrances"] == [] and p[0]["verification_status"] == "unverified"
    assert p[1]["verification_status"] == "stale" and len(p[1]["missing_fields"]) == 6
    assert p[2]["path"]["has_stairs"] and p[2]["path"]["has_step_free_access"] is False and p[2]["path"]["incline_percent"] == -9.0 and p[2]["path"]["incline_text"] == "-9 %"
    assert p[3]["path"]["has_barrier"] and p[3]["path"]["kerb_height_metres"] is None
    assert not p[4]["path"]["has_barrier"] and p[4]["path"]["kerb_height_metres"] == 0.02 and p[4]["path"]["has_step_free_access"] is None
    assert p[5]["path"]["has_curb_ramp"] is False and p[5]["path"]["incline_percent"] is None and "last_verified_at" in p[5]["missing_fields"]


UPDATE = f"update_id long, asset_id long, source string, observed_at timestamp, path {type_of(PATH)}, entrance {type_of(ENTRANCE)}, restroom {type_of(RESTROOM)}, photos array<{type_of(UPDATE_PHOTO)}>"


def part(fields, **values):
    return tuple(values.get(f) for f in fields)


def test_merge(spark):
    df = spark.createDataFrame(
        [(1, {"amenity": "toilets", "surface": "Gravel", "image": "https://x.example/1", "toilets:wheelchair": "yes"}, "amenity:toilets", None), (2, {"highway": "footway"}, "highway:footway", None)],
        "asset_id long, tags map<string,string>, asset_type string, observed_at timestamp",
    )
    current = with_profile(df, now()).select("asset_id", "profile")
    early, late = datetime(2026, 1, 1), datetime(2026, 2, 1)
    photo = lambda url, source=None: (url, source, None, None)
    rows = [
        (9, 1, "ann", early, part(PATH, surface="sand", width_metres=0.1, has_tactile_paving=False), None, None, [photo("HTTPS://x.example/1"), photo("https://x.example/2", "field"), photo(" ")]),
        (5, 1, "bob", late, part(PATH, surface="asphalt"), part(ENTRANCE, door_width_metres=9.0), None, [photo("https://X.example/2")]),
        (7, 1, "eve", None, part(PATH, surface="mud", smoothness="bad"), None, None, []),
        (8, 99, "eve", late, part(PATH, surface="mud"), None, None, []),
    ]
    updates = spark.createDataFrame(rows, UPDATE)
    out = {r["asset_id"]: r for r in merged(current, updates, now()).collect()}
    assert set(out) == {1, 2} and not out[2]["touched"] and out[2]["profile"]["last_verified_at"] is None
    p = out[1]["profile"]
    assert (p["path"]["surface"], p["path"]["smoothness"], p["path"]["width_metres"], p["path"]["has_tactile_paving"]) == ("asphalt", "bad", 0.3, False)
    assert p["entrances"][0]["door_width_metres"] == 3.0 and p["restrooms"][0]["wheelchair_accessible"] is True
    assert [(x["source"], x["url"], x["taken_at"]) for x in p["photos"][1:]] == [("field", "https://x.example/2", early)] and len(p["photos"]) == 2
    assert p["last_verified_at"] == late and p["missing_fields"] == ["changing_table", "incline_percent", "kerb", "toilets_door_width_metres", "toilets_grab_bars", "wheelchair_access"]
    assert p["confidence"] == pytest.approx(0.15 + 0.65 * 9 / 15 + 0.20 + 0.10, abs=6e-4) and p["verification_status"] == "verified"
    # one row an asset however its rows lie, none of an empty table
    again = {r["asset_id"]: r for r in merged(current, updates.repartition(5), now()).collect()}
    assert again == out
    assert combined(updates.limit(0)).count() == 0 and merged(current, updates.limit(0), now()).where("touched").count() == 0
    assert dict(p["photos"][0].asDict()).keys() == PHOTO.keys()


ROUTE = "k string, shards int, edges int, truncated boolean, has_landmarks boolean, artifact_bytes long, payload_bytes long, cold_ms double, hot_ms double, preprocess_ms double, pack_ms double, store_read_ms double, unpack_ms double"


def test_gates(spark):
    good = (3, 100, False, True, 1000, 1000, 10.0, 5.0, 1.0, 1.0, 1.0, 1.0)
    big = (65, 10, True, False, 40 << 20, 9 << 20, 2000.5, 500.0, 1.0, 751.0, 500.0, 500.0)  # not cached: its hot load, read and unpacking are not held to the limits
    slow = (3, 30_000, False, False, 1, 1, None, 101.0, 1.0, 1.0, 151.0, 152.0)
    routes = spark.createDataFrame([("good", *good), ("good", *good), ("bad", *big), ("slow", *slow)], ROUTE)
    sources = spark.createDataFrame([("good", False, 4, 4), ("bad", True, 4, 3), ("slow", False, 0, 0), ("none", False, 0, 0)], "k string, truncated boolean, shards int, persisted int")
    out = {r["k"]: r for r in quality_gates(routes, sources, ["k"]).collect()}
    assert out["good"]["passed"] and out["good"]["routes"] == 2 and out["good"]["p95_hot_ms"] == 5.0
    assert out["none"]["passed"] and out["none"]["routes"] == 0 and out["none"]["p95_hot_ms"] == 0
    assert out["bad"]["warnings"] == [
        "source graph was truncated before profiling completed", "at least one profiled route graph slice was truncated", "max payload 9437184 bytes exceeds 8388608 bytes",
        "max artifact 41943040 bytes exceeds 33554432 bytes", "max cold graph load 2000.5ms exceeds 2000.0ms", "max artifact pack 751.0ms exceeds 750.0ms", "max source shards per route 65 exceeds 64",
        "1 route bundle(s) exceed the limit of distributed payloads and will not be cached", "landmarks were expected but missing on at least one eligible route slice", "only 3/4 source shards were persisted",
    ]
    assert [w.split(" exceeds")[0] for w in out["slow"]["warnings"]] == ["max cacheable hot graph load 101.0ms", "max cacheable artifact store read 151.0ms", "max cacheable artifact unpack 152.0ms"]
    free = quality_gates(routes, sources, ["k"], LIMITS | {"distributed_bytes": 0}, landmarks=False, persist=False).where("k = 'bad'").collect()[0]
    assert not any("landmarks" in w or "persisted" in w or "bundle" in w for w in free["warnings"]) and any("hot" in w for w in free["warnings"])


def test_percentile(spark):
    rows = [("a", v) for v in (5, 1, 1, 9)] + [("b", 7), ("b", None), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    of = lambda share: {r["k"]: r["v"] for r in percentile_nearest(df, ["k"], "v", share).collect()}
    assert of(0.5) == {"a": 1, "b": 7} and of(0.75) == {"a": 5, "b": 7} and of(0.95) == {"a": 9, "b": 7} and of(0.0) == {"a": 1, "b": 7}


def test_usl(spark):
    law = lambda n: 100 * n / (1 + 0.05 * (n - 1) + 0.002 * n * (n - 1))
    fit = usl_fit(spark.createDataFrame([(float(n), law(n)) for n in (1, 2, 4, 8, 16, 32)], "n double, x double")).collect()[0]
    assert (fit["gamma"], round(fit["sigma"], 6), round(fit["kappa"], 6)) == (100.0, 0.05, 0.002)
    assert fit["peak"] == pytest.approx((0.95 / 0.002) ** 0.5) and fit["at_peak"] == pytest.approx(law(fit["peak"]))
    straight = usl_fit(spark.createDataFrame([(float(n), 3.0 * n) for n in (1, 2, 4)], "n double, x double")).collect()[0]
    assert straight["sigma"] == straight["kappa"] == 0 and straight["peak"] is None
    assert usl_fit(spark.createDataFrame([], "n double, x double")).count() == 0


def test_widened(spark):
    df = spark.createDataFrame([(300.0,), (1999.5,), (0.2,), (2500.0,)], "b double")
    got = {r["b"]: r["w"] for r in df.select("b", widened(F.col("b")).alias("w")).collect()}
    assert got == {300.0: [600.0, 1200.0, 2000.0], 1999.5: [], 0.2: [4.0, 8.0], 2500.0: []}
    assert df.select(widened(F.col("b"), attempts=0)).first()[0] == []


def test_mesh(spark):
    trips = spark.createDataFrame([(1, 52.48, -1.9, 52.481, -1.898), (2, 52.48, -1.9, 52.48, -1.9), (3, 52.0, -1.9, 53.0, -1.9), (4, 52.0, -1.9, 52.2, -1.9)], "id long, lat0 double, lon0 double, lat1 double, lon1 double")
    g = {r["id"]: r for r in grids(trips).collect()}
    assert g[1]["dlat"] == 0.0007 and g[3]["dlat"] == 0.02 and g[4]["dlat"] == 0.005 and all(r["rows"] <= MOST for r in g.values())
    none = spark.createDataFrame([], "lat double, lon double, severity double")
    arcs = meshes(trips.where("id < 3"), none).cache()
    for i in (1, 2):
        r, c = int(g[i]["rows"]), int(g[i]["cols"])
        own = arcs.where(F.col("id") == i)
        inner = 2 * ((r + 1) * c + r * (c + 1) + 2 * r * c)
        assert own.where("src > 0 and dst > 0").count() == inner and own.where(F.col("src") == START).count() == 8 and own.where(F.col("dst") == END).count() == 8
    a = {(r["id"], r["src"], r["dst"]): r for r in arcs.collect()}
    assert all((i, t, s) in a for i, s, t in a) and all(r["dist"] > 0 and 0.4 <= r["lighting"] <= 1 for r in a.values())
    spot = spark.createDataFrame([(52.4805, -1.899, 0.9)] * 3, "lat double, lon double, severity double")
    risky = meshes(trips.where("id = 1"), spot)
    assert 0 < risky.where("base_safety > 0.5 and src > 0 and dst > 0").count() < risky.count()
    arcs.unpersist()


def test_lines_of_split_files(spark, tmp_path):
    """Rows keep their line number however the file is cut into blocks; splits are files or folders."""
    import json

    for split, n in (("train", 500), ("test", 3), ("validation", 0)):
        (tmp_path / f"{split}.jsonl").write_text("".join(json.dumps({"v": i, "s": split, "pad": "x" * (i % 50)}) + "\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for cut in ("4096", "134217728"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", cut)
            rows = read_jsonl_placed(spark, str(tmp_path), "v long, s string").collect()
            assert len(rows) == 503 and all(r["v"] == r["source_index"] and r["s"] == r["source_split"] for r in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_variants_and_feed(spark):
    rows = [(1, 0, 500.0, 400.0, 10.0), (1, 1, 505.0, 390.0, 9.0), (1, 2, 900.0, 300.0, 50.0), (2, 0, 500.0, 400.0, 10.0)]
    df = spark.createDataFrame(rows, "request_id int, alt int, distance_m double, duration_s double, risk double")
    out = variants(df.withColumn("score", F.lit(None).cast("double")))
    without = variants(df.withColumn("score", F.col("distance_m")))
    assert sorted(map(tuple, without.collect())) == [(1, "fastest", 2)]
    assert sorted(map(tuple, out.collect())) == [(1, "fastest", 2), (1, "shortest", 0), (2, "shortest", 0)]
    osm = spark.range(3000).select("id", F.lit("reported").alias("status"), F.lit("2026-01-01").cast("timestamp").alias("reported_at"))
    db = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, "verified").otherwise("reported").alias("status"), F.timestamp_seconds("id").alias("reported_at"))
    by = lambda status: {r["ord"]: (r["n"], r["low"]) for r in feed(osm, db, status).groupBy("ord").agg(F.count("*").alias("n"), F.min("id").alias("low")).collect()}
    assert by(None) == {0: (2500, 0), 1: (5000, 1000)} and by("reported") == {0: (2500, 0), 1: (3000, 1)} and by("verified") == {1: (3000, 0)}


def test_detours(spark):
    df = spark.createDataFrame([(1, 100.0, 301.0), (1, 100.0, 400.0), (2, 100.0, 300.0), (2, 100.0, 900.0), (3, 49.0, 900.0), (4, 0.0, 10.0)], "id int, m double, d double")
    out = {r["id"]: r["x"] for r in df.groupBy("id").agg(excessive(F.col("m"), F.col("d")).alias("x")).collect()}
    assert out == {1: True, 2: False, 3: False, 4: False}
