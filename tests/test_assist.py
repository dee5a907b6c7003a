"""Canonical suggestions, checklists, prompts and waypoints on cases made by hand."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from stepfree.operators import assist, evaluation, reports

SUGGESTIONS = {
    ("Kerb ramp", "no"): ("curb_ramp", "false"),
    ("ramp", "Lowered"): ("curb_ramp", "true"),
    ("Curb height", "raised"): ("kerb_height_metres", ">0.06"),
    ("kerb", "flush"): ("kerb_height_metres", "0"),
    ("Door width", "too tight"): ("door_width_metres", "measure_clear_width"),
    ("Clear-Width", "0.8 m"): ("width_metres", "0_8_m"),
    ("ground", "Paving stones!"): ("surface", "paving_stones"),
    ("path condition", "rather bumpy"): ("smoothness", "bad"),
    ("smoothness", "even"): ("smoothness", "good"),
    ("toilets", "grab rail absent"): ("toilets:grab_bar", "false"),
    ("Restroom", "Accessible: yes"): ("toilets:wheelchair", "true"),
    ("zebra", "present"): ("crosswalk", "true"),
    ("way", "3 steps"): ("step_free_access", "false"),
    ("wheelchair", "limited"): ("wheelchair", "limited"),
    ("Opening hours", "9-17"): ("opening_hours", "9_17"),
    ("", ""): ("unknown", "verify"),
    (None, None): ("unknown", "verify"),
    ("Größe", "  Ä é "): ("größe", "ä_é"),
}


def test_suggestions_in_canonical_words(spark):
    levels = [0.5, 2.0, -1.0, float("nan"), float("inf"), None, 0.1235, 0.1225]
    rows = [(k, a, v, levels[k % 8], " seen " if k % 2 else None, "x") for k, (a, v) in enumerate(SUGGESTIONS)]
    df = spark.createDataFrame(rows, "id long, attribute string, value string, confidence double, evidence string, own string")
    out = sorted(assist.normalized_candidates(df, "none given").collect())
    assert {(rows[r.id][1], rows[r.id][2]): (r.attribute, r.value) for r in out} == SUGGESTIONS
    assert [r.confidence for r in out[:8]] == [0.5, 0.95, 0.0, 0.0, 0.0, 0.0, 0.124, 0.122]
    assert [r.evidence for r in out[:2]] == ["none given", "seen"] and {r.own for r in out} == {"x"}
    assert assist.normalized_candidates(df.where("false"), "").count() == 0


def test_gaps_and_checklist(spark):
    rows = [(1, ["KERB", "surface"], 0, 0.5), (2, [], 1, 0.9), (3, None, None, 0.6), (4, [n for g in assist.GAPS for n in g[3]], 0, 0.1)]
    df = spark.createDataFrame(rows, "id long, missing array<string>, photos int, confidence double")
    found = df.withColumn("c", assist.gap_candidates(F.col("missing"), F.col("photos"))).withColumn("l", assist.checklist(F.col("c"), F.col("confidence")))
    out = {r.id: ([x.attribute for x in r.c], r.l) for r in found.collect()}
    assert out[1][0] == ["curb_ramp", "surface", "photos"] and out[1][1][-1] == assist.LOW_CONFIDENCE and out[1][1][0] == assist.CHECKS["curb_ramp"]
    assert out[2] == ([], []) and out[3][0] == ["photos"] and len(out[3][1]) == 1
    assert len(out[4][0]) == 9 and len(out[4][1]) == 9  # eight of nine, and the warning
    assert out[4][1][5] == "Verify last_verified_at with direct field evidence."
    few = df.where("id = 4").select(assist.gap_candidates(F.col("missing"), F.col("photos"), 0.75).alias("c")).first().c
    assert [x.attribute for x in few] == ["curb_ramp", "width_metres", "toilets:wheelchair", "photos"]


def test_explanation(spark):
    df = spark.createDataFrame([(432.4, 61.0, 0.7, "stroller", ["b", " A", "a", None], ["w1", "w2", "w3"], 0.756), (10.0, 1.0, 0.3, "Standard", [], [], 1.0)], "d double, s double, w double, p string, x array<string>, warn array<string>, score double")
    a, b = (r[0] for r in df.select(assist.explain_route(*[F.col(c) for c in df.columns], most_warnings=2)).collect())
    assert a == (
        f"The deterministic router selected a 432 metre route estimated at 61 seconds. {assist.WEIGHT_HIGH} The stroller profile applies reproducible accessibility constraints before scoring candidate edges. "
        "Requested preferences considered by the router: A, b. Remaining route warnings: w1; w2. The resulting safety score is 0.76 on the service scale."
    )
    assert b == f"The deterministic router selected a 10 metre route estimated at 1 seconds. {assist.WEIGHT_LOW} The resulting safety score is 1.00 on the service scale."


def _metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    x = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371000 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_prompts_follow_the_walk(spark):
    rng = random.Random(5)
    steps = [(t, s, 50 + rng.random() * 0.003, 8 + rng.random() * 0.003, " " if rng.random() < 0.2 else f"say {t}.{s}") for t in range(6) for s in range(8) if (t, s) != (5, 0)]
    walks = [(t, k, 50 + rng.random() * 0.003, 8 + rng.random() * 0.003) for t in range(7) for k in range(60)]
    want = set()
    for t in range(5):
        last = -1
        for _, k, lat, lon in (w for w in walks if w[0] == t):
            if last < 0:
                hit = 0
            else:
                hit = next((s for tt, s, a, b, text in steps if tt == t and s > last and text.strip() and _metres((lat, lon), (a, b)) <= 48), None)
            if hit is not None:
                last = hit
                want.add((t, k, hit))
    rng.shuffle(walks)
    out = assist.nav_prompts(spark.createDataFrame(walks, "trip long, seq long, lat double, lon double").repartition(5), spark.createDataFrame(steps, "trip long, step long, lat double, lon double, instruction string"))
    assert {(r.trip, r.seq, r.step) for r in out.collect()} == want and len(want) > 12


def test_waypoints_lie_beyond_the_route(spark):
    route = [(1, k, 50.0, 8.0 + k * 0.001) for k in range(5)] + [(2, 0, 50.0, 9.0)]
    points = [(1, 50.0002, 8.0021), (2, 49.9998, 8.0), (3, 50.0, 8.0035), (4, 50.01, 8.002), (5, 50.0, 9.0001)]
    out = assist.avoidance_waypoints(spark.createDataFrame(route, "route long, i long, lat double, lon double"), spark.createDataFrame(points, "hazard_id long, lat double, lon double"))
    got = {(r.route, r.hazard_id): (r.lat, r.lon) for r in out.collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3)}  # 4 is too far, 5 lies by a route of one vertex
    off = 100 / 111320
    assert got[1, 1] == pytest.approx((50 - off, 8.002)) and got[1, 2] == pytest.approx((50 + off, 8.0)) and abs(got[1, 3][0] - 50) == pytest.approx(off)


def test_cities_and_identifiers(spark):
    rows = [("a/SEA_1.jpg", None), ("b/New-York_2.jpg", "x"), ("_3.jpg", "NYC"), (None, " San José "), (None, None), ("plain.jpg", ""), ("dir/x_y/", "")]
    df = spark.createDataFrame(rows, "path string, city string")
    got = [tuple(r) for r in df.select(assist.city_of_split(F.col("path"), F.col("city")), assist.city_of_slice(F.col("path"), F.col("city"))).collect()]
    assert got == [("seattle", "sea"), ("new_york", "x"), ("new_york", "nyc"), ("san josé", "san-jos"), ("unknown", "unknown"), ("plain.jpg", "unknown"), ("x", "unknown")]
    keys = spark.createDataFrame([(1,), (2**40 + 5,), (-1,)], "id long").select(assist.guid_of(F.col("id"))).collect()
    assert [r[0] for r in keys] == ["00000001-0000-0000-0000-000000000000", "00000005-0100-0000-0000-000000000000", "ffffffff-ffff-ffff-0000-000000000000"]


def test_best_candidate_of_each_attribute(spark):
    rows = [("k", 1, "surface", "mud", 0.5), ("k", 2, "Surface", "sand", 0.5), ("k", 3, "surface", "old", 0.4), ("k", 4, "width", "x", 0.34), ("k", 5, "a", "y", 0.5), ("j", 6, "b", "z", 0.35)]
    df = spark.createDataFrame(rows, "key string, id long, attribute string, value string, confidence double")
    out = {(r.key, r.attribute, r.value, r["rank"]) for r in assist.best_candidates(df, ["key"]).collect()}
    assert out == {("k", "a", "y", 1), ("k", "surface", "mud", 2), ("j", "b", "z", 1)}
    assert assist.best_candidates(df, ["key"], most=1).count() == 2


def test_status_of_an_empty_graph(spark):
    runs = spark.createDataFrame([(1, "completed", "2024-01-01", "2024-01-02"), (2, "running", "2024-01-03", None)], "id long, status string, a string, b string")
    runs = runs.select("id", "status", F.to_timestamp("a").alias("started_at"), F.to_timestamp("b").alias("finished_at"))
    none, some = spark.range(0), spark.range(3)
    a = reports.graph_status(some, none, runs).first()
    assert (a.has_coverage, a.version, a.run_status) == (False, "osm:empty:2", "running") and "after the latest OSM import" in a.warning
    b = reports.graph_status(none, none, runs.where("false")).first()
    assert (b.version, b.run_id) == ("osm:empty:0", None) and "no completed OSM import" in b.warning
    c = reports.graph_status(some, some, runs.where("id = 1")).first()
    assert (c.version, c.warning) == ("osm:1:n3:e3", None)


def test_class_weights_with_weak_negatives(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.0), ("b", 1.0), ("c", 0.2)], "task string, target double")
    out = {r.task: (r.total, r.positives, r.pos_weight, round(r.loss_weight, 6)) for r in evaluation.class_weights(df).collect()}
    assert out == {"a": (4, 2, 1.0, round(11 / 12, 6)), "b": (3, 1, 2.0, round(11 / 9, 6)), "c": (4, 0, 4.0, round(11 / 12, 6))}
