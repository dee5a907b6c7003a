"""What a score and a route tell beside their numbers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from stepfree.functions.risk import SEVERITY
from stepfree.operators import graph, risk

DATA = "/root/testdata/sf0.001"


def metres(a: tuple[float, float], b: tuple[float, float]) -> float:
    y, x = math.radians(b[0] - a[0]) / 2, math.radians(b[1] - a[1]) / 2
    h = math.sin(y) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def test_heaviest_hazards_of_a_point(spark):
    """Twenty of many at crowded places, by weight and id, against all hazards one by one; the score returns them."""
    kinds = ["stairs_no_ramp", "steps", "gravel", "pothole", "no such thing"]
    spots = [(52.48 + 0.0007 * (k % 5), -1.9 + 0.0009 * (k // 5)) for k in range(12)]
    reports = [(i, *spots[i * 7 % 12], kinds[i * 11 % 5]) for i in range(700)] + [(9000 + i, 52.48, -1.9, "pothole") for i in range(30)]
    points = [(1, 52.48, -1.9), (2, 52.4812, -1.8985), (3, 52.4841, -1.8999), (4, 52.6, -1.9)]
    active = spark.createDataFrame(reports, "r_id long, r_lat double, r_lon double, hazard_type string")
    got = {r.id: r.nearby for r in risk.heaviest_hazards(spark.createDataFrame(points, "id long, lat double, lon double"), active, 300.0).collect()}
    assert set(got) == {1, 2, 3}
    for i, *at in points[:3]:
        near = [(round(SEVERITY.get(kind, 0.5) * math.exp(-d / 150), 4), h, kind, d) for h, y, x, kind in reports if (d := metres(tuple(at), (y, x))) <= 300]
        best = sorted(near, key=lambda n: (-n[0], n[1]))[:20]
        assert got[i] == ";".join(f"{h}:{kind}:{round(d, 1):.1f}:{w:.4f}" for w, h, kind, d in best)
    score = risk.agg_risk_score(spark, DATA)
    told = F.when(F.col("nearby") == "", 0).otherwise(F.size(F.split("nearby", ";")))
    assert score.where(told != F.least("hazards", F.lit(20))).isEmpty() and not score.where("hazards > 0").isEmpty()


def test_a_route_tells_safety_warnings_and_steps(spark):
    """Every request, by hand: one hazard near the first hop's middle, tags of both hops, notes by profile, a request without a way and one without a step."""
    nodes = spark.createDataFrame([(1, 52.48, -1.9), (2, 52.4805, -1.9), (3, 52.4805, -1.8992)], "id long, lat double, lon double")
    columns = "id long, src long, dst long, dist double, surface string, smoothness string, width_m double, kerb_height double, has_stairs boolean, has_barrier boolean, is_steep boolean, is_under_construction boolean, lighting double, access string"
    edges = spark.createDataFrame(
        [
            (1, 1, 2, 60.0, "gravel", "good", 0.7, 0.05, True, False, True, False, 0.1, "wheelchair=no"),
            (2, 1, 2, 90.0, "sand", None, None, 0.0, False, True, False, True, 0.9, None),
            (3, 2, 3, 140.0, "unknown", " ", None, 0.0, False, True, False, True, 0.5, None),
        ],
        columns,
    )
    paths = spark.createDataFrame([(1, 3, 2.0, 2, [1, 2, 3]), (3, 1, math.inf, -1, []), (2, 2, 0.0, 0, [2])], "start_node long, end_node long, cost double, hops int, path array<long>")
    asked = spark.createDataFrame([(7, 1, 3, "manual-wheelchair"), (8, 1, 3, "standard"), (9, 3, 1, "stroller"), (10, 2, 2, "stroller")], "id long, start_node long, end_node long, profile string")
    near = 100 / 6_371_000
    hazards = spark.createDataFrame([(k, 52.48025 + math.degrees(near), -1.9, "stairs_no_ramp") for k in range(3)], "r_id long, r_lat double, r_lon double, hazard_type string")
    got = {r.id: r for r in graph.told_routes(asked, paths, nodes, edges, hazards).collect()}
    assert set(got) == {7, 8, 9, 10}
    score = lambda d: 1 / (1 + math.exp(-3 * (3 * 0.92 * math.exp(-d / 150) - 1)))
    y, x = math.radians(0.0005 / 2) - near, math.radians(0.0004) * math.cos(math.radians(52.4805))
    first, second = score(100.0), score(6_371_000 * math.hypot(y, x))
    for i in (7, 8):
        assert (got[i].metres, got[i].steps, got[i].minutes) == (200.0, 2, round(200 / 1.3 / 60, 1))
        assert got[i].safety == round(((1 - first) * 60 + (1 - second) * 140) / 200, 3)
        assert [tuple(s) for s in got[i].told] == [
            (1, 2, 60.0, round(1 - first, 3), "Head north for 60m."),
            (2, 3, 140.0, round(1 - second, 3), "Continue east for 0.14km to reach your destination."),
        ]
    own = [f"Step 1: Elevated risk area (score {first:.2f})."] if first > 0.7 else []
    more = [f"Step 2: Elevated risk area (score {second:.2f})."] if second > 0.7 else []
    tags = "Accessibility data confidence is lower: {} tag(s) on the selected route rely on inferred defaults."
    kerb, ground, dark = "Step 1: Raised kerb (5cm) — may affect wheelchair access.", "Step 1: Surface is gravel — may be difficult for wheeled mobility.", "Step 1: Poor street lighting detected."
    rest = [kerb, ground, dark, "Step 1: Steep gradient ahead.", "Step 1: Narrow path (0.7m) — limited wheelchair access.", *own, "Step 2: Physical barrier detected on this path.", "Step 2: Active construction zone — proceed with caution.", *more]
    assert own and got[7].warnings == ["Step 1: This segment contains stairs — stairs are not wheelchair accessible.", "Step 1: OSM marks this segment as not wheelchair accessible.", *rest, tags.format("1 missing surface, 1 missing width, 1 missing smoothness")]
    assert got[8].warnings == ["Step 1: This segment contains stairs — stairs present.", *rest, tags.format("1 missing surface")]
    assert (got[9].steps, got[9].metres, got[9].safety, got[9].warnings, got[9].told) == (-1, None, None, [], [])
    assert (got[10].steps, got[10].metres, got[10].safety, got[10].warnings, got[10].told) == (0, 0.0, 1.0, [], [])


def test_every_request_is_told(spark):
    told = graph.agg_route_summary(spark, DATA)
    assert told.count() == spark.table("request").count() and told.where("size(told) != greatest(steps, 0)").isEmpty()
