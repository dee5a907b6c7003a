"""Hand-made cases: formulas, cells, paths, streams, the map extract."""

from __future__ import annotations

from pathlib import Path

import json
import os

import pytest
from pyspark.sql import functions as F

from stepfree.functions import cost, geo, risk
from stepfree.functions import sqltext as sql
from stepfree.operators import filters, graph, profiles
from stepfree.sources import osm
from stepfree.spatial import within_distance
from stepfree.streaming import jobs
from stepfree.views import with_views

DATA = os.environ.get("STEPFREE_TEST_DATA", "/root/testdata/sf0.001")


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_haversine(spark):
    lit = F.lit
    assert one(spark, geo.haversine(lit(52.0), lit(-1.9), lit(52.0), lit(-1.9))) == 0
    assert one(spark, geo.haversine(lit(0.0), lit(0.0), lit(0.0), lit(180.0))) == pytest.approx(20015086.8, rel=1e-6)


def test_severity_tokens(spark):
    for text, value in (("blocked-pavement", 0.75), ("missing curb ramp", 0.9), ("stairs/no ramp", 0.92), ("gravel", 0.65), ("?", 0.5), (None, 0.5)):
        assert one(spark, risk.severity(F.lit(text).cast("string"))) == value


def test_bbox_bounds():
    with pytest.raises(ValueError):
        filters.in_bbox(F.lit(0), F.lit(0), 53, -2, 52, -1)


def test_cells_equal_brute_force(spark):
    left = spark.createDataFrame([(i, 52.45 + i % 13 * 0.001, -1.95 + i * 7 % 17 * 0.001) for i in range(60)], "id long, lat double, lon double")
    right = spark.createDataFrame([(i, 52.45 + i % 11 * 0.0011, -1.95 + i * 5 % 19 * 0.0009) for i in range(60)], "r_id long, r_lat double, r_lon double")
    fast = {(r.id, r.r_id) for r in within_distance(left, right, 250.0).collect()}
    d = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    slow = {(r.id, r.r_id) for r in left.crossJoin(right).where(d <= 250).collect()}
    assert fast == slow and fast


def test_penalty_is_clamped(spark):
    args = [F.lit(v) for v in (5000.0, "gravel", "bad", True, True, 0.2, 0.5, True, "access=no")]
    assert one(spark, cost.penalty("manual-wheelchair", *args)) == 2400


def test_map_extract(spark):
    nodes, ways = osm.scan(spark, str(Path(__file__).parent / "data" / "mini.osm"))
    rows = {(r.src, r.dst): r for r in osm.edges(nodes, ways).collect()}
    assert set(rows) == {(11, 12), (12, 11), (12, 13), (13, 12), (12, 14)}  # the dangling node is left out, way 22 is one-way
    assert rows[11, 12].wheelchair_penalty_s == 0 and rows[11, 12].data_quality > 0.9
    assert rows[12, 14].has_crossing and rows[12, 14].wheelchair_penalty_s > 0 and rows[12, 14].data_quality < 0.5
    assert {r.asset_type for r in osm.assets(nodes).collect()} == {"highway:crossing", "amenity:toilets", "highway:elevator"}
    with pytest.raises(FileNotFoundError):
        osm.existing(spark, "/nowhere/a.osm;/nowhere/b.osm")


def test_relaxation_without_limit(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (1, 3, 10.0), (3, 2, 10.0), (2, 4, 10.0), (3, 4, 100.0)], "src long, dst long, cost double")
    start = spark.createDataFrame([(1, 1)], "source long, node long")
    assert {r.node: r.cost for r in graph.relaxed(edges, start).collect()} == {1: 0, 3: 10, 2: 20, 4: 30}


def test_stream_dedupe(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [{"message_id": i % 3, "topic": "t", "key": "k", "attempt": 0, "event_type": "view", "ts": "2024-01-01T00:00:0%d" % i, "payload": "{}"} for i in range(6)]
    (source / "a.json").write_text("\n".join(map(json.dumps, rows)))
    out = jobs.deduplicated(jobs.envelopes(spark, str(source)))
    run = out.writeStream.format("memory").queryName("deduped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination()
    assert spark.table("deduped").count() == 3


def test_routes(spark):
    rows = [("view", 0, "{}"), ("error", 0, "{}"), ("error", 3, "{}"), ("view", 0, "no json"), ("view", 0, None)]
    df = spark.createDataFrame(rows, "event_type string, attempt int, payload string")
    assert [r.route for r in jobs.routed(df).collect()] == ["ok", "retry", "dead", "dead", "dead"]


def test_alerts_and_headings_of_all_rows(spark, same):
    """Against all pairs: every request, every active hazard, every hazard."""
    d = sql.haversine("n.lat", "n.lon", "h.lat", "h.lon")
    active = "h.status in ('reported', 'under_review')"
    alerts = f"select r.id as route_id, h.id as hazard_id, round({d}, 3) as distance_m from request r join node n on n.id = r.start_node join hazard h on {active} where {d} <= 200"
    assert same(profiles.stream_alerts(spark, DATA), with_views(alerts)) > 0
    nearest = f"""with near as (select h.id, n.id as node_id from hazard h cross join node n where {d} <= 150 qualify row_number() over (partition by h.id order by {d}, n.id) = 1)
select near.id, near.node_id from near join node m on m.id = near.node_id + 1"""
    assert same(profiles.geo_heading(spark, DATA).select("id", "node_id"), with_views(nearest)) > 0


def test_every_request_gets_its_path(spark, duck):
    """All requests, between their own nodes, at the cost that repeated relaxation of all edges finds."""
    nodes, edges = graph.graph(spark, DATA)
    seconds = cost.traversal("standard", F.col("dist"), graph.edge_penalty("standard"))
    arcs = [tuple(r) for r in edges.select("src", "dst", seconds).collect()]
    known = {r.id for r in nodes.select("id").collect()}
    asked = {r[0]: r[1:] for r in duck.execute(with_views("select id, start_node, end_node from request")).fetchall()}
    least = {}
    for start in {s for s, _ in asked.values()} & known:
        best = {start: 0.0}
        while True:
            new = dict(best)
            for s, d, c in arcs:
                if s in new and new[s] + c < new.get(d, float("inf")):
                    new[d] = new[s] + c
            if new == best:
                break
            best = new
        least[start] = best
    out = {r.id: r for r in graph.graph_astar(spark, DATA).collect()}
    assert set(out) == set(asked)
    for i, (s, d) in asked.items():
        want = least.get(s, {}).get(d, float("inf")) if d in known else float("inf")
        assert out[i].cost == pytest.approx(want, abs=1e-3), (i, s, d)
        assert (out[i].path[0], out[i].path[-1]) == (s, d) if out[i].hops >= 0 else out[i].path == []


def test_path_outside_the_box(spark):
    """A cheap path far around, and one that exists only there; no edges at all for the third pair."""
    place = {1: (52.0, -1.0), 2: (52.0, -0.998), 3: (52.2, -1.0), 4: (52.2, -0.998), 5: (52.0, -0.99), 6: (52.4, -1.0)}
    nodes = spark.createDataFrame([(k, *v) for k, v in place.items()], "id long, lat double, lon double")
    hops = [(1, 2, 90_000.0), (1, 3, 20_000.0), (3, 4, 100.0), (4, 2, 20_000.0), (4, 5, 20_000.0)]
    arcs = spark.createDataFrame([(s, d, c, *place[s], *place[d]) for s, d, c in hops], "src long, dst long, seconds double, lat double, lon double, blat double, blon double")
    pairs = spark.createDataFrame([(1, 2), (1, 5), (6, 1), (6, 6), (1, 99)], "start_node long, end_node long")
    out = {(r.start_node, r.end_node): (r.cost, r.path) for r in graph.least_paths(nodes, arcs, pairs).collect()}
    inf = float("inf")
    assert out == {(1, 2): (40_100.0, [1, 3, 4, 2]), (1, 5): (40_100.0, [1, 3, 4, 5]), (6, 1): (inf, []), (6, 6): (0.0, [6]), (1, 99): (inf, [])}
