"""Route graphs: shards, slices, snapping, relaxation, point-to-point search, meshes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.functions import cost, geo
from stepfree.functions import sqltext as sql
from stepfree.operators.risk import active_hazards, edge_penalty, quick_risk
from stepfree.registry import query
from stepfree.shared import discard, stored
from stepfree.spatial import nearest
from stepfree.views import register, with_views

SHARD = 0.01


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    register(spark, sf_dir, "node", "edge")
    return spark.table("node"), spark.table("edge")


def with_midpoints(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with mid_lat and mid_lon."""
    a = nodes.select(F.col("id").alias("src"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    b = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    both = edges.join(a, "src").join(b, "dst")
    return both.withColumn("mid_lat", (F.col("alat") + F.col("blat")) / 2).withColumn("mid_lon", (F.col("alon") + F.col("blon")) / 2)


def sharded(nodes: DataFrame, edges: DataFrame, size: float = SHARD) -> DataFrame:
    """Edges with the cell of their midpoint, the partition columns of stored graphs."""
    mid = with_midpoints(nodes, edges)
    return mid.withColumn("shard_y", geo.cell(F.col("mid_lat"), size)).withColumn("shard_x", geo.cell(F.col("mid_lon"), size))


_MID = "mid as (select e.*, (a.lat + b.lat) / 2 as mid_lat, (a.lon + b.lon) / 2 as mid_lon from edge e join node a on a.id = e.src join node b on b.id = e.dst)"


@query("graph_shard", with_views(f"with {_MID} select id, floor(mid_lat / 0.01e0)::bigint as shard_y, floor(mid_lon / 0.01e0)::bigint as shard_x from mid"))
def graph_shard(spark, sf_dir):
    return sharded(*graph(spark, sf_dir)).select("id", "shard_y", "shard_x")


@query("graph_slice", with_views(f"with {_MID} select id from mid where floor(mid_lat / 0.01e0) between 5248 and 5249 and floor(mid_lon / 0.01e0) between -190 and -189 order by id limit 1000"))
def graph_slice(spark, sf_dir):
    """The edges of the shards that overlap a region, up to a cap in id order (the cap is the feature)."""
    s = sharded(*graph(spark, sf_dir))
    return s.where(F.col("shard_y").between(5248, 5249) & F.col("shard_x").between(-190, -189)).select("id").orderBy("id").limit(1000)


@query("graph_region", with_views(f"with {_MID} select id, round({sql.haversine('mid_lat', 'mid_lon', '52.485e0', '-1.885e0')}, 3) as m from mid where mid_lat between 52.48e0 and 52.49e0 and mid_lon between -1.89e0 and -1.88e0"))
def graph_region(spark, sf_dir):
    mid = with_midpoints(*graph(spark, sf_dir)).where(F.col("mid_lat").between(52.48, 52.49) & F.col("mid_lon").between(-1.89, -1.88))
    return mid.select("id", F.round(geo.haversine(F.col("mid_lat"), F.col("mid_lon"), F.lit(52.485), F.lit(-1.885)), 3).alias("m"))


@query("graph_snap", with_views(f"""with c as (select h.id, n.id as node_id, {sql.haversine('h.lat', 'h.lon', 'n.lat', 'n.lon')} as d from hazard h join node n on abs(h.lat - n.lat) < 0.002e0 and abs(h.lon - n.lon) < 0.004e0)
select id, node_id, round(d, 4) as distance_m from c where d <= 150 qualify row_number() over (partition by id order by d, node_id) = 1"""))
def graph_snap(spark, sf_dir):
    register(spark, sf_dir, "node", "hazard")
    right = spark.table("node").select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    near = nearest(spark.table("hazard").select("id", "lat", "lon"), right, "id", 150.0)
    return near.select("id", F.col("r_id").alias("node_id"), F.round("distance_m", 4).alias("distance_m"))


def relaxed(edges: DataFrame, sources: DataFrame, hops: int | None = None) -> DataFrame:
    """Least cost from each source (source, node): joins of the frontier with its edges until nothing improves.

    Only nodes that improved go on, and every round is written, so that the next one reads its
    result instead of working it out again. Rounds are as many as hops: for distances over whole graphs
    ``hierarchy`` needs far fewer.
    """
    arcs = stored(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("cost").alias("arc")), "arcs")
    best = stored(sources.select("source", "node", F.lit(0.0).alias("cost"), F.lit(True).alias("better")), "relax")
    k = 0
    while hops is None or k < hops:
        k += 1
        step = best.where("better").join(arcs, "node").groupBy("source", F.col("next").alias("node")).agg(F.min(F.col("cost") + F.col("arc")).alias("new"))
        merged = best.join(step, ["source", "node"], "full_outer").select(
            "source", "node", F.least("cost", "new").alias("cost"), (F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))).alias("better")
        )
        before, best = best, stored(merged, "relax")
        discard(before)
        if best.where("better").isEmpty():
            break
    return best.select("source", "node", "cost")


@query("join_graph_traverse", with_views("""with recursive reach(node, hop) as (select 0::bigint, 0 union all select e.dst, r.hop + 1 from reach r join edge e on e.src = r.node and e.src < e.dst where r.hop < 5)
select node, min(hop)::bigint as hops from reach group by node"""))
def join_graph_traverse(spark, sf_dir):
    _, edges = graph(spark, sf_dir)
    forward = edges.where("src < dst").select("src", "dst", F.lit(1.0).alias("cost"))
    start = spark.range(1).select(F.lit(0).cast("long").alias("source"), F.lit(0).cast("long").alias("node"))
    return relaxed(forward, start, hops=5).select("node", F.col("cost").cast("long").alias("hops"))


#: No edge is passed faster (metres a second); degrees added around both ends in each round, then the whole graph.
FASTEST = 2.0
PADS = (0.004, 0.016, 0.064)
FOUND = "start_node long, end_node long, cost double, hops int, path array<long>"


def astar(pdf: pd.DataFrame) -> pd.DataFrame:
    """Least-cost paths of a group over its slice: best-first search from each start, with the straight-line time to the rectangle of the ends as lower bound.

    Rows are edges (src, dst, seconds, lat, lon, blat, blon) and, with a null src, the pairs (start_node, end_node).
    """
    pairs, edges = pdf[pdf["src"].isna()], pdf[pdf["src"].notna()]
    ids = np.r_[edges["src"].to_numpy(np.int64), edges["dst"].to_numpy(np.int64)]
    names, first, at = np.unique(ids, return_index=True, return_inverse=True)
    lat = np.r_[edges["lat"].to_numpy(), edges["blat"].to_numpy()][first]
    lon = np.r_[edges["lon"].to_numpy(), edges["blon"].to_numpy()][first]
    place = {n: i for i, n in enumerate(names.tolist())}
    arcs: list[list[tuple[int, float]]] = [[] for _ in place]
    for s, d, c in zip(at[: len(edges)].tolist(), at[len(edges) :].tolist(), edges["seconds"].tolist(), strict=True):
        arcs[s].append((d, c))
    wanted: dict[int, set[int]] = {}
    for s, d in zip(pairs["start_node"].astype("int64").tolist(), pairs["end_node"].astype("int64").tolist(), strict=True):
        wanted.setdefault(s, set()).add(d)
    ends = [place[d] for goals in wanted.values() for d in goals if d in place]
    bound = np.zeros(len(names))
    if ends:
        north = np.maximum(0, np.maximum(lat[ends].min() - lat, lat - lat[ends].max()))
        east = np.maximum(0, np.maximum(lon[ends].min() - lon, lon - lon[ends].max()))
        shrink = np.cos(np.radians(np.abs(lat).max()))
        bound = geo.EARTH_M * np.hypot(np.radians(north), np.radians(east) * shrink) / FASTEST
    lower = bound.tolist()
    out = []
    for start, goals in wanted.items():
        left = {place[g] for g in goals if g in place} if start in place else set()
        best, back, done = {}, {}, set()
        queue = []
        if left:
            best[place[start]] = 0.0
            queue.append((lower[place[start]], place[start]))
        while queue and left:
            _, n = heapq.heappop(queue)
            if n in done:
                continue
            done.add(n)
            left.discard(n)
            here = best[n]
            for d, c in arcs[n]:
                if here + c < best.get(d, np.inf):
                    best[d], back[d] = here + c, n
                    heapq.heappush(queue, (here + c + lower[d], d))
        for g in goals:
            n = place.get(g)
            if n in done:
                path = [n]
                while path[-1] in back:
                    path.append(back[path[-1]])
                out.append((start, g, best[n], len(path) - 1, names[path[::-1]].tolist()))
            else:
                out.append((start, g, 0.0 if start == g else np.inf, 0 if start == g else -1, [g] if start == g else []))
    return pd.DataFrame(out, columns=["start_node", "end_node", "cost", "hops", "path"])


def with_all(pairs: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of ``pairs`` with their paths; those without one get infinite cost, -1 and an empty path."""
    found = pairs.join(paths, ["start_node", "end_node"], "left")
    return found.withColumns({"cost": F.coalesce("cost", F.lit(float("inf"))), "hops": F.coalesce("hops", F.lit(-1)), "path": F.coalesce("path", F.array().cast("array<long>"))})


def least_paths(nodes: DataFrame, arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """start_node, end_node, cost, hops, path of each pair; no path: infinite cost, -1 and an empty path.

    ``arcs``: src, dst, seconds, lat, lon, blat, blon; ``pairs``: start_node, end_node. Pairs are grouped by the cells
    of both ends and searched in the slice of the graph around these cells. A result is final when no path that
    leaves the slice can cost less; the other pairs are searched again in wider slices, at last in the whole graph.
    """
    arcs = stored(arcs, "arcs")
    ends = nodes.select("id", "lat", "lon")
    asked = pairs.distinct().join(ends.toDF("start_node", "slat", "slon"), "start_node").join(ends.toDF("end_node", "elat", "elon"), "end_node")
    span = nodes.agg(F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    if span[0] is None:
        return with_all(pairs.distinct(), pairs.sparkSession.createDataFrame([], FOUND))
    cells = [geo.cell(F.col(c), SHARD).alias(k) for c, k in (("slat", "sy"), ("slon", "sx"), ("elat", "ey"), ("elon", "ex"))]
    open_ = stored(asked.select("*", *cells), "asked")
    group = ["sy", "sx", "ey", "ex"]
    edge_columns = ["src", "dst", "seconds", "lat", "lon", "blat", "blon"]
    out = None
    for pad in (*PADS, None):
        boxes = open_.select(*group).distinct()
        if pad is None:
            slices = boxes.crossJoin(F.broadcast(arcs) if arcs.count() <= 100_000 else arcs)
        else:
            lo = lambda a, b: F.floor((F.least(a, b) * SHARD - pad) / SHARD).cast("long")
            hi = lambda a, b: F.floor(((F.greatest(a, b) + 1) * SHARD + pad) / SHARD).cast("long")
            spread = boxes.withColumn("cy", F.explode(F.sequence(lo("sy", "ey"), hi("sy", "ey")))).withColumn("cx", F.explode(F.sequence(lo("sx", "ex"), hi("sx", "ex"))))
            placed = arcs.withColumn("cy", geo.cell(F.col("lat"), SHARD)).withColumn("cx", geo.cell(F.col("lon"), SHARD))
            slices = spread.join(placed, ["cy", "cx"])
        rows = slices.select(*group, F.lit(None).cast("long").alias("start_node"), F.lit(None).cast("long").alias("end_node"), *edge_columns)
        none = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in edge_columns]
        rows = rows.unionByName(open_.select(*group, "start_node", "end_node", *none))
        found = open_.join(rows.groupBy(*group).applyInPandas(astar, FOUND), ["start_node", "end_node"])
        if pad is not None:
            # seconds from both ends to the sides of the slice beyond which the graph goes on
            far, side = F.lit(float("inf")), []
            low, high = lo("sy", "ey") * SHARD, (hi("sy", "ey") + 1) * SHARD
            west, east = lo("sx", "ex") * SHARD, (hi("sx", "ex") + 1) * SHARD
            metre = np.radians(1) * geo.EARTH_M
            shrink = F.cos(F.radians(F.lit(max(abs(span[0]), abs(span[1])))))
            for y, x in (("slat", "slon"), ("elat", "elon")):
                south_north = F.least(F.when(low > span[0], F.col(y) - low).otherwise(far), F.when(high <= span[1], high - F.col(y)).otherwise(far))
                west_east = F.least(F.when(west > span[2], F.col(x) - west).otherwise(far), F.when(east <= span[3], east - F.col(x)).otherwise(far))
                side.append(F.least(south_north * metre, west_east * metre * shrink) / FASTEST)
            found = found.withColumn("__final", (F.col("cost") <= side[0] + side[1]) | (side[0] == far))
        else:
            found = found.withColumn("__final", F.lit(True))
        found = stored(found, "paths")
        part = found.where("__final").select("start_node", "end_node", "cost", "hops", "path")
        out = part if out is None else out.unionByName(part)
        open_ = found.where("not __final").select("start_node", "end_node", "slat", "slon", "elat", "elon", *group)
        if open_.isEmpty():
            break
    return with_all(pairs.distinct(), out)


def pairs_searched(spark: SparkSession, sf_dir: str, profile: str) -> tuple[DataFrame, DataFrame]:
    """The requests (id, start_node, end_node, profile) and the least-cost path of each distinct pair of nodes that they ask for."""
    nodes, edges = graph(spark, sf_dir)
    register(spark, sf_dir, "request")
    seconds = cost.traversal(profile, F.col("dist"), edge_penalty(profile))
    arcs = with_midpoints(nodes, edges.withColumn("seconds", seconds)).select("src", "dst", "seconds", F.col("alat").alias("lat"), F.col("alon").alias("lon"), "blat", "blon")
    asked = spark.table("request").select("id", "start_node", "end_node", "profile")
    return asked, least_paths(nodes, arcs, asked.select("start_node", "end_node"))


def searched(spark: SparkSession, sf_dir: str, profile: str) -> DataFrame:
    """Least-cost paths of all requests between their nodes: weights by Catalyst, requests for the same nodes searched once."""
    return with_all(*pairs_searched(spark, sf_dir, profile)).select("id", "cost", "hops", "path")


def numbered_hops(paths: DataFrame) -> DataFrame:
    """start_node, end_node, i (from 0), src, dst: the hops of the path of each pair, made within its row."""
    hop = lambda i: F.struct(i.alias("i"), F.get("path", i).alias("src"), F.get("path", i + 1).alias("dst"))
    return paths.where("hops > 0").select("start_node", "end_node", F.inline(F.transform(F.sequence(F.lit(0), F.col("hops") - 1), hop)))


def path_hops(paths: DataFrame) -> DataFrame:
    """start_node, end_node, src, dst of the hops of each pair."""
    return numbered_hops(paths).drop("i")


@query("graph_astar")
def graph_astar(spark, sf_dir):
    return searched(spark, sf_dir, "standard").select("id", F.round("cost", 3).alias("cost"), "hops", "path")


@query("graph_path_check")
def graph_path_check(spark, sf_dir):
    """Hops of found paths that no edge carries: none may be left."""
    _, edges = graph(spark, sf_dir)
    asked, paths = pairs_searched(spark, sf_dir, "standard")
    broken = path_hops(paths).join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("start_node", "end_node").agg(F.count("*").alias("n"))
    return asked.join(broken, ["start_node", "end_node"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("broken_hops"))


def route_sums(paths: DataFrame, edges: DataFrame, *more: Column) -> DataFrame:
    """start_node, end_node, metres, lighting, steps of each pair with hops, and further aggregates of its hops (i, and ``way`` if ``edges`` have it, that of the shortest of parallel edges)."""
    ways = [F.min_by("way", F.struct("dist", "id")).alias("way")] if "way" in edges.columns else []
    least = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"), F.max("lighting").alias("lighting"), *ways)
    return numbered_hops(paths).join(least.hint("merge") if ways else least, ["src", "dst"]).groupBy("start_node", "end_node").agg(
        F.round(F.sum("dist"), 3).alias("metres"), F.round(F.sum(F.col("dist") * F.col("lighting")) / F.sum("dist"), 6).alias("lighting"), F.count("*").alias("steps"), *more
    )


def route_summaries(asked: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """id, metres, lighting, steps: hops are summed once for each pair of nodes, whatever number of requests asks for it."""
    return asked.join(route_sums(paths, edges), ["start_node", "end_node"]).select("id", "metres", "lighting", "steps")


def told_edges(nodes: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """id, src, dst, dist, lighting and ``way``: what a step over the edge is told and warned by, the risk of hazards around its middle included."""
    mid = with_midpoints(nodes, edges)
    risks = quick_risk(mid.select("id", F.col("mid_lat").alias("lat"), F.col("mid_lon").alias("lon")), active)
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    way = F.struct(
        "dist", "lighting", F.coalesce("risk", F.lit(0.0)).alias("risk"), geo.cardinal(geo.bearing(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))).alias("heading"), "surface", "width_m", "kerb_height",
        "has_stairs", "has_barrier", "is_steep", F.col("is_under_construction").alias("built"), F.lower(F.coalesce("access", F.lit(""))).contains("wheelchair=no").alias("no_wheels"),
        (blank(F.col("surface")) | (F.lower("surface") == "unknown")).alias("no_surface"), blank(F.col("smoothness")).alias("no_smoothness"),
    )
    return mid.join(risks.hint("merge"), "id", "left").select("id", "src", "dst", "dist", "lighting", way.alias("way"))


#: Whom a warning is for.
CHAIR, STROLLER, OTHERS = 1, 2, 4
ALL = CHAIR | STROLLER | OTHERS


def step_warnings(step: Column) -> Column:
    """The reference's warnings of a step (i, way) of a route: whom, text."""
    way = step["way"]
    stairs = lambda whom, note: (whom, way["has_stairs"], F.lit(f"This segment contains stairs — {note}."))
    texts = (
        stairs(CHAIR, "stairs are not wheelchair accessible"),
        stairs(STROLLER, "stairs are difficult with a stroller"),
        stairs(OTHERS, "stairs present"),
        (ALL, way["has_barrier"], F.lit("Physical barrier detected on this path.")),
        (CHAIR | STROLLER, way["no_wheels"], F.lit("OSM marks this segment as not wheelchair accessible.")),
        (ALL, way["kerb_height"] > 0.03, F.format_string("Raised kerb (%.0fcm) — may affect wheelchair access.", way["kerb_height"] * 100)),
        (ALL, way["surface"].isin("cobblestone", "gravel", "unpaved"), F.concat(F.lit("Surface is "), way["surface"], F.lit(" — may be difficult for wheeled mobility."))),
        (ALL, way["lighting"] < 0.3, F.lit("Poor street lighting detected.")),
        (ALL, way["built"], F.lit("Active construction zone — proceed with caution.")),
        (ALL, way["is_steep"], F.lit("Steep gradient ahead.")),
        (ALL, way["width_m"] < 0.9, F.format_string("Narrow path (%.1fm) — limited wheelchair access.", way["width_m"])),
        (ALL, way["risk"] > 0.7, F.format_string("Elevated risk area (score %.2f).", way["risk"])),
    )
    number = F.concat(F.lit("Step "), (step["i"] + 1).cast("string"), F.lit(": "))
    return F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(whom).alias("whom"), F.concat(number, text).alias("text"))) for whom, holds, text in texts]))


def data_gaps(steps: Column) -> Column:
    """The warnings (whom, text) about tags that a route's edges lack; widths and smoothness count for wheels."""
    count = lambda lacks: F.size(F.filter(steps, lambda s: lacks(s["way"])))
    surface, width, smoothness = count(lambda w: w["no_surface"]), count(lambda w: w["width_m"].isNull()), count(lambda w: w["no_smoothness"])
    found = []
    for whom, counts in ((OTHERS, ((surface, "surface"),)), (CHAIR | STROLLER, ((surface, "surface"), (width, "width"), (smoothness, "smoothness")))):
        issues = F.array_compact(F.array(*[F.when(n > 0, F.concat(n.cast("string"), F.lit(f" missing {name}"))) for n, name in counts]))
        text = F.concat(F.lit("Accessibility data confidence is lower: "), F.array_join(issues, ", "), F.lit(" tag(s) on the selected route rely on inferred defaults."))
        found.append(F.when(F.size(issues) > 0, F.struct(F.lit(whom).alias("whom"), text.alias("text"))))
    return F.array_compact(F.array(*found))


def told_routes(asked: DataFrame, paths: DataFrame, nodes: DataFrame, edges: DataFrame, active: DataFrame) -> DataFrame:
    """id, metres, lighting, steps, minutes, safety, warnings and told (from, to, metres, safety, instruction of every step) of all requests (id, start_node, end_node, profile).

    Hops are gathered and texts made once for each pair of nodes; a request takes the warnings that are for its profile. A request
    from a node to itself has no step; one without a path has -1 steps and no figures.
    """
    from stepfree.operators.assist import instruction

    used = stored(path_hops(paths).select("src", "dst").distinct(), "used")
    known = stored(told_edges(nodes, edges.join(used.hint("merge"), ["src", "dst"], "left_semi"), active), "told")
    safety = F.when(F.sum("way.dist") > 0, F.sum((1 - F.col("way.risk")) * F.col("way.dist")) / F.sum("way.dist")).otherwise(1.0)
    found = route_sums(paths, known, safety.alias("safe"), F.sort_array(F.collect_list(F.struct("i", "src", "dst", "way"))).alias("all"))
    said = lambda s: F.struct(
        s["src"].alias("from"), s["dst"].alias("to"), F.round(s["way"]["dist"], 1).alias("metres"), F.round(1 - s["way"]["risk"], 3).alias("safety"),
        instruction(s["way"]["heading"], s["way"]["dist"], s["way"]["surface"], s["way"]["has_stairs"], s["way"]["is_steep"], s["i"], F.col("steps")).alias("instruction"),
    )
    warned = F.concat(F.flatten(F.transform("all", step_warnings)), data_gaps(F.col("all")))
    texts = found.select("start_node", "end_node", "metres", "lighting", "steps", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "safe")), 3).alias("safety"), warned.alias("warned"), F.transform("all", said).alias("told"))
    stays = paths.where("hops = 0").select("start_node", "end_node", F.lit(True).alias("stays"))
    both = asked.join(stays, ["start_node", "end_node"], "left").join(texts.hint("merge"), ["start_node", "end_node"], "left")
    whom = F.when(F.col("profile").isin("manual-wheelchair", "power-wheelchair"), CHAIR).when(F.col("profile") == "stroller", STROLLER).otherwise(OTHERS)
    own = F.transform(F.filter("warned", lambda w: w["whom"].bitwiseAND(whom) != 0), lambda w: w["text"])
    or_none = lambda c, value: F.coalesce(c, F.when(F.col("stays"), F.lit(value)))
    metres = or_none("metres", 0.0)
    return both.select(
        "id", metres.alias("metres"), "lighting", F.coalesce(or_none("steps", 0), F.lit(-1)).alias("steps"), F.round(metres / cost.WALKING / 60, 1).alias("minutes"), or_none("safety", 1.0).alias("safety"),
        F.coalesce(own, F.array().cast("array<string>")).alias("warnings"), F.coalesce("told", F.array().cast(texts.schema["told"].dataType)).alias("told"),
    )


@query("agg_route_summary")
def agg_route_summary(spark, sf_dir):
    """Length, minutes, distance-weighted lighting and safety, warnings and the steps of the paths found, for all requests."""
    asked, paths = pairs_searched(spark, sf_dir, "standard")
    return told_routes(asked, paths, *graph(spark, sf_dir), active_hazards(spark, sf_dir))


@query("join_overlap", with_views("""with r as (select id % 12 as region, min(lat) as s, max(lat) as n, min(lon) as w, max(lon) as e from node where id is not null group by id % 12)
select a.region as a, b.region as b, round((least(a.n, b.n) - greatest(a.s, b.s)) * (least(a.e, b.e) - greatest(a.w, b.w)) * 1000000, 4) as area from r a join r b on a.region < b.region and a.s < b.n and b.s < a.n and a.w < b.e and b.w < a.e"""))
def join_overlap(spark, sf_dir):
    """Pairs of regions whose rectangles overlap (twelve regions, so the range join is broadcast)."""
    nodes, _ = graph(spark, sf_dir)
    r = nodes.groupBy((F.col("id") % 12).alias("region")).agg(F.min("lat").alias("s"), F.max("lat").alias("n"), F.min("lon").alias("w"), F.max("lon").alias("e"))
    a, b = r.alias("a"), r.alias("b")
    c = F.col
    overlap = (c("a.region") < c("b.region")) & (c("a.s") < c("b.n")) & (c("b.s") < c("a.n")) & (c("a.w") < c("b.e")) & (c("b.w") < c("a.e"))
    area = (F.least("a.n", "b.n") - F.greatest("a.s", "b.s")) * (F.least("a.e", "b.e") - F.greatest("a.w", "b.w")) * 1_000_000
    return a.join(F.broadcast(b), overlap).select(c("a.region").alias("a"), c("b.region").alias("b"), F.round(area, 4).alias("area"))


@query("win_turns", with_views("""with p as (select id % 20 as route, id, lat, lon from node), s as (select *, degrees(atan2((lead(lon) over w - lon) * cos(radians(lat)), lead(lat) over w - lat)) as out_b,
 degrees(atan2((lon - lag(lon) over w) * cos(radians(lat)), lat - lag(lat) over w)) as in_b from p window w as (partition by route order by id)),
d as (select route, id, out_b - in_b as d from s), n as (select route, id, d - 360 * floor((d + 180) / 360) as turn from d where d is not null)
select route, id, case when turn >= 22 then 'right' when turn <= -22 then 'left' else 'straight' end as turn from n"""))
def win_turns(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    w = W.partitionBy("route").orderBy("id")
    p = nodes.select((F.col("id") % 20).alias("route"), "id", "lat", "lon")
    head = lambda a, b: F.degrees(F.atan2((b("lon") - a("lon")) * F.cos(F.radians("lat")), b("lat") - a("lat")))
    here, ahead, behind = F.col, lambda c: F.lead(c).over(w), lambda c: F.lag(c).over(w)
    d = p.select("route", "id", (head(here, ahead) - head(behind, here)).alias("d")).where("d is not null")
    turn = F.col("d") - 360 * F.floor((F.col("d") + 180) / 360)
    return d.select("route", "id", F.when(turn >= 22, "right").when(turn <= -22, "left").otherwise("straight").alias("turn"))


@query("warmup_points", with_views("""with base as (select lat, lon, 0 as ord from node), steps as (select lat + k * 0.001e0 as lat, lon + k * 0.001e0 as lon, k as ord, lat as l0 from base, (select unnest(range(0, 3)) as k))
select cast(round(lat * 10000) as bigint) as ky, cast(round(lon * 10000) as bigint) as kx, min(ord) as ord from steps group by 1, 2"""))
def warmup_points(spark, sf_dir):
    nodes, _ = graph(spark, sf_dir)
    k = F.explode(F.sequence(F.lit(0), F.lit(2)))
    steps = nodes.withColumn("k", k).select((F.col("lat") + F.col("k") * 0.001).alias("lat"), (F.col("lon") + F.col("k") * 0.001).alias("lon"), "k")
    return steps.groupBy(F.round(F.col("lat") * 10000).cast("long").alias("ky"), F.round(F.col("lon") * 10000).cast("long").alias("kx")).agg(F.min("k").cast("long").alias("ord"))


@query("hash_artifact_set", with_views(f"with {_MID}, s as (select floor(mid_lat / 0.01e0)::bigint as y, floor(mid_lon / 0.01e0)::bigint as x, count(*) as n from mid group by 1, 2) select sha256('v1' || chr(10) || string_agg(y || ':' || x || ':' || n, chr(10) order by y, x)) as digest from s"))
def hash_artifact_set(spark, sf_dir):
    """One digest over the shards' lines in key order: a row for each shard, so the list is as long as the city has cells."""
    s = sharded(*graph(spark, sf_dir)).groupBy("shard_y", "shard_x").agg(F.count("*").alias("n"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("shard_y", "shard_x", "n"))), lambda r: F.concat_ws(":", r["shard_y"], r["shard_x"], r["n"]))
    return s.agg(F.sha2(F.concat(F.lit("v1\n"), F.array_join(lines, "\n")), 256).alias("digest"))
