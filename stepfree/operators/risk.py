"""Spatial joins and risk: scores around points, grids, tiles, routes."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.functions import cost, geo, risk
from stepfree.functions import sqltext as sql
from stepfree.operators.filters import edges, hazards, in_radius
from stepfree.registry import query
from stepfree.shared import stored
from stepfree.spatial import first_of_place, nearest, within_distance
from stepfree.views import register, with_views

RADIUS = 300.0
#: Weights of proximity, density, infrastructure, crime, lighting and cameras.
WEIGHTS = (0.35, 0.20, 0.15, 0.12, 0.10, 0.08)
DEFAULTS = {"infrastructure": 0.35, "lighting": 0.30, "cameras": 0.40}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query points: the nodes."""
    register(spark, sf_dir, "node")
    return spark.table("node")


_POINTS = "points as (select * from node)"


def active_hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = hazards(spark, sf_dir).where(risk.is_active(F.col("status")))
    return df.select(F.col("id").alias("r_id"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"), "hazard_type", "reported_at")


def quick_risk(base: DataFrame, active: DataFrame, metres: float = RADIUS) -> DataFrame:
    """id, risk of the points (id, lat, lon) with a hazard within ``metres`` on the flat earth: the reference's short score for every hop of a route."""
    places = active.groupBy("r_lat", "r_lon").agg(F.sum(risk.severity(F.col("hazard_type"))).alias("severity"), F.count("*").alias("k"))
    flat = geo.equirectangular(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    near = within_distance(base.select("id", "lat", "lon"), places, metres + 1).withColumn("flat", flat).where(F.col("flat") <= metres)
    sums = near.groupBy("id").agg(F.sum(F.col("severity") * F.exp(-F.col("flat") / risk.DECAY_M)).alias("total"), F.sum("k").alias("n"))
    return sums.select("id", risk.normalised(F.col("total"), F.col("n")).alias("risk"))


def hazard_sums(base: DataFrame, active: DataFrame, metres: float) -> DataFrame:
    """Per point: decayed severity sum (total) and number (n) of the hazards within ``metres``; those at one place travel as one row."""
    places = active.groupBy("r_lat", "r_lon").agg(F.sum(risk.severity(F.col("hazard_type"))).alias("severity"), F.count("*").alias("k"))
    weight = F.col("severity") * F.exp(-F.col("distance_m") / risk.DECAY_M)
    return within_distance(base.select("id", "lat", "lon"), places, metres).groupBy("id").agg(F.sum(weight).alias("total"), F.sum("k").alias("n"))


#: Hazards told of at a point, the heaviest first.
TOLD = 20


def heaviest_hazards(base: DataFrame, active: DataFrame, metres: float, k: int = TOLD) -> DataFrame:
    """id, nearby: the ``k`` hazards within ``metres`` of a point that weigh most, as id:type:metres:weight (ties: the smaller id, then type).

    Rows of a place and severity are equally far and weigh the same, so the first ``k`` of them are enough; a place travels as one row with
    these. Of a point's places the ``k`` whose first hazard comes first hold its ``k`` hazards: each other place has ``k`` hazards before all its own.
    """
    order = W.partitionBy("r_lat", "r_lon", "severity").orderBy("r_id", "hazard_type")
    some = active.withColumn("severity", risk.severity(F.col("hazard_type"))).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    places = some.groupBy("r_lat", "r_lon").agg(F.collect_list(F.struct("severity", "r_id", "hazard_type")).alias("all"))
    light = lambda h: -F.round(h["severity"] * F.exp(-F.col("distance_m") / risk.DECAY_M), 4)
    weighed = F.transform("all", lambda h: F.struct(light(h).alias("light"), h["r_id"].alias("r_id"), h["hazard_type"].alias("hazard_type"), F.round("distance_m", 1).alias("metres")))
    near = within_distance(base.select("id", "lat", "lon"), places, metres).select("id", F.slice(F.array_sort(weighed), 1, k).alias("some"))
    kept = near.withColumn("__n", F.row_number().over(W.partitionBy("id").orderBy(F.col("some")[0]))).where(F.col("__n") <= k)
    first = kept.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("some"))), 1, k).alias("first"))
    told = F.transform("first", lambda h: F.format_string("%d:%s:%.1f:%.4f", h["r_id"], h["hazard_type"], h["metres"], -h["light"]))
    return first.select("id", F.array_join(told, ";").alias("nearby"))


_NEAR = f"""near as (select p.id, h.id as hid, {sql.haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')} as d, {sql.severity('h.hazard_type')} as sev
  from points p join hazard h on h.status in ('reported', 'under_review') and abs(p.lat - h.lat) < 0.0040e0 and abs(p.lon - h.lon) < 0.008e0
  where {sql.haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')} <= {RADIUS})"""


@query("join_distance", with_views(f"with {_POINTS}, {_NEAR} select id, hid as hazard_id, round(d, 4) as distance_m from near"))
def join_distance(spark, sf_dir):
    near = within_distance(points(spark, sf_dir), active_hazards(spark, sf_dir), RADIUS)
    return near.select("id", F.col("r_id").alias("hazard_id"), F.round("distance_m", 4).alias("distance_m"))


@query(
    "join_knn",
    with_views(
        f"with {_POINTS}, {_NEAR} select id, hid as hazard_id, round(d, 4) as distance_m, (row_number() over (partition by id order by d, hid))::int as rank from near "
        "qualify row_number() over (partition by id order by d, hid) <= 3"
    ),
)
def join_knn(spark, sf_dir):
    near = nearest(points(spark, sf_dir), first_of_place(active_hazards(spark, sf_dir), 3), "id", RADIUS, k=3)
    return near.select("id", F.col("r_id").alias("hazard_id"), F.round("distance_m", 4).alias("distance_m"), "rank")


@query("agg_hazard_risk", with_views(f"with {_POINTS}, {_NEAR} select p.id, count(n.d)::bigint as hazards, round({sql.normalised('coalesce(sum(sev * exp(-d / 150e0)), 0)', 'count(n.d)')}, 6) as risk from points p left join near n on n.id = p.id group by p.id"))
def agg_hazard_risk(spark, sf_dir):
    base = points(spark, sf_dir)
    sums = hazard_sums(base, active_hazards(spark, sf_dir), RADIUS)
    n, total = F.coalesce("n", F.lit(0)), F.coalesce("total", F.lit(0.0))
    return base.join(sums, "id", "left").select("id", n.alias("hazards"), F.round(risk.normalised(total, n), 6).alias("risk"))


#: Metres within which incidents, lamps and cameras count; fixed values: lamps and cameras that leave no risk.
INCIDENT_M, LAMP_M, CAMERA_M = 500.0, 100.0, 300.0
LAMPS, CAMERAS = 10.0, 3.0


def counted(base: DataFrame, things: DataFrame, metres: float, name: str) -> DataFrame:
    """id and the number of ``things`` (lat, lon) within ``metres`` of each point that has any; things at one place travel as one row."""
    places = things.groupBy(F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon")).agg(F.count("*").alias("k"))
    return within_distance(base.select("id", "lat", "lon"), places, metres).groupBy("id").agg(F.sum("k").alias(name))


#: Edges that count around a point.
NEAREST_EDGES = 50


def edge_starts(spark: SparkSession, columns: list[str], where: str = "true") -> DataFrame:
    """r_id, r_lat, r_lon and ``columns`` of the edges, at the nodes where they start."""
    at = spark.table("node").select(F.col("id").alias("src"), F.col("lat").alias("r_lat"), F.col("lon").alias("r_lon"))
    return spark.table("edge").where(where).join(at.hint("merge"), "src").select(F.col("id").alias("r_id"), "r_lat", "r_lon", *columns)


def infrastructure(spark: SparkSession, sf_dir: str, base: DataFrame, metres: float) -> DataFrame:
    """id, edges, lighting, stairs, infra of the 50 edges nearest to each point that has any within ``metres``.

    Points that have 50 edges within 0.6 of the radius need no other; only the rest look through the whole of it.
    """
    register(spark, sf_dir, "node", "edge")
    edge = F.struct("r_id", "lighting", F.col("has_stairs").cast("double").alias("stairs"), "kerb_height")
    first = first_of_place(edge_starts(spark, ["lighting", "has_stairs", "kerb_height"]), NEAREST_EDGES)
    places = first.groupBy("r_lat", "r_lon").agg(F.min("r_id").alias("r_id"), F.collect_list(edge).alias("edges"))
    points_of = base.select("id", "lat", "lon")
    close = stored(_nearest_edges(points_of, places, 0.6 * metres).where(F.col("edges") == NEAREST_EDGES), "close")
    rest = points_of.join(close.select("id").hint("merge"), "id", "left_anti")
    means = close.unionByName(_nearest_edges(rest, places, metres))
    mobility = 0.7 * F.col("stairs") + 0.3 * F.least(10 * F.col("kerb"), F.lit(1.0))
    return means.select("id", "edges", "lighting", "stairs", risk.clamp01(0.4 * (1 - F.col("lighting")) + 0.6 * mobility).alias("infra"))


def _nearest_edges(base: DataFrame, places: DataFrame, metres: float) -> DataFrame:
    """id, edges and means of lighting, stairs, kerb over the 50 edges nearest to each point.

    A place travels as one row with its edges, the first 50 at most. Of a point's places the 50 nearest (ties: by their first
    edge) hold its 50 edges: each of them has an edge that comes before all edges of any other place.
    """
    near = nearest(base, places, "id", metres, k=NEAREST_EDGES)
    placed = F.transform("edges", lambda e: F.struct(F.col("distance_m").alias("d"), e["r_id"].alias("r_id"), e["lighting"].alias("lighting"), e["stairs"].alias("stairs"), e["kerb_height"].alias("kerb_height")))
    taken = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list(placed))), 1, NEAREST_EDGES).alias("e"))

    def mean(name: str) -> Column:
        values = F.filter(F.transform("e", lambda x: x[name]), lambda v: v.isNotNull())
        total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
        return F.when(F.size(values) > 0, total / F.size(values))

    return taken.select("id", F.size("e").cast("long").alias("edges"), mean("lighting").alias("lighting"), mean("stairs").alias("stairs"), mean("kerb_height").alias("kerb"))


def signals(spark: SparkSession, sf_dir: str, base: DataFrame, metres: float) -> DataFrame:
    """The points with hazards (n), proximity, infra, crimes, crime, lights and cameras around them, from the tables of each."""
    register(spark, sf_dir, "node", "edge", "hazard", "incident", "fixture")
    lamps = edge_starts(spark, [], "lighting >= 0.95e0").select(F.col("r_lat").alias("lat"), F.col("r_lon").alias("lon"))
    sums = hazard_sums(base, active_hazards(spark, sf_dir), metres)
    out = base.join(sums, "id", "left").join(infrastructure(spark, sf_dir, base, metres).select("id", "infra"), "id", "left")
    for name, things, reach in (("crimes", spark.table("incident"), INCIDENT_M), ("lamps", lamps, LAMP_M), ("cams", spark.table("fixture").where("kind = 'camera'"), CAMERA_M)):
        out = out.join(counted(base, things, reach, name), "id", "left")
    n = F.coalesce("n", F.lit(0))
    return out.select(
        "id", n.alias("n"), risk.normalised(F.coalesce("total", F.lit(0.0)), n).alias("proximity"), F.coalesce("infra", F.lit(DEFAULTS["infrastructure"])).alias("infra"),
        F.coalesce("crimes", F.lit(0)).alias("crimes"), risk.crime(F.coalesce("crimes", F.lit(0))).alias("crime"),
        F.greatest(F.lit(0.0), 1 - F.coalesce("lamps", F.lit(0)) / LAMPS).alias("lights"), F.greatest(F.lit(0.0), 1 - F.coalesce("cams", F.lit(0)) / CAMERAS).alias("cameras"),
    )


def _around(metres: float, table: str, alias: str) -> str:
    """SQL condition: ``table`` within ``metres`` of the point p."""
    d = metres / 111_000 * 1.01
    return f"abs(p.lat - {alias}.lat) < {d:.6f}e0 and abs(p.lon - {alias}.lon) < {2 * d:.6f}e0 and {sql.haversine('p.lat', 'p.lon', f'{alias}.lat', f'{alias}.lon')} <= {metres}"


def _signals_sql(metres: float) -> str:
    """The common table expressions of ``signals``, the last named s."""
    d = sql.haversine("p.lat", "p.lon", "h.lat", "h.lon")
    return f"""{_POINTS}, near as (select p.id, {d} as d, {sql.severity('h.hazard_type')} as sev from points p join hazard h on h.status in ('reported', 'under_review') and {_around(metres, 'hazard', 'h')}),
sums as (select id, count(*)::bigint as n, sum(sev * exp(-d / 150e0)) as total from near group by id),
ranked as (select p.id, e.lighting, e.has_stairs, e.kerb_height, row_number() over (partition by p.id order by {sql.haversine('p.lat', 'p.lon', 'n.lat', 'n.lon')}, e.id) as rn
 from points p join node n on {_around(metres, 'node', 'n')} join edge e on e.src = n.id),
infra as (select id, 0.4e0 * (1 - avg(lighting)) + 0.6e0 * (0.7e0 * count(*) filter (where has_stairs) / count(*) + 0.3e0 * least(10 * avg(kerb_height), 1e0)) as infra from ranked where rn <= 50 group by id),
crimes as (select p.id, count(*)::bigint as crimes from points p join incident i on {_around(INCIDENT_M, 'incident', 'i')} group by p.id),
lamps as (select p.id, count(*) as lamps from points p join fixture f on f.kind = 'lamp' and {_around(LAMP_M, 'fixture', 'f')} group by p.id),
cams as (select p.id, count(*) as cams from points p join fixture f on f.kind = 'camera' and {_around(CAMERA_M, 'fixture', 'f')} group by p.id),
s as (select p.id, coalesce(n, 0)::bigint as n, {sql.normalised('coalesce(total, 0)', 'coalesce(n, 0)')} as proximity, coalesce(infra, 0.35e0) as infra, coalesce(crimes, 0)::bigint as crimes,
 case when crimes > 0 then 1 / (1 + exp(-2e0 * (crimes / 12e0 - 1))) else 0e0 end as crime, greatest(0e0, 1 - coalesce(lamps, 0) / 10e0) as lights, greatest(0e0, 1 - coalesce(cams, 0) / 3e0) as cameras
 from points p left join sums using (id) left join infra using (id) left join crimes using (id) left join lamps using (id) left join cams using (id))"""


_SCORE = f"""with {_signals_sql(RADIUS)}, f as (select *, least(n / (pi() * 0.09e0) / 50, 1) as density from s),
weighed as (select id, hid, hazard_type, d, round(sev * exp(-d / 150e0), 4) as w from (select p.id, h.id as hid, h.hazard_type, {sql.haversine('p.lat', 'p.lon', 'h.lat', 'h.lon')} as d, {sql.severity('h.hazard_type')} as sev
 from points p join hazard h on h.status in ('reported', 'under_review') and {_around(RADIUS, 'hazard', 'h')})),
heavy as (select * from weighed qualify row_number() over (partition by id order by w desc, hid, hazard_type) <= {TOLD}),
told as (select id, string_agg(printf('%d:%s:%.1f:%.4f', hid, hazard_type, round(d, 1), w), ';' order by w desc, hid, hazard_type) as nearby from heavy group by id)
select id, n as hazards, crimes, round(proximity, 5) as proximity, round(density, 5) as density, round(infra, 5) as infrastructure, round(crime, 5) as crime, round(lights, 5) as lighting, round(cameras, 5) as cameras,
  round(least(1e0, greatest(0e0, 0.35e0 * proximity + 0.20e0 * density + 0.15e0 * infra + 0.12e0 * crime + 0.10e0 * lights + 0.08e0 * cameras)), 5) as overall, coalesce(nearby, '') as nearby from f left join told using (id)"""


def blended(parts: dict[str, Column]) -> Column:
    names = ("proximity", "density", "infrastructure", "crime", "lighting", "cameras")
    total = F.lit(0.0)
    for name, weight in zip(names, WEIGHTS, strict=True):
        total = total + parts[name] * weight
    return risk.clamp01(total)


@query("agg_risk_score", with_views(_SCORE))
def agg_risk_score(spark, sf_dir):
    """Six weighted signals around each point and the twenty hazards that weigh most there; signals without a row take their default."""
    base = points(spark, sf_dir)
    found = signals(spark, sf_dir, base, RADIUS).join(heaviest_hazards(base, active_hazards(spark, sf_dir), RADIUS), "id", "left")
    area = pi * (RADIUS / 1000) ** 2
    parts = {"proximity": F.col("proximity"), "density": F.least(F.col("n") / area / 50.0, F.lit(1.0)), "infrastructure": F.col("infra"), "crime": F.col("crime"), "lighting": F.col("lights"), "cameras": F.col("cameras")}
    return found.select("id", F.col("n").alias("hazards"), "crimes", *[F.round(v, 5).alias(k) for k, v in parts.items()], F.round(blended(parts), 5).alias("overall"), F.coalesce("nearby", F.lit("")).alias("nearby"))


@query("agg_infra_risk", with_views(f"""with ranked as (select p.id, e.lighting, e.has_stairs, e.kerb_height, row_number() over (partition by p.id order by {sql.haversine('p.lat', 'p.lon', 'n.lat', 'n.lon')}, e.id) as rn
 from node p join node n on abs(p.lat - n.lat) < 0.0030e0 and abs(p.lon - n.lon) < 0.006e0 and {sql.haversine('p.lat', 'p.lon', 'n.lat', 'n.lon')} <= 200 join edge e on e.src = n.id)
select p.id, count(r.id)::bigint as edges, round(avg(lighting), 6) as lighting, round(avg(case has_stairs when true then 1e0 when false then 0e0 end), 6) as stairs,
 round(case when count(r.id) = 0 then 0.35e0 else 0.4e0 * (1 - avg(lighting)) + 0.6e0 * (0.7e0 * count(*) filter (where has_stairs) / count(*) + 0.3e0 * least(10 * avg(kerb_height), 1e0)) end, 6) as risk
 from node p left join (select * from ranked where rn <= 50) r on r.id = p.id group by p.id"""))
def agg_infra_risk(spark, sf_dir):
    """The 50 edges nearest to a point: dark streets, stairs and kerbs; 0.35 where no edge is near."""
    base = points(spark, sf_dir)
    found = infrastructure(spark, sf_dir, base, 200.0).select("id", "edges", *[F.round(c, 6).alias(n) for c, n in (("lighting", "lighting"), ("stairs", "stairs"), ("infra", "risk"))])
    return base.select("id").join(found, "id", "left").select("id", F.coalesce("edges", F.lit(0)).alias("edges"), "lighting", "stairs", F.coalesce("risk", F.lit(0.35)).alias("risk"))


PREDICT_M = 200.0
_WIND, _FROST = "(id % 20)", "(id % 23 - 8)"


@query("agg_predictive_risk", with_views(f"""with {_signals_sql(PREDICT_M)},
f as (select *, {sql.day_curve('(id % 24)')} as tod, greatest(case when id % 3 = 0 then 0.4e0 else 0e0 end, case when {_WIND} > 15 then 0.55e0 when {_WIND} > 10 then 0.30e0 else 0e0 end,
 case when {_FROST} < -5 then 0.65e0 when {_FROST} < 0 then 0.45e0 else 0e0 end) as wx from s),
z as (select *, 0.35e0 * proximity + 0.10e0 * tod + 0.10e0 * wx + 0.12e0 * crime + 0.12e0 * infra + 0.12e0 * lights + 0.09e0 * cameras as z from f)
select id, round(1 / (1 + exp(-5e0 * (z - 0.60e0))), 4) as overall, round(proximity, 4) as hazard_risk, round(tod, 4) as time_risk, round(wx, 4) as weather_risk, round(crime, 4) as crime_risk, round(infra, 4) as infra_risk,
 round(lights, 4) as lighting_risk, round(cameras, 4) as camera_risk,
 case when tod > 0.4e0 or wx > 0.3e0 or proximity > 0.3e0 or crime > 0.2e0 or infra > 0.3e0 then case when tod > 0.4e0 then 'night;' else '' end || case when wx > 0.3e0 then 'weather;' else '' end
 || case when proximity > 0.3e0 then 'hazards;' else '' end || case when crime > 0.2e0 then 'crime;' else '' end || case when infra > 0.3e0 then 'infrastructure;' else '' end else 'none;' end as factors from z"""))
def agg_predictive_risk(spark, sf_dir):
    """Seven signals by a logistic curve, with what stands out. There is no weather table: codes, wind and frost of a point are made from its id."""
    found = signals(spark, sf_dir, points(spark, sf_dir), PREDICT_M)
    wx = risk.weather(F.when(F.col("id") % 3 == 0, F.array(F.lit(502))).otherwise(F.array().cast("array<int>")), F.expr(_WIND), F.expr(_FROST))
    parts = (("hazard_risk", F.col("proximity"), 0.35), ("time_risk", risk.time_of_day(F.col("id") % 24), 0.10), ("weather_risk", wx, 0.10), ("crime_risk", F.col("crime"), 0.12),
             ("infra_risk", F.col("infra"), 0.12), ("lighting_risk", F.col("lights"), 0.12), ("camera_risk", F.col("cameras"), 0.09))
    found = found.select("id", *[v.alias(k) for k, v, _ in parts])
    z = F.lit(0.0)
    for name, _, weight in parts:
        z = z + F.col(name) * weight
    marks = (("night;", F.col("time_risk") > 0.4), ("weather;", F.col("weather_risk") > 0.3), ("hazards;", F.col("hazard_risk") > 0.3), ("crime;", F.col("crime_risk") > 0.2), ("infrastructure;", F.col("infra_risk") > 0.3))
    named = F.array_compact(F.array(*[F.when(c, m) for m, c in marks]))
    factors = F.when(F.size(named) == 0, "none;").otherwise(F.array_join(named, ""))
    return found.select("id", F.round(risk.sigmoid(z, 5.0, 0.60), 4).alias("overall"), *[F.round(k, 4).alias(k) for k, *_ in parts], factors.alias("factors"))


@query("agg_blend_risk", with_views("select id, round(least(1e0, greatest(0e0, 0.6e0 * safety_weight + 0.2e0 * case when id % 24 >= 22 or id % 24 < 5 then 0.8e0 when id % 24 >= 6 and id % 24 < 9 then 0.4e0 else 0.2e0 end + 0.2e0 * 0.1e0)), 6) as risk from request"))
def agg_blend_risk(spark, sf_dir):
    register(spark, sf_dir, "request")
    hour = F.col("id") % 24
    return spark.table("request").select("id", F.round(risk.clamp01(0.6 * F.col("safety_weight") + 0.2 * risk.coarse_time_of_day(hour) + 0.2 * 0.1), 6).alias("risk"))


def risk_cells(active: DataFrame) -> DataFrame:
    """cy, cx, hazards, risk: hazards scatter to the grid cells whose centres they reach; cells sum up: one shuffle on the cell."""
    size = 0.0009
    cells = (
        active.withColumn("dy", F.explode(F.sequence(F.lit(-4), F.lit(4))))
        .withColumn("dx", F.explode(F.sequence(F.lit(-7), F.lit(7))))
        .withColumn("cy", geo.cell(F.col("lat"), size) + F.col("dy"))
        .withColumn("cx", geo.cell(F.col("lon"), size) + F.col("dx"))
    )
    d = geo.haversine((F.col("cy") + 0.5) * size, (F.col("cx") + 0.5) * size, F.col("lat"), F.col("lon"))
    near = cells.withColumn("d", d).where("d <= 300")
    total = F.sum(risk.severity(F.col("hazard_type")) * F.exp(-F.col("d") / risk.DECAY_M))
    return near.groupBy("cy", "cx").agg(F.count("*").alias("hazards"), F.round(risk.normalised(total, F.count("*")), 6).alias("risk"))


@query("agg_risk_grid", with_views(f"""with act as (select *, floor(lat / 0.0009e0)::bigint as gy, floor(lon / 0.0009e0)::bigint as gx from hazard where status in ('reported', 'under_review')),
cand as (select a.id, gy + dy as cy, gx + dx as cx, {sql.haversine('((gy + dy) + 0.5e0) * 0.0009e0', '((gx + dx) + 0.5e0) * 0.0009e0', 'a.lat', 'a.lon')} as d, {sql.severity('hazard_type')} as sev
 from act a, (select unnest(range(-4, 5)) as dy), (select unnest(range(-7, 8)) as dx))
select cy, cx, count(*)::bigint as hazards, round({sql.normalised('sum(sev * exp(-d / 150e0))', 'count(*)')}, 6) as risk from cand where d <= 300 group by cy, cx"""))
def agg_risk_grid(spark, sf_dir):
    return risk_cells(hazards(spark, sf_dir).where(risk.is_active(F.col("status"))))


@query("agg_risk_tile", with_views("""select floor(lat / 0.0045e0)::bigint as ty, floor(lon / 0.007e0)::bigint as tx, count(*)::bigint as points,
 round(0.35e0 * 0 + 0.12e0 * avg(case when id % 31 > 0 then 1 / (1 + exp(-2e0 * ((id % 31) / 12e0 - 1))) else 0 end) + 0.15e0 * 0.35e0 + 0.10e0 * 0.30e0 + 0.08e0 * 0.40e0 + 0.03e0, 6) as risk from node group by 1, 2"""))
def agg_risk_tile(spark, sf_dir):
    register(spark, sf_dir, "node")
    level = 0.12 * F.avg(risk.crime(F.col("id") % 31)) + 0.15 * 0.35 + 0.10 * 0.30 + 0.08 * 0.40 + 0.03
    tiles = spark.table("node").groupBy(geo.cell(F.col("lat"), 0.0045).alias("ty"), geo.cell(F.col("lon"), 0.007).alias("tx"))
    return tiles.agg(F.count("*").alias("points"), F.round(level, 6).alias("risk"))


@query("agg_hex_grid")
def agg_hex_grid(spark, sf_dir):
    """Decayed risk on a hexagonal grid of our own (axial coordinates, about 174 m): hazards reach three rings."""
    side = 0.0016
    df = hazards(spark, sf_dir).where(risk.is_active(F.col("status")))
    q, r = (F.sqrt(F.lit(3.0)) / 3 * F.col("lon") - F.col("lat") / 3) / side, (2 / 3 * F.col("lat")) / side
    rq, rr, rs = F.round(q), F.round(r), F.round(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    cq = F.when((dq > dr) & (dq > ds), -rr - rs).otherwise(rq)
    cr = F.when((dq > dr) & (dq > ds), rr).when(dr > ds, -rq - rs).otherwise(rr)
    ring = F.sequence(F.lit(-3), F.lit(3))
    cells = df.select("hazard_type", "lat", "lon", cq.cast("long").alias("q0"), cr.cast("long").alias("r0")).withColumn("a", F.explode(ring)).withColumn("b", F.explode(ring)).where("abs(a + b) <= 3")
    cells = cells.withColumn("q", F.col("q0") + F.col("a")).withColumn("r", F.col("r0") + F.col("b"))
    clat, clon = 1.5 * side * F.col("r"), side * (F.sqrt(F.lit(3.0)) * F.col("q") + F.sqrt(F.lit(3.0)) / 2 * F.col("r"))
    d = geo.equirectangular(F.col("lat"), F.col("lon"), clat, clon)
    total = F.sum(risk.severity(F.col("hazard_type")) * F.exp(-d / risk.DECAY_M))
    return cells.groupBy("q", "r").agg(risk.normalised(total, F.count("*")).cast("float").alias("risk")).where("risk > 0.001")


@query("agg_route_risk", with_views("""with path as (select id % 50 as route, id as pos, (id % 37) / 37e0 as risk from node),
c as (select *, row_number() over (partition by route order by pos) - 1 as i, count(*) over (partition by route) as n from path)
select route, count(*)::bigint as samples, round(sum(risk), 6) as risk from c where i % greatest(1, n // 30) = 0 group by route"""))
def agg_route_risk(spark, sf_dir):
    """Every max(1, n / 30)th point of a route, summed."""
    register(spark, sf_dir, "node")
    path = spark.table("node").select((F.col("id") % 50).alias("route"), F.col("id").alias("pos"), ((F.col("id") % 37) / 37.0).alias("risk"))
    by_route = W.partitionBy("route")
    c = path.withColumn("i", F.row_number().over(by_route.orderBy("pos")) - 1).withColumn("n", F.count("*").over(by_route))
    return c.where("i % greatest(1, n div 30) = 0").groupBy("route").agg(F.count("*").alias("samples"), F.round(F.sum("risk"), 6).alias("risk"))


@query("join_segment_distance")
def join_segment_distance(spark, sf_dir):
    """Active hazards less than 50 m from any edge of the street grid, with the nearest edge."""
    register(spark, sf_dir, "node", "edge", "hazard")
    nodes = spark.table("node")
    ends = nodes.select(F.col("id").alias("src"), F.col("lat").alias("alat"), F.col("lon").alias("alon"))
    heads = nodes.select(F.col("id").alias("dst"), F.col("lat").alias("blat"), F.col("lon").alias("blon"))
    segments = spark.table("edge").where("src < dst").join(ends, "src").join(heads, "dst")
    middles = segments.select(F.col("id").alias("r_id"), ((F.col("alat") + F.col("blat")) / 2).alias("r_lat"), ((F.col("alon") + F.col("blon")) / 2).alias("r_lon"), "alat", "alon", "blat", "blon")
    act = hazards(spark, sf_dir).where(risk.is_active(F.col("status"))).select("id", "lat", "lon")
    near = within_distance(act, middles, 100.0)
    d = geo.point_segment(*(F.col(c) for c in ("lat", "lon", "alat", "alon", "blat", "blon")))
    return near.withColumn("d", d).where("d < 50").groupBy("id").agg(F.round(F.min("d"), 4).alias("distance_m"), F.min_by("r_id", F.struct("d", "r_id")).alias("edge_id"))


@query("sort_knn_limit", with_views(f"select id, round({sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')}, 4) as distance_m from hazard where {sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')} <= 2000 order by {sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')}, id limit 50"))
def sort_knn_limit(spark, sf_dir):
    near = in_radius(hazards(spark, sf_dir), 52.48, -1.91, 2000.0).orderBy("distance_m", "id").limit(50)
    return near.select("id", F.round("distance_m", 4).alias("distance_m"))


@query("sort_multi_key", with_views(f"select id, status, round({sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')}, 1) as distance_m from hazard where status in ('reported', 'under_review') order by round({sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')}, 1), reported_at desc, id limit 100"))
def sort_multi_key(spark, sf_dir):
    d = F.round(geo.haversine(F.lit(52.48), F.lit(-1.91), F.col("lat"), F.col("lon")), 1)
    df = hazards(spark, sf_dir).where(risk.is_active(F.col("status"))).withColumn("distance_m", d)
    return df.orderBy("distance_m", F.desc("reported_at"), "id").limit(100).select("id", "status", "distance_m")


@query("cost_penalty", with_views(" union all ".join(f"select e.id, '{p}' as profile, round({sql.penalty(p, 'e')}, 5) as penalty_s from edge e" for p in ("standard", "manual-wheelchair", "stroller"))))
def cost_penalty(spark, sf_dir):
    df, out = edges(spark, sf_dir), None
    for p in ("standard", "manual-wheelchair", "stroller"):
        part = df.select("id", F.lit(p).alias("profile"), F.round(edge_penalty(p), 5).alias("penalty_s"))
        out = part if out is None else out.unionByName(part)
    return out


def edge_penalty(profile: str) -> Column:
    return cost.penalty(profile, *(F.col(c) for c in ("dist", "surface", "smoothness", "has_stairs", "has_barrier", "kerb_height", "width_m", "is_steep", "access")))


@query("cost_traversal", with_views(" union all ".join(f"select e.id, '{p}' as profile, round(e.dist / {v} + {sql.penalty(p, 'e')}, 5) as seconds from edge e" for p, v in (("standard", "1.3e0"), ("power-wheelchair", "1.1e0")))))
def cost_traversal(spark, sf_dir):
    df = edges(spark, sf_dir)
    parts = [df.select("id", F.lit(p).alias("profile"), F.round(cost.traversal(p, F.col("dist"), edge_penalty(p)), 5).alias("seconds")) for p in ("standard", "power-wheelchair")]
    return parts[0].unionByName(parts[1])


@query("cost_resolve_version", with_views(f"select e.id, round(case when id % 3 > 0 then 12e0 else {sql.penalty('standard', 'e')} end, 5) as penalty_s from edge e"))
def cost_resolve_version(spark, sf_dir):
    """The stored penalty where its version is current, a new one elsewhere."""
    df = edges(spark, sf_dir).withColumn("cost_version", (F.col("id") % 3).cast("int")).withColumn("stored", F.lit(12.0))
    return df.select("id", F.round(F.when(F.col("cost_version") >= 1, F.col("stored")).otherwise(edge_penalty("standard")), 5).alias("penalty_s"))


@query("cost_data_quality", with_views("select id, round(greatest(0.1e0, 1 - case when surface = 'unknown' then 0.25e0 else 0 end - case when smoothness is null then 0.20e0 else 0 end - case when width_m is null then 0.25e0 else 0 end), 6) as quality from edge"))
def cost_data_quality(spark, sf_dir):
    return edges(spark, sf_dir).select("id", F.round(cost.data_quality(F.col("surface"), F.col("smoothness"), F.col("width_m")), 6).alias("quality"))


def edge_safety() -> Column:
    return cost.base_safety(*(F.col(c) for c in ("surface", "smoothness", "has_stairs", "is_steep", "has_barrier", "kerb_height", "width_m")), F.col("lighting") == 0.1)


@query("cost_base_safety", with_views(f"select e.id, round({sql.base_safety('e')}, 6) as safety from edge e"))
def cost_base_safety(spark, sf_dir):
    return edges(spark, sf_dir).select("id", F.round(edge_safety(), 6).alias("safety"))


_EDGE_COST = f"""with b as (select e.*, {sql.base_safety('e')} as safety, {sql.penalty('stroller', 'e')} as pen, e.dist / 1.1e0 as base, (e.id % 10) / 10e0 as live from edge e)
select id, round(greatest((base + base * least(1e0, greatest(0e0, (safety + live) / 2)) * 4 * 0.5e0 + greatest(0e0, pen) * 0.5e0)
 * greatest(0.8e0, (1 + (1 - lighting) * 0.5e0) * case when has_crossing then 0.85e0 else 1.15e0 end * case when is_steep then 2e0 else 1e0 end), dist / 2e0) + 1e-7, 4) as cost from b"""

#: Preference -> factor on the cost of an edge.
MODIFIERS = {
    "low-light-penalty": "1 + (1 - lighting) * 0.5e0",
    "prefer-crossings": "case when has_crossing then 0.85e0 else 1.15e0 end",
    "avoid-reported-hazards": "1 + least(1e0, greatest(0e0, safety)) * 2",
    "avoid-construction": "case when is_under_construction then 4e0 else 1e0 end",
    "avoid-cobblestone": "case when surface in ('cobblestone', 'sett') then 2.5e0 else 1e0 end",
    "avoid-steep-hills": "case when is_steep then 2e0 else 1e0 end",
}


def edge_cost(profile: str, weight: float, preferences: list[str]) -> Column:
    """Seconds of an edge with columns safety and live_risk, modified by the preferences, never below dist / 2."""
    base = F.col("dist") / cost.speed(profile)
    level = risk.clamp01((F.col("safety") + F.col("live_risk")) / 2)
    factor = F.lit(1.0)
    for name in preferences:
        if name in MODIFIERS:
            factor = factor * F.expr(MODIFIERS[name])
    seconds = base + base * level * 4.0 * weight + F.greatest(F.lit(0.0), edge_penalty(profile)) * weight
    return F.greatest(seconds * F.greatest(F.lit(0.8), factor), F.col("dist") / 2.0)


@query("cost_edge", with_views(_EDGE_COST))
def cost_edge(spark, sf_dir):
    df = edges(spark, sf_dir).withColumn("safety", edge_safety()).withColumn("live_risk", (F.col("id") % 10) / 10.0)
    return df.select("id", F.round(edge_cost("stroller", 0.5, ["low-light-penalty", "prefer-crossings", "avoid-steep-hills"]) + 1e-7, 4).alias("cost"))


@query("cost_route_score", with_views("select request_id, alt, round(distance_m / 1000 * (1 - 0.4e0) + risk / 30 * 0.4e0 * 5 + obstacle * 0.4e0 * 3, 6) as score from route_alternative"))
def cost_route_score(spark, sf_dir):
    register(spark, sf_dir, "route_alternative")
    w = 0.4
    score = F.col("distance_m") / 1000 * (1 - w) + F.col("risk") / 30 * w * 5 + F.col("obstacle") * w * 3
    return spark.table("route_alternative").select("request_id", "alt", F.round(score, 6).alias("score"))


def excessive(straight_m: Column, distance_m: Column) -> Column:
    """Whether all of a group's alternatives are longer than three straight lines; a line under 50 m is too short to tell."""
    return F.bool_and((straight_m >= 50) & (distance_m / straight_m > 3))


_STRAIGHT = f"select r.id, {sql.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} as m from request r join node a on a.id = r.start_node join node b on b.id = r.end_node"


@query("route_detour", with_views(f"with s as ({_STRAIGHT}) select id as request_id, bool_and(m >= 50 and distance_m > 3 * m) as detour from s join route_alternative on request_id = id group by id"))
def route_detour(spark, sf_dir):
    """Requests of which all alternatives are detours against the line between their ends."""
    register(spark, sf_dir, "request", "node", "route_alternative")
    end = lambda c, name: spark.table("node").select(F.col("id").alias(c), F.col("lat").alias(f"{name}_lat"), F.col("lon").alias(f"{name}_lon"))
    lines = spark.table("request").join(end("start_node", "a"), "start_node").join(end("end_node", "b"), "end_node")
    lines = lines.select(F.col("id").alias("request_id"), geo.haversine(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")).alias("m"))
    return lines.join(spark.table("route_alternative"), "request_id").groupBy("request_id").agg(excessive(F.col("m"), F.col("distance_m")).alias("detour"))


def eta_minutes(duration_s: Column, distance_m: Column) -> Column:
    """The provider's duration where it is longer than 0.3 of the walk's, else the walk's; multiplied first, as 0.3 * (d / 1.3) rounds apart where both are equal."""
    return F.round(F.when(duration_s > 0.3 * distance_m / 1.3, duration_s).otherwise(distance_m / 1.3) / 60, 6)


@query("route_eta", with_views("select request_id, alt, round(case when duration_s > 0.3e0 * distance_m / 1.3e0 then duration_s else distance_m / 1.3e0 end / 60, 6) as minutes from route_alternative"))
def route_eta(spark, sf_dir):
    register(spark, sf_dir, "route_alternative")
    return spark.table("route_alternative").select("request_id", "alt", eta_minutes(F.col("duration_s"), F.col("distance_m")).alias("minutes"))


#: Alternatives nearer to each other than these metres and this safety are one.
SAME_M, SAME_SAFETY = 10.0, 0.03
#: Metres, safety and minutes within which a variant is the recommended route.
NEAR_M, NEAR_SAFETY, NEAR_MINUTES = 12.0, 0.04, 8.0


def variants(alternatives: DataFrame) -> DataFrame:
    """request_id, variant, alt: the shortest, safest and fastest of a request's alternatives (ties: the first), in this order, less those near the recommended one and those near one kept before.

    ``alternatives``: request_id, alt, distance_m, duration_s, risk (0 to 100), score (the least is recommended; nulls: none is). A request may be left without a row. Four aggregates a request with a map-side part, whatever the number of alternatives.
    """
    row = F.struct("alt", "distance_m", (1 - F.col("risk") / 100).alias("safety"), (F.col("duration_s") / 60).alias("minutes"))
    best = lambda c, name: F.struct(F.lit(name).alias("variant"), F.min_by(row, F.struct(c, "alt")).alias("r"))
    recommended = F.min_by(row, F.when(F.col("score").isNotNull(), F.struct("score", "alt"))).alias("best")
    chosen = alternatives.groupBy("request_id").agg(F.array(best("distance_m", "shortest"), best("risk", "safest"), best("duration_s", "fastest")).alias("v"), recommended)
    apart = lambda c, x: F.abs(F.col("best")[c] - x["r"][c])
    as_best = lambda x: F.coalesce((apart("distance_m", x) < NEAR_M) & (apart("safety", x) < NEAR_SAFETY) & (apart("minutes", x) < NEAR_MINUTES), F.lit(False))
    chosen = chosen.withColumn("v", F.filter("v", lambda x: (x["r"]["distance_m"] > 0) & ~as_best(x)))
    near = lambda a, b: (F.abs(a["r"]["distance_m"] - b["r"]["distance_m"]) < SAME_M) & (F.abs(a["r"]["safety"] - b["r"]["safety"]) < SAME_SAFETY)
    kept = F.aggregate("v", F.filter("v", lambda _: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda k: near(k, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return chosen.select("request_id", F.explode(kept).alias("k")).select("request_id", "k.variant", F.col("k.r.alt").alias("alt"))


_SCORE = "distance_m / 1000 * 0.6e0 + risk / 30 * 2 + obstacle * 1.2e0"


@query("graph_variants", with_views(f"""with a as (select *, 1 - risk / 100 as safety, duration_s / 60 as minutes, round({_SCORE}, 9) as score from route_alternative),
b as (select request_id, arg_min(alt, (distance_m, alt)) as a0, arg_min(alt, (risk, alt)) as a1, arg_min(alt, (duration_s, alt)) as a2, arg_min(alt, (score, alt)) as best from a group by request_id),
c as (select request_id, best, unnest([0, 1, 2]) as k, unnest([a0, a1, a2]) as alt from b),
d as (select c.request_id, k, c.alt, x.distance_m, x.safety from c join a x on x.request_id = c.request_id and x.alt = c.alt join a r on r.request_id = c.request_id and r.alt = c.best
 where not (abs(x.distance_m - r.distance_m) < 12 and abs(x.safety - r.safety) < 0.04e0 and abs(x.minutes - r.minutes) < 8)),
n as (select p.request_id, p.k, p.alt, max(q.k = 0) as n0, max(q.k = 1) as n1 from d p left join d q on q.request_id = p.request_id and q.k < p.k and abs(p.distance_m - q.distance_m) < 10 and abs(p.safety - q.safety) < 0.03e0 group by 1, 2, 3),
o as (select n.*, coalesce(m.n0, false) as second_gone from n left join n m on m.request_id = n.request_id and m.k = 1)
select request_id, ['shortest', 'safest', 'fastest'][k + 1] as variant, alt from o where not coalesce(n0, false) and not (coalesce(n1, false) and not second_gone)"""))
def graph_variants(spark, sf_dir):
    """The distinct variants of every request's alternatives."""
    register(spark, sf_dir, "route_alternative")
    return variants(spark.table("route_alternative").withColumn("score", F.round(F.expr(_SCORE), 9)))
