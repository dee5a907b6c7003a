"""Filters, predicates and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions import cost, geo, risk
from stepfree.functions import sqltext as sql
from stepfree.registry import query
from stepfree.sources.osm import walkable
from stepfree.views import register, with_views

CENTRE = (52.48, -1.91)


def in_bbox(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inclusive envelope; the bounds are checked here, before any job runs."""
    if not (-90 <= south <= north <= 90 and -180 <= west <= east <= 180):
        raise ValueError("bounding box is out of range or turned over")
    return lat.between(south, north) & lon.between(west, east)


def in_radius(df: DataFrame, lat: float, lon: float, metres: float) -> DataFrame:
    """Rows within ``metres`` of a point: an envelope that scans can push down, then the exact distance."""
    dlat = metres / geo.DEGREE_M
    from math import cos, radians

    dlon = metres / (geo.DEGREE_M * max(0.1, cos(radians(lat))))
    box = F.col("lat").between(lat - dlat, lat + dlat) & F.col("lon").between(lon - dlon, lon + dlon)
    distance = geo.haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon"))
    return df.where(box).withColumn("distance_m", distance).where(F.col("distance_m") <= metres)


def hazards(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "hazard")
    return spark.table("hazard")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    register(spark, sf_dir, "edge")
    return spark.table("edge")


@query("scan_table", with_views("select id, hazard_type, status, reporter from hazard where source = 'osm'"))
def scan_table(spark, sf_dir):
    return hazards(spark, sf_dir).where("source = 'osm'").select("id", "hazard_type", "status", "reporter")


@query("filter_active", with_views("select id, status from hazard where status in ('reported', 'under_review')"))
def filter_active(spark, sf_dir):
    return hazards(spark, sf_dir).where(risk.is_active(F.col("status"))).select("id", "status")


@query("filter_bbox", with_views("select id, round(lat, 6) as lat, round(lon, 6) as lon from hazard where lat between 52.47e0 and 52.49e0 and lon between -1.93e0 and -1.90e0"))
def filter_bbox(spark, sf_dir):
    df = hazards(spark, sf_dir).where(in_bbox(F.col("lat"), F.col("lon"), 52.47, -1.93, 52.49, -1.90))
    return df.select("id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("filter_radius", with_views(f"select id, round({sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')}, 4) as distance_m from hazard where {sql.haversine('52.48e0', '-1.91e0', 'lat', 'lon')} <= 800"))
def filter_radius(spark, sf_dir):
    return in_radius(hazards(spark, sf_dir), *CENTRE, 800.0).select("id", F.round("distance_m", 4).alias("distance_m"))


@query("filter_null_geom", with_views("select id from (select id, case when id % 5 = 0 then null else lat end as lat from hazard) where lat is not null"))
def filter_null_geom(spark, sf_dir):
    df = hazards(spark, sf_dir).withColumn("lat", F.when(F.col("id") % 5 != 0, F.col("lat")))
    return df.where(F.col("lat").isNotNull()).select("id")


def matches(text: str, *columns: str) -> Column:
    """Substring search over columns: the text is trimmed, cut to 80 characters and compared in lower case."""
    needle = text.strip()[:80].lower()
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False))
    return found


@query("filter_search", with_views("select id, hazard_type from hazard where lower(hazard_type) like '%curb%' or lower(source) like '%curb%'"))
def filter_search(spark, sf_dir):
    return hazards(spark, sf_dir).where(matches("  CURB ", "hazard_type", "source")).select("id", "hazard_type")


_FRIENDLY = f"""not has_stairs and not has_barrier and not {sql.blocked('access')} and kerb_height <= {{kerb}} and (width_m is null or width_m >= 0.9e0)
  and coalesce(smoothness, '') not in ({sql.quoted(cost.ROUGH)}) and surface not in ({sql.quoted(cost.LOOSE)})"""


@query(
    "filter_profile",
    with_views(
        f"""select id, 'manual-wheelchair' as profile from edge where {_FRIENDLY.format(kerb='0.03e0')} and surface not in ('cobblestone', 'sett')
 union all select id, 'power-wheelchair' from edge where {_FRIENDLY.format(kerb='0.05e0')} union all select id, 'stroller' from edge where {_FRIENDLY.format(kerb='0.05e0')}"""
    ),
)
def filter_profile(spark, sf_dir):
    """Edges that each wheeled profile may use."""
    df = edges(spark, sf_dir)
    columns = {c: F.col(c) for c in df.columns}
    fits = [F.when(cost.wheel_friendly(limit, columns, cobbles), profile) for profile, (limit, cobbles) in cost.WHEEL_RULES.items()]
    return df.select("id", F.explode(F.array_compact(F.array(*fits))).alias("profile"))


#: Preference -> edges that it allows; names without an entry allow all.
PREFERENCE_FILTERS = {
    "avoid-stairs": "not has_stairs",
    "wheelchair": "not has_stairs and surface not in ('cobblestone', 'gravel')",
    "avoid-cobblestone": "surface <> 'cobblestone'",
    "avoid-construction": "not is_under_construction",
    "avoid-steep-hills": "not is_steep",
}


def allowed(preferences: list[str]) -> Column:
    """All of the preferences' filters at once."""
    out = F.lit(True)
    for name in preferences:
        if name in PREFERENCE_FILTERS:
            out = out & F.expr(PREFERENCE_FILTERS[name])
    return out


@query("filter_preference", with_views("select id from edge where not has_stairs and not is_steep and surface <> 'cobblestone'"))
def filter_preference(spark, sf_dir):
    return edges(spark, sf_dir).where(allowed(["avoid-stairs", "avoid-steep-hills", "avoid-cobblestone", "prefer-crossings"])).select("id")


@query("filter_relaxed", with_views(f"select id from edge where not {sql.blocked('access', wheels=False)}"))
def filter_relaxed(spark, sf_dir):
    return edges(spark, sf_dir).where(~cost.access_blocked(F.col("access"), wheels=False)).select("id")


#: Tags of made ways, the same text for both engines.
_WAY_TAGS = """select id, case id % 9 when 0 then 'footway' when 1 then 'motorway' when 2 then 'steps' when 3 then 'Residential' when 4 then 'trunk_link' when 5 then 'crossing' when 6 then 'cycleway' when 7 then 'bridleway' end as highway,
 case id % 7 when 0 then 'no' when 1 then 'yes' when 2 then 'designated' end as foot, case id % 11 when 0 then 'private' when 1 then 'no' when 2 then 'yes' end as access,
 case id % 13 when 0 then 'wall' when 1 then 'fence' when 2 then 'kerb' end as barrier from node"""


@query("filter_walkable", with_views(f"""select id from ({_WAY_TAGS}) where highway is not null and highway not in ('motorway', 'trunk_link') and coalesce(foot, '') <> 'no'
 and (coalesce(access, '') not in ('no', 'private') or coalesce(foot, '') = 'yes') and coalesce(barrier, '') not in ('wall', 'fence')
 and (lower(highway) in ('footway', 'steps', 'residential', 'crossing') or coalesce(foot, '') in ('yes', 'designated'))"""))
def filter_walkable(spark, sf_dir):
    """Ways that people walk on, by their tags."""
    register(spark, sf_dir, "node")
    ways = spark.sql(_WAY_TAGS)
    tags = F.map_filter(F.create_map(*[x for k in ("highway", "foot", "access", "barrier") for x in (F.lit(k), F.col(k))]), lambda k, v: v.isNotNull())
    return ways.where(walkable(tags)).select("id")


@query("filter_bidirectional", with_views("select id, not (id % 4 = 0 or id % 6 = 0) as both_ways from node"))
def filter_bidirectional(spark, sf_dir):
    """Ways open in both directions: neither oneway:foot=yes nor foot:backward=no."""
    register(spark, sf_dir, "node")
    tags = F.create_map(F.lit("oneway:foot"), F.when(F.col("id") % 4 == 0, "yes").otherwise("no"), F.lit("foot:backward"), F.when(F.col("id") % 6 == 0, "no").otherwise("yes"))
    ways = spark.table("node").select("id", tags.alias("tags"))
    return ways.select("id", ~((F.col("tags")["oneway:foot"] == "yes") | (F.col("tags")["foot:backward"] == "no")).alias("x")).toDF("id", "both_ways")


#: A request breaks a rule where its text is true or null; the names are the reasons given.
REQUEST_RULES = {
    "start_longitude": "start_lon between -180 and 180",
    "start_latitude": "start_lat between -90 and 90",
    "end_longitude": "end_lon between -180 and 180",
    "end_latitude": "end_lat between -90 and 90",
    "safety_weight": "weight between 0 and 1",
    "profile": "profile in ('standard', 'manual-wheelchair', 'power-wheelchair', 'stroller')",
}
_ASKED = """select id, case when id % 41 > 0 then (start_node % 380) - 190e0 end as start_lon, (start_node % 200) - 100e0 as start_lat, (end_node % 380) - 190e0 as end_lon,
 case when id % 43 > 0 then (end_node % 200) - 100e0 end as end_lat, safety_weight * 1.2e0 - 0.1e0 as weight, case id % 9 when 0 then '' when 1 then 'bicycle' when 2 then null else profile end as profile from request"""


@query(
    "validate_request",
    with_views(f"""with a as ({_ASKED}), r as (select id, (case when start_lon >= -180 and start_lon <= 180 then '' else 'start_longitude;' end) || (case when abs(start_lat) <= 90 then '' else 'start_latitude;' end)
 || (case when abs(end_lon) <= 180 then '' else 'end_longitude;' end) || (case when abs(end_lat) <= 90 then '' else 'end_latitude;' end) || (case when weight < 0 or weight > 1 then 'safety_weight;' else '' end)
 || (case when profile like '%wheelchair' or profile in ('standard', 'stroller') then '' else 'profile;' end) as reasons from a) select id, reasons from r where reasons <> ''"""),
)
def validate_request(spark, sf_dir):
    """Requests that break a rule, with the names of the rules: coordinates present and in range, weight from 0 to 1, a known profile."""
    register(spark, sf_dir, "request")
    reasons = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(f"{name};")) for name, rule in REQUEST_RULES.items()]))
    return spark.sql(_ASKED).withColumn("r", reasons).where(F.size("r") > 0).select("id", F.array_join("r", "").alias("reasons"))


@query(
    "proj_feed",
    with_views("select id, initcap_text as title, status, strftime(reported_at, '%Y-%m-%dT%H:%M:%S') as at from (select *, upper(substr(hazard_type, 1, 1)) || substr(hazard_type, 2) as initcap_text from hazard)"),
)
def proj_feed(spark, sf_dir):
    title = F.concat(F.upper(F.substring("hazard_type", 1, 1)), F.expr("substr(hazard_type, 2)"))
    return hazards(spark, sf_dir).select("id", title.alias("title"), "status", F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("proj_edge", with_views("select e.id, e.src, e.dst, round(e.dist, 3) as dist, e.surface, e.lighting from edge e"))
def proj_edge(spark, sf_dir):
    return edges(spark, sf_dir).select("id", "src", "dst", F.round("dist", 3).alias("dist"), "surface", "lighting")


@query("clamp", with_views("select id, round(least(1e0, greatest(0.2e0, safety_weight)), 6) as weight from request"))
def clamp(spark, sf_dir):
    register(spark, sf_dir, "request")
    return spark.table("request").select("id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.col("safety_weight"))), 6).alias("weight"))


@query(
    "overpass_bbox_query",
    with_views("select id, surface from edge where surface in ('unpaved', 'gravel', 'cobblestone', 'mud', 'dirt') or has_barrier or has_stairs"),
)
def overpass_bbox_query(spark, sf_dir):
    rough = F.col("surface").rlike("unpaved|gravel|cobblestone|mud|dirt")
    return edges(spark, sf_dir).where(rough | F.col("has_barrier") | F.col("has_stairs")).select("id", "surface")


@query("overpass_infra_query", with_views("select distinct src, dst from edge where has_stairs or has_crossing or lighting > 0.5e0"))
def overpass_infra_query(spark, sf_dir):
    return edges(spark, sf_dir).where(F.col("has_stairs") | F.col("has_crossing") | (F.col("lighting") > 0.5)).select("src", "dst").distinct()
