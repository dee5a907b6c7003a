"""Accessibility profiles of all places and ways of the given tables, what they lack, and what verified reports add."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions.profile import ENTRANCE, EVIDENCE, PATH, RESTROOM, UPDATE_PHOTO, made, merged, type_of, with_profile
from stepfree.registry import query
from stepfree.shared import dealt
from stepfree.views import register, with_views

NOW = "2026-01-20 12:00:00"

#: Tags of every place (from ``asset``) and way (from ``edge``) as columns, the same text for both engines; "__" stands for ":".
_PLACE = """select id * 2 as place_id, asset_type, case when asset_type like 'amenity%' then 'toilets' end as amenity, case when asset_type like 'railway%' then 'station' end as railway,
  case when asset_type like 'highway%' then 'elevator' end as highway, case when asset_type like 'barrier%' then 'kerb' end as barrier, case when balance < 0 then 'no' when balance > 5000 then 'Yes' when balance > 4000 then ' ' end as wheelchair,
  case when balance > 6000 then '0,9 m' when balance > 2000 then '85 cm' end as door__width, case when balance > 7000 then '2026-01-05' when balance > 4500 then '2024-07' when balance > 3000 then '2021' when balance > 2500 then 'soon' end as check_date,
  case when balance > 8000 then 'https://img.example/a.jpg' end as image, case when balance > 9000 then 'k 1' end as mapillary, case when balance > 1000 then 'yes' when balance > 0 then 'no' end as toilets__wheelchair,
  case when balance > 7500 then 'yes' end as changing_table, name, null as surface, null as smoothness, null as width, null as kerb__height, null as incline, null as lit, null as crossing from asset
union all select id * 2 + 1, case when has_stairs then 'highway:steps' else 'highway:footway' end, null, null, case when has_stairs then 'steps' else 'footway' end, case when has_barrier then 'gate' end, null,
  null, null, null, null, null, null, null, case when surface <> 'unknown' then surface end, smoothness, case when width_m is not null then concat(cast(cast(round(width_m * 100) as bigint) as varchar(9)), ' cm') end,
  case when kerb_height > 0 then concat(cast(cast(round(kerb_height * 1000) as bigint) as varchar(9)), 'mm') end, case when is_steep then '9 %' end, case when lighting > 0.9e0 then 'yes' when lighting < 0.2e0 then 'no' end, case when has_crossing then 'marked' end from edge"""
TAGS = (
    "amenity", "railway", "highway", "barrier", "wheelchair", "door__width", "check_date", "image", "mapillary", "toilets__wheelchair", "changing_table", "name", "surface", "smoothness", "width",
    "kerb__height", "incline", "lit", "crossing",
)


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset_id, asset_type, tags, observed_at (none) of all places and ways."""
    register(spark, sf_dir, "asset", "edge")
    tags = F.create_map(*[x for c in TAGS for x in (F.lit(c.replace("__", ":")), F.col(c))])
    return dealt(spark.sql(_PLACE), "place_id").select(F.col("place_id").alias("asset_id"), "asset_type", F.map_filter(tags, lambda k, v: v.isNotNull()).alias("tags"), F.lit(None).cast("timestamp").alias("observed_at"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_profile(places(spark, sf_dir), F.lit(NOW).cast("timestamp"))


# The same from the columns that the tags were made of.
_GAPS = """case when check_date is null or check_date = 'soon' then 'last_verified_at' end"""
_WALK = "(asset_type like 'highway:%' or asset_type like 'barrier:%')"
_BUILT = "(asset_type like 'amenity:%' or asset_type like 'railway:%' or asset_type = 'highway:elevator')"
_ROOM = "(asset_type = 'amenity:toilets' or toilets__wheelchair is not null)"
_MISSING = f"""list_sort(list_filter([{_GAPS}, case when {_WALK} and surface is null then 'surface' end, case when {_WALK} and smoothness is null then 'smoothness' end, case when {_WALK} and width is null then 'width_metres' end,
 case when {_WALK} and kerb__height is null then 'kerb' end, case when {_WALK} then 'tactile_paving' end, case when {_WALK} and incline is null then 'incline_percent' end, case when {_BUILT} or door__width is not null then 'entrance' end,
 case when {_BUILT} and door__width is null then 'door_width_metres' end, case when ({_BUILT} or door__width is not null) and wheel is null then 'wheelchair_access' end, case when {_ROOM} and coalesce(toilets__wheelchair, wheel) is null then 'toilets_wheelchair_access' end,
 case when {_ROOM} and door__width is null then 'toilets_door_width_metres' end, case when {_ROOM} then 'toilets_grab_bars' end, case when {_ROOM} and changing_table is null then 'changing_table' end], lambda x: x is not null))"""
_FOUND = [c for c in TAGS if c.replace("__", ":") in EVIDENCE and c != "wheelchair"]
_PROFILE = f"""p as ({_PLACE}), q as (select *, nullif(lower(trim(wheelchair)), '') as wheel, case check_date when '2026-01-05' then 15.5e0 when '2024-07' then 568.5e0 when '2021' then 1845.5e0 end as age from p),
m as (select *, {_MISSING} as missing, {' + '.join(f'({c} is not null)::int' for c in (*_FOUND, 'wheel'))} as known, {' + '.join(f'({c} is not null)::int' for c in (*[t for t in TAGS if t != 'wheelchair'], 'wheel'))} as n_tags from q),
u as (select *, round(1000000 * (0.10e0 + 0.65e0 * (case when known + len(missing) > 0 then known::double / (known + len(missing)) else 0e0 end) + case when age is null then 0e0 when age <= 365 then 0.2e0 when age <= 1095 then 0.1e0 else 0.04e0 end
 + case when image is not null or mapillary is not null then 0.1e0 else 0e0 end + least(0.1e0, n_tags / 100e0)))::bigint as u from m),
s as (select *, least(0.99e0, greatest(0.05e0, (u // 1000 + if(u % 1000 > 500 or (u % 1000 = 500 and (u // 1000) % 2 = 1), 1, 0)) / 1000e0)) as confidence from u)"""


@query("arr_missing_fields", with_views(f"with {_PROFILE} select place_id, array_to_string(missing, ';') as missing, len(missing)::int as n from s"))
def arr_missing_fields(spark, sf_dir):
    """What the tags of every place and way leave open, by its kind."""
    return profiles(spark, sf_dir).select(F.col("asset_id").alias("place_id"), F.array_join("profile.missing_fields", ";").alias("missing"), F.size("profile.missing_fields").alias("n"))


@query("map_evidence", with_views(f"with {_PROFILE}, e as (select place_id, unnest([{', '.join(repr(c.replace('__', ':')) for c in (*_FOUND, 'wheelchair'))}]) as tag, unnest([{', '.join(_FOUND)}, trim(wheelchair)]) as value from s) select * from e where value <> ''"))
def map_evidence(spark, sf_dir):
    """The tags of every place and way that count as evidence, a row each."""
    return profiles(spark, sf_dir).select(F.col("asset_id").alias("place_id"), F.explode("profile.evidence_tags").alias("tag", "value"))


_DIGEST = """place_id, confidence, status, surface, round(width_metres, 3) as width_metres, round(kerb_height_metres, 3) as kerb_height_metres, step_free, stairs, barrier, incline_percent, lighting, round(door_width, 3) as door_width,
 toilet_wheelchair, photos, last_photo, missing"""


@query("profile_build", with_views(f"""with {_PROFILE}, d as (select place_id, confidence, case when age > 1095 then 'stale' when age is not null and confidence >= 0.75e0 then 'verified' when confidence >= 0.4e0 then 'partial' else 'unverified' end as status,
 surface, replace(width, ' cm', '')::double / 100 as width_metres, case when barrier = 'kerb' then 0.1e0 else replace(kerb__height, 'mm', '')::double / 1000 end as kerb_height_metres,
 case when wheel is not null then wheel = 'yes' when highway = 'steps' or barrier is not null or replace(kerb__height, 'mm', '')::int > 30 then false end as step_free, coalesce(highway = 'steps', false) as stairs, barrier is not null as barrier,
 case when incline is not null then 9e0 end as incline_percent, lit as lighting, case when {_BUILT} or door__width is not null then case door__width when '0,9 m' then 0.9e0 when '85 cm' then 0.85e0 end end as door_width,
 case when {_ROOM} then coalesce(toilets__wheelchair, wheel) = 'yes' end as toilet_wheelchair, (image is not null)::int + (mapillary is not null)::int as photos,
 case when mapillary is not null then 'https://www.mapillary.com/app/?pKey=k%201' else image end as last_photo, array_to_string(missing, ';') as missing from s) select {_DIGEST} from d"""))
def profile_build(spark, sf_dir):
    """The whole profile of every place and way; its main fields as columns."""
    p = F.col("profile")
    door, room = F.get(p["entrances"], F.lit(0)), F.get(p["restrooms"], F.lit(0))
    columns = {
        "place_id": F.col("asset_id"), "confidence": p["confidence"], "status": p["verification_status"], "surface": p["path"]["surface"], "width_metres": p["path"]["width_metres"], "kerb_height_metres": p["path"]["kerb_height_metres"],
        "step_free": p["path"]["has_step_free_access"], "stairs": p["path"]["has_stairs"], "barrier": p["path"]["has_barrier"], "incline_percent": p["path"]["incline_percent"], "lighting": p["path"]["lighting"],
        "door_width": door["door_width_metres"], "toilet_wheelchair": room["wheelchair_accessible"], "photos": F.size(p["photos"]), "last_photo": F.try_element_at(p["photos"], F.lit(-1))["url"],
        "missing": F.array_join(p["missing_fields"], ";"),
    }
    rounded = ("width_metres", "kerb_height_metres", "door_width")
    return profiles(spark, sf_dir).select(*[(F.round(c, 3) if name in rounded else c).alias(name) for name, c in columns.items()])


#: Verified reports, each about one place; what they say of it follows from their type.
_UPDATE = """select h.id as update_id, h.hazard_type, case when h.amount > 40 then h.reported_at end as observed_at, h.reporter, h.amount, (h.id * 7 + h.reporter) % k.n as nth from hazard h cross join (select count(*) as n from asset) k where h.status in ('verified', 'resolved')"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """update_id, asset_id, source, observed_at, path, entrance, restroom, photos of all verified reports."""
    register(spark, sf_dir, "asset", "hazard")
    asset = spark.table("asset").select((F.col("id") * 2).alias("asset_id"), (F.col("id") - 1).alias("nth"))
    kind = F.col("hazard_type")
    path = made(PATH, {
        "surface": F.when(kind == "gravel", "gravel"), "smoothness": F.when(kind == "pothole", "bad"), "lighting": F.when(kind == "poor-lighting", "no"), "has_curb_ramp": F.when(kind == "missing curb ramp", False),
        "width_metres": F.when(kind == "unknown thing", F.col("amount") / 100),
    })
    door = F.when(kind == "pothole", made(ENTRANCE, {"door_width_metres": F.col("amount") / 50}))
    photo = F.when(F.col("amount") > 60, F.array(made(UPDATE_PHOTO, {"url": F.concat(F.lit("https://IMG.example/"), (F.col("reporter") % 3).cast("string")), "source": F.lit(" ")})))
    rows = spark.sql(_UPDATE).join(asset, "nth")
    return rows.select(
        "update_id", "asset_id", F.lit("survey").alias("source"), "observed_at", path.alias("path"), door.alias("entrance"), F.lit(None).cast(type_of(RESTROOM)).alias("restroom"),
        F.coalesce(photo, F.array().cast(f"array<{type_of(UPDATE_PHOTO)}>")).alias("photos"),
    )


_LAST = "arg_max({v}, (observed_at is not null, coalesce(observed_at, timestamp '1970-01-01'), update_id)) filter (where {w})"
_limited = lambda x, low, high: f"round(greatest({low}e0, least({high}e0, {x})), 3)"


@query("join_merge_profile", with_views(f"""with {_PROFILE}, w as (select u.*, a.id * 2 as asset_id from ({_UPDATE}) u join asset a on a.id - 1 = u.nth),
g as (select asset_id, max(observed_at) as seen, {_LAST.format(v="'gravel'", w="hazard_type = 'gravel'")} as surface, {_LAST.format(v="'bad'", w="hazard_type = 'pothole'")} as smoothness,
 {_LAST.format(v="'no'", w="hazard_type = 'poor-lighting'")} as lighting, max(hazard_type = 'missing curb ramp') as no_ramp, {_LAST.format(v='amount / 100', w="hazard_type = 'unknown thing' and amount is not null")} as width,
 max(hazard_type = 'pothole') as door, {_LAST.format(v='amount / 50', w="hazard_type = 'pothole' and amount is not null")} as door_width, count(distinct case when amount > 60 then reporter % 3 end) as photos from w group by asset_id),
j as (select s.place_id, s.confidence as before, s.missing as gaps_before, g.asset_id is not null as touched, g.surface, g.smoothness, g.lighting, case when g.width is not null then {_limited('g.width', 0.3, 10)} end as width_metres,
 case when g.door_width is not null then {_limited('g.door_width', 0.3, 3)} else case s.door__width when '0,9 m' then 0.9e0 when '85 cm' then 0.85e0 end end as door_width, ({_BUILT} or s.door__width is not null) as had_door, had_door or coalesce(g.door, false) as has_door, {_ROOM} as has_room,
 (case when s.barrier = 'kerb' or g.no_ramp then 1 else 0 end) as kerb, s.wheel, s.barrier, s.toilets__wheelchair, s.changing_table, s.door__width, (s.image is not null)::int + (s.mapillary is not null)::int + coalesce(g.photos, 0) as photos,
 coalesce(greatest(g.seen, case s.check_date when '2026-01-05' then timestamp '2026-01-05' when '2024-07' then timestamp '2024-07-01' when '2021' then timestamp '2021-01-01' end), timestamp '{NOW}') as verified from s left join g on g.asset_id = s.place_id where s.place_id % 2 = 0),
t as (select *, (surface is not null)::int + (smoothness is not null)::int + (width_metres is not null)::int + kerb + has_door::int * 2 + has_room::int * 3 as signals,
 list_sort(list_filter([case when surface is null then 'surface' end, case when smoothness is null then 'smoothness' end, case when width_metres is null then 'width_metres' end, case when kerb = 0 then 'kerb' end, 'tactile_paving', 'incline_percent',
 case when has_door and door_width is null then 'door_width_metres' end, case when has_door and (not had_door or (wheel is null and barrier is null)) then 'wheelchair_access' end, case when has_room and coalesce(toilets__wheelchair, wheel) is null then 'toilets_wheelchair_access' end,
 case when has_room and door__width is null then 'toilets_door_width_metres' end, case when has_room then 'toilets_grab_bars' end, case when has_room and changing_table is null then 'changing_table' end], lambda x: x is not null)) as gaps from j),
v as (select *, round(1000000 * (0.15e0 + 0.65e0 * signals / (signals + len(gaps)) + case when epoch(timestamp '{NOW}') - epoch(verified) <= 31536000 then 0.2e0 else 0.05e0 end + least(0.1e0, photos * 0.05e0)))::bigint as u from t)
select place_id, touched, surface, smoothness, lighting, width_metres, round(door_width, 3) as door_width, photos::int as photos,
 case when touched then greatest(before, least(0.99e0, (u // 1000 + if(u % 1000 > 500 or (u % 1000 = 500 and (u // 1000) % 2 = 1), 1, 0)) / 1000e0)) else before end as confidence, array_to_string(case when touched then gaps else gaps_before end, ';') as missing from v"""))
def join_merge_profile(spark, sf_dir):
    """Profiles of all places with the verified reports laid over them."""
    current = profiles(spark, sf_dir).where("asset_id % 2 = 0").select("asset_id", "profile")
    p = F.col("profile")
    out = merged(current, updates(spark, sf_dir), F.lit(NOW).cast("timestamp"))
    return out.select(
        F.col("asset_id").alias("place_id"), "touched", *[p["path"][c].alias(c) for c in ("surface", "smoothness", "lighting", "width_metres")], F.round(F.get(p["entrances"], F.lit(0))["door_width_metres"], 3).alias("door_width"),
        F.size(p["photos"]).alias("photos"), p["confidence"].alias("confidence"), F.array_join(p["missing_fields"], ";").alias("missing"),
    )
