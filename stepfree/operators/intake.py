"""Submissions, tags and coordinates as they come in, shard regions, alternatives and held alerts."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from stepfree.registry import query
from stepfree.views import register, with_views

PATHS = """select id, surface, smoothness, width_m as width_metres, case when has_crossing then kerb_height end as kerb_height_metres,
  case when lighting > 0.5e0 then has_stairs end as curb_ramp, case when is_steep then 7.5e0 end as incline_percent, case when has_barrier then false end as tactile_paving,
  case when has_stairs then false end as step_free_access, case when is_under_construction then 'main' end as entrance, case when access = 'access=no' then true end as restroom,
  case when access is null then 0 else id % 4 end as photos,
  case when lighting < 0.3e0 then timestamp '2024-01-01 00:00:00' when lighting < 0.5e0 then timestamp '2020-01-01 00:00:00' end as observed_at from edge"""


def submitted(spark, sf_dir) -> DataFrame:
    register(spark, sf_dir, "edge")
    return spark.sql(PATHS)


def known(*columns: str) -> Column:
    """1 where one of the columns has a value, else 0."""
    return F.when(reduce(or_, [F.col(c).isNotNull() for c in columns]), 1).otherwise(0)


def path_signals() -> Column:
    return known("surface") + known("smoothness") + known("width_metres") + known("kerb_height_metres", "curb_ramp") + known("incline_percent") + known("tactile_paving")


_SIGNALS = "((surface is not null)::int + (smoothness is not null)::int + (width_metres is not null)::int + (kerb_height_metres is not null or curb_ramp is not null)::int + (incline_percent is not null)::int + (tactile_paving is not null)::int)"


@query("conf_submission", with_views(f"with p as ({PATHS}) select id, round(least(0.95e0, 0.25e0 + 0.055e0 * ({_SIGNALS} + (step_free_access is not null)::int + 2 * (entrance is not null)::int + 3 * (restroom is not null)::int + 2 * (photos > 0)::int + (observed_at is not null)::int)), 3) as confidence from p"))
def conf_submission(spark, sf_dir):
    """0.25 and 0.055 a signal, 0.95 at most."""
    signals = path_signals() + known("step_free_access") + 2 * known("entrance") + 3 * known("restroom") + F.when(F.col("photos") > 0, 2).otherwise(0) + known("observed_at")
    return submitted(spark, sf_dir).select("id", F.round(F.least(F.lit(0.95), F.lit(0.25) + F.lit(0.055) * signals), 3).alias("confidence"))


@query("conf_verification", with_views(f"""with p as ({PATHS}), s as (select *, {_SIGNALS} as path from p)
select id, round(least(0.99e0, 0.15e0 + 0.65e0 * ((path + 2 * (entrance is not null)::int + 3 * (restroom is not null)::int) / (6e0 + 2 * (entrance is not null)::int + 3 * (restroom is not null)::int))
  + case when observed_at >= timestamp '2023-06-02 00:00:00' then 0.2e0 else 0.05e0 end + least(0.1e0, photos * 0.05e0)), 3) as confidence from s"""))  # fmt: skip
def conf_verification(spark, sf_dir):
    """Completeness of the six path fields with entrances (2) and restrooms (3), freshness within 365 days of 1 June 2024, photos."""
    found = path_signals() + 2 * known("entrance") + 3 * known("restroom")
    whole = found + (F.lit(6) - path_signals())
    fresh = F.when(F.col("observed_at") >= F.lit("2024-06-01").cast("timestamp") - F.expr("interval 365 days"), 0.2).otherwise(0.05)
    score = F.lit(0.15) + F.lit(0.65) * (found / whole) + fresh + F.least(F.lit(0.1), F.col("photos") * F.lit(0.05))
    return submitted(spark, sf_dir).select("id", F.round(F.least(F.lit(0.99), score), 3).alias("confidence"))


UPDATED = ("curb_ramp", "entrance", "incline_percent", "kerb_height_metres", "smoothness", "step_free_access", "surface", "tactile_paving", "width_metres")


@query("arr_updated_fields", with_views(f"with p as ({PATHS}) select id, concat_ws(',', {', '.join(f"case when {c} is not null then '{c}' end" for c in UPDATED[:4])}, case when photos > 0 then 'photos' end, {', '.join(f"case when {c} is not null then '{c}' end" for c in UPDATED[4:])}) as fields from p"))
def arr_updated_fields(spark, sf_dir):
    """Names of the fields that a submission fills, in order of the names."""
    names = F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in UPDATED], F.when(F.col("photos") > 0, F.lit("photos")))
    return submitted(spark, sf_dir).select("id", F.array_join(F.array_sort(F.array_compact(names)), ",").alias("fields"))


PHOTOS = """select c_custkey as id, c_nationkey as place, concat(case c_custkey % 5 when 0 then 'https://photos.example/' when 1 then 'HTTPS://Photos.example/' when 2 then 'ftp://photos.example/'
  when 3 then 'photos/' else ' http://photos.example/' end, c_custkey % 40, case when c_custkey % 5 = 4 then ' ' else '' end) as url from customer"""


@query("filter_url", f"""with p as (select id, place, trim(url) as url from ({PHOTOS}) where lower(trim(url)) like 'http://_%' or lower(trim(url)) like 'https://_%'),
f as (select * from p qualify row_number() over (partition by place, lower(url) order by id) = 1) select id, place, url from f qualify row_number() over (partition by place order by id) <= 10""")  # fmt: skip
def filter_url(spark, sf_dir):
    """Absolute http(s) addresses, the first of those equal but for case, ten a place."""
    register(spark, sf_dir, "customer")
    urls = spark.sql(PHOTOS).withColumn("url", F.trim("url")).where(F.col("url").rlike(r"(?i)^https?://[^/?#\s]"))
    once = urls.groupBy("place", F.lower("url").alias("low")).agg(F.min(F.struct("id", "url")).alias("first")).select("first.id", "place", "first.url")
    return once.withColumn("n", F.row_number().over(Window.partitionBy("place").orderBy("id"))).where("n <= 10").drop("n")


@query("win_similarity_dedupe", with_views("""with a as (select request_id, alt, distance_m, 1 - risk / 100 as safety from route_alternative),
c as (select x.request_id, max(case when x.alt = 0 and y.alt = 1 then 1 else 0 end) as c01, max(case when x.alt = 0 and y.alt = 2 then 1 else 0 end) as c02, max(case when x.alt = 1 and y.alt = 2 then 1 else 0 end) as c12
  from a x join a y on x.request_id = y.request_id and x.alt < y.alt and abs(x.distance_m - y.distance_m) < 10 and abs(x.safety - y.safety) < 0.03e0 group by x.request_id)
select a.request_id, alt from a left join c on a.request_id = c.request_id where alt = 0 or (alt = 1 and coalesce(c01, 0) = 0) or (alt = 2 and coalesce(c02, 0) = 0 and (coalesce(c12, 0) = 0 or c01 = 1))"""))  # fmt: skip
def win_similarity_dedupe(spark, sf_dir):
    """Alternatives in order, less those within 10 m and 0.03 of safety of one kept before; a request has three at most."""
    register(spark, sf_dir, "route_alternative")
    variant = F.struct("alt", "distance_m", (F.lit(1) - F.col("risk") / 100).alias("safety"))
    groups = spark.table("route_alternative").groupBy("request_id").agg(F.array_sort(F.collect_list(variant)).alias("v"))
    near = lambda a, b: (F.abs(a["distance_m"] - b["distance_m"]) < 10) & (F.abs(a["safety"] - b["safety"]) < 0.03)
    kept = F.aggregate("v", F.filter("v", lambda _: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda r: near(r, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return groups.select("request_id", F.explode(kept).alias("k")).select("request_id", "k.alt")


SIZE, MOST = 0.02, 64
_BOX = """select r.id as request_id, least(a.lon, b.lon) as x0, least(a.lat, b.lat) as y0, greatest(a.lon, b.lon) as x1, greatest(a.lat, b.lat) as y1,
  greatest(0.01e0, 0.35e0 * greatest(abs(a.lat - b.lat), abs(a.lon - b.lon))) as pad from request r join node a on a.id = r.start_node join node b on b.id = r.end_node"""
_CELLS = f"""with box as ({_BOX}), c as (select request_id, x0 - pad as x0, y0 - pad as y0, x1 + pad as x1, y1 + pad as y1 from box),
g as (select *, floor(x0 / {SIZE}e0)::bigint as i0, floor(y0 / {SIZE}e0)::bigint as j0, ceil(x1 / {SIZE}e0)::bigint - 1 as i1, ceil(y1 / {SIZE}e0)::bigint - 1 as j1 from c),
f as (select request_id, i * {SIZE}e0 as min_lon, j * {SIZE}e0 as min_lat, (i + 1) * {SIZE}e0 as max_lon, (j + 1) * {SIZE}e0 as max_lat
  from (select *, unnest(range(j0, j1 + 1)) as j from (select *, unnest(range(i0, i1 + 1)) as i from g where (i1 - i0 + 1) * (j1 - j0 + 1) <= {MOST}))
  union all select request_id, x0, y0, x1, y1 from g where (i1 - i0 + 1) * (j1 - j0 + 1) > {MOST})"""


def shard_regions(spark, sf_dir, size: float = SIZE, most: int = MOST) -> DataFrame:
    """Grid cells that a request's padded box touches, or the box where it touches more than ``most``; requests with an unknown end have none."""
    register(spark, sf_dir, "request", "node")
    size = min(0.05, max(0.002, size))
    box = spark.sql(_BOX).select("request_id", *[(F.col(c) - F.col("pad")).alias(c) for c in ("x0", "y0")], *[(F.col(c) + F.col("pad")).alias(c) for c in ("x1", "y1")])
    low = lambda c: F.floor(F.col(c) / size)
    high = lambda c: F.ceil(F.col(c) / size) - 1
    box = box.withColumn("few", (high("x1") - low("x0") + 1) * (high("y1") - low("y0") + 1) <= most)
    cells = box.where("few").withColumn("i", F.explode(F.sequence(low("x0"), high("x1")))).withColumn("j", F.explode(F.sequence(low("y0"), high("y1"))))
    edge = lambda c, k, name: ((F.col(c) + k) * size).alias(name)
    cells = cells.select("request_id", edge("i", 0, "min_lon"), edge("j", 0, "min_lat"), edge("i", 1, "max_lon"), edge("j", 1, "max_lat"))
    return cells.unionByName(box.where("not few").select("request_id", F.col("x0").alias("min_lon"), F.col("y0").alias("min_lat"), F.col("x1").alias("max_lon"), F.col("y1").alias("max_lat")))


BOUNDS = ("min_lon", "min_lat", "max_lon", "max_lat")


@query("geo_shard_region", with_views(_CELLS + f" select request_id, {', '.join(f'round({c}, 6) as {c}' for c in BOUNDS)} from f"))
def geo_shard_region(spark, sf_dir):
    return shard_regions(spark, sf_dir).select("request_id", *[F.round(c, 6).alias(c) for c in BOUNDS])


#: Fixed values of the 64-bit FNV-1a hash: its start and its prime.
FNV_START, FNV_PRIME = 1469598103934665603, 1099511628211


@F.pandas_udf(StringType())
def fnv1a(values: pd.Series) -> pd.Series:
    """FNV-1a of whole numbers, eight bytes each from the lowest on, as sixteen hexadecimal digits. A batch's rows take each byte together, the longest first."""
    size = np.fromiter(map(len, values), np.int64, len(values))
    order = np.argsort(-size, kind="stable")
    flat = np.concatenate([np.zeros(0, "<i8"), *[np.asarray(v, "<i8") for v in values]]).view(np.uint8)
    start, longest = (8 * (np.cumsum(size) - size))[order], 8 * size[order]
    h = np.full(len(values), FNV_START, np.uint64)
    for k in range(int(longest.max(initial=0))):
        n = int(np.searchsorted(-longest, -k))  # rows that have a byte k
        h[:n] = (h[:n] ^ flat[start[:n] + k].astype(np.uint64)) * np.uint64(FNV_PRIME)
    out = np.empty(len(values), np.uint64)
    out[order] = h
    return pd.Series([f"{x:016x}" for x in out.tolist()], dtype=object)


_WHOLE = ", ".join(f"round_even({c} * 1000000, 0)::bigint" for c in BOUNDS)


@query("agg_fnv1a", with_views(_CELLS + f""", q as (select request_id, flatten(list([{_WHOLE}] order by min_lon, min_lat, max_lon, max_lat)) as v from f group by request_id),
b as (select request_id, flatten(list_transform(v, lambda x: list_transform(range(8), lambda k: ((x >> (8 * k)::bigint) & 255)::hugeint))) as bytes from q)
select request_id, lower(lpad(to_hex(list_reduce(list_prepend({FNV_START}::hugeint, bytes), lambda h, x: (xor(h, x) * {FNV_PRIME}::hugeint) % 18446744073709551616::hugeint)::ubigint), 16, '0')) as fingerprint from b"""))  # fmt: skip
def agg_fnv1a(spark, sf_dir):
    """Fingerprint of each request's regions, 64 at most, in order of their bounds."""
    sets = shard_regions(spark, sf_dir).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*BOUNDS))).alias("r"))
    whole = F.flatten(F.transform("r", lambda r: F.array(*[F.rint(r[c] * 1_000_000).cast("long") for c in BOUNDS])))
    return sets.select("request_id", fnv1a(whole).alias("fingerprint"))


TAGS = """select id, case when has_crossing then 'node' else 'way' end as element, case when has_barrier then 'cycle_barrier' end as barrier,
  case when has_stairs then 'steps' else 'footway' end as highway, case when surface <> 'unknown' then surface end as surface from edge"""


@query("str_hazard_from_osm", with_views(f"""with t as ({TAGS}), k as (select *, case when element = 'node' and barrier is not null then 1 when element = 'way' and highway = 'steps' then 2 when surface is not null then 3 else 4 end as k from t)
select id, case k when 1 then replace(barrier, '_', '-') when 2 then 'steps' when 3 then lower(replace(surface, '_', '-')) else case element when 'way' then 'path' else 'barrier' end end as type,
  case k when 1 then 'Barrier: ' || replace(barrier, '_', ' ') when 2 then 'Steps (may limit wheelchair access)' when 3 then 'Path surface: ' || replace(surface, '_', ' ') || ' (may affect accessibility)'
  else 'Accessibility-related feature from OpenStreetMap' end as description from k"""))  # fmt: skip
def str_hazard_from_osm(spark, sf_dir):
    """Type and description of a hazard from an element's tags: barrier nodes, then stairs, then surfaces."""
    register(spark, sf_dir, "edge")
    element, barrier, surface = F.col("element"), F.col("barrier"), F.col("surface")
    dashed = lambda c: F.lower(F.replace(c, F.lit("_"), F.lit("-")))
    spaced = lambda c: F.replace(c, F.lit("_"), F.lit(" "))
    at_node, steps = (element == "node") & barrier.isNotNull(), (element == "way") & (F.col("highway") == "steps")
    kind = F.when(at_node, dashed(barrier)).when(steps, "steps").when(surface.isNotNull(), dashed(surface)).when(element == "way", "path").otherwise("barrier")
    text = F.when(at_node, F.concat(F.lit("Barrier: "), spaced(barrier))).when(steps, "Steps (may limit wheelchair access)")
    text = text.when(surface.isNotNull(), F.concat(F.lit("Path surface: "), spaced(surface), F.lit(" (may affect accessibility)"))).otherwise("Accessibility-related feature from OpenStreetMap")
    return spark.sql(TAGS).select("id", kind.alias("type"), text.alias("description"))


JSON = """select id, case id % 6 when 0 then concat('{"x":', id, ',"y":-', id, '}') when 1 then concat('[', id, ',-', id, ']') when 2 then concat('{"type":"Point","coordinates":[', id, ',-', id, ']}')
  when 3 then concat('{"Lng":', id, ',"LAT":-', id, '}') when 4 then concat('{"longitude":', id, ',"latitude":-', id, '}') else concat('{"x":', id, '}') end as body from node"""


def json_number(body: Column, *paths: str) -> Column:
    """The first of the paths that holds a finite number; names in any case."""
    value = F.coalesce(*[F.get_json_object(F.lower(body), p).try_cast("double") for p in paths])
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


@query("json_coordinate", with_views("select id, case when id % 6 < 5 then id::double end as x, case when id % 6 < 5 then -id::double end as y from node"))
def json_coordinate(spark, sf_dir):
    """x and y of objects, pairs and GeoJSON points; null both where one is missing or not finite."""
    register(spark, sf_dir, "node")
    x = json_number(F.col("body"), "$.x", "$.lon", "$.lng", "$.longitude", "$.coordinates[0]", "$[0]")
    y = json_number(F.col("body"), "$.y", "$.lat", "$.latitude", "$.coordinates[1]", "$[1]")
    return spark.sql(JSON).select("id", F.when(y.isNotNull(), x).alias("x"), F.when(x.isNotNull(), y).alias("y"))


@query("date_utc", "select o_orderkey as id, (epoch(cast(o_orderdate as date)::timestamp) + 36900 - case when o_orderkey % 3 = 2 then 7200 else 0 end)::bigint as seconds from orders")
def date_utc(spark, sf_dir):
    """Seconds since 1970 of ISO times; those without a zone are UTC."""
    register(spark, sf_dir, "orders")
    texts = spark.sql("select o_orderkey as id, concat(cast(o_orderdate as date), 'T10:15:00', case o_orderkey % 3 when 0 then '' when 1 then 'Z' else '+02:00' end) as text from orders")
    zoned = F.when(F.col("text").rlike(r"(Z|[+-]\d\d:?\d\d)$"), F.col("text")).otherwise(F.concat("text", F.lit("Z")))
    return texts.select("id", F.unix_timestamp(zoned.try_cast("timestamp")).alias("seconds"))


@query("geo_centroid", with_views("""with l as (select id, lat, lon, 0.001e0 as up, abs(balance) / 1000000e0 as side from asset)
select id, round(lat + (up * up / 2 + side * up) / (up + side), 9) as lat, round(lon + side * side / 2 / (up + side), 9) as lon from l"""))  # fmt: skip
def geo_centroid(spark, sf_dir):
    """Middle of a line by length: the midpoints of its segments, weighted; of a line without length its first point."""
    register(spark, sf_dir, "asset")
    lines = spark.sql("select id, array(struct(lat, lon), struct(lat + 0.001e0 as lat, lon), struct(lat + 0.001e0 as lat, lon + abs(balance) / 1000000e0 as lon)) as p from asset")
    length = lambda a, b: F.sqrt(F.pow(a["lat"] - b["lat"], 2) + F.pow(a["lon"] - b["lon"], 2))
    ahead = F.slice("p", F.lit(2), F.size("p") - 1)
    parts = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), ahead, lambda a, b: F.struct(length(a, b).alias("w"), ((a["lat"] + b["lat"]) / 2).alias("lat"), ((a["lon"] + b["lon"]) / 2).alias("lon")))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda acc, x: acc + f(x))
    whole = total(lambda x: x["w"])
    middle = lambda c: F.round(F.when(whole > 0, total(lambda x: x["w"] * x[c]) / whole).otherwise(F.col("p")[0][c]), 9).alias(c)
    return lines.withColumn("s", parts).select("id", middle("lat"), middle("lon"))


@query("ts_alert_for", with_views("""with h as (select name, date_trunc('hour', ts) as hour, count(*) as n from metric group by 1, 2), m as (select name, avg(n) as usual from h group by 1),
f as (select h.name, hour, epoch(hour)::bigint // 3600 - row_number() over (partition by h.name order by hour) as island from h join m on h.name = m.name where n > usual)
select name, min(hour) as since, count(*) as hours from f group by name, island having count(*) >= 2"""))  # fmt: skip
def ts_alert_for(spark, sf_dir):
    """Alerts that hold: at least two hours in a row, each with more events than the name's average hour has."""
    register(spark, sf_dir, "metric")
    hours = spark.table("metric").groupBy("name", F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))
    firing = hours.join(hours.groupBy("name").agg(F.avg("n").alias("usual")), "name").where("n > usual")
    order = F.row_number().over(Window.partitionBy("name").orderBy("hour"))
    islands = firing.withColumn("island", F.floor(F.unix_timestamp("hour") / 3600) - order)
    return islands.groupBy("name", "island").agg(F.min("hour").alias("since"), F.count("*").alias("hours")).where("hours >= 2").drop("island")
