"""Map extracts: XML scan, tags to directed edges and assets, stored graphs with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepfree.functions import cost, geo
from stepfree.functions import sqltext as sql
from stepfree.functions.tags import asset_type, blocking_barrier, crossing, kerb_height, parse_metres
from stepfree.registry import query
from stepfree.shared import dealt, new_folder
from stepfree.sources import pbf
from stepfree.views import register, with_views

_TAG = T.ArrayType(T.StructType([T.StructField("_k", T.StringType()), T.StructField("_v", T.StringType())]))
NODE = T.StructType([T.StructField("_id", T.LongType()), T.StructField("_lat", T.DoubleType()), T.StructField("_lon", T.DoubleType()), T.StructField("tag", _TAG)])
WAY = T.StructType([T.StructField("_id", T.LongType()), T.StructField("nd", T.ArrayType(T.StructType([T.StructField("_ref", T.LongType())]))), T.StructField("tag", _TAG)])
#: Ways that people walk on, ways that they never do, barriers that are no way.
WALKABLE = ("footway", "path", "pedestrian", "living_street", "service", "residential", "unclassified", "tertiary", "secondary", "primary", "track", "steps", "crossing")
EXCLUDED = ("motorway", "motorway_link", "trunk", "trunk_link", "proposed", "construction")
WALLS = ("wall", "fence")


def existing(spark: SparkSession, paths: str) -> list[str]:
    """The paths of a ;-list that exist (asked of Spark's own file systems); none is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for p in filter(None, (x.strip() for x in paths.split(";"))):
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(conf).exists(path):
            found.append(p)
    if not found:
        raise FileNotFoundError(f"no input exists among {paths}")
    return found


def tag_map(tags: Column) -> Column:
    """Keys in lower case, values trimmed, blanks left out; the last of repeated keys counts."""
    entries = F.transform(F.coalesce(tags, F.array().cast(_TAG)), lambda t: F.struct(F.lower(F.trim(t["_k"])).alias("key"), F.trim(t["_v"]).alias("value")))
    entries = F.filter(entries, lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.aggregate(entries, F.create_map().cast("map<string,string>"), lambda acc, e: F.map_concat(F.map_filter(acc, lambda k, v: k != e["key"]), F.create_map(e["key"], e["value"])))


def scan(spark: SparkSession, paths: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, lat, lon, tags) and ways (id, refs, tags) of XML extracts."""
    files = existing(spark, paths)
    read = lambda row, schema: spark.read.format("xml").option("rowTag", row).schema(schema).load(files)
    nodes = read("node", NODE).select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), tag_map(F.col("tag")).alias("tags"))
    ways = read("way", WAY).select(F.col("_id").alias("id"), F.transform("nd", lambda x: x["_ref"]).alias("refs"), tag_map(F.col("tag")).alias("tags"))
    return nodes, ways


def walkable(tags: Column) -> Column:
    """A way of a kind that people walk on, or one open to them by its foot tag; not where foot or access forbid it, nor a wall."""
    get = lambda k: F.lower(F.coalesce(tags[k], F.lit("")))
    kind, foot = get("highway"), get("foot")
    shut = kind.isin("", *EXCLUDED) | (foot == "no") | (get("access").isin("no", "private") & (foot != "yes")) | get("barrier").isin(*WALLS)
    return ~shut & (kind.isin(*WALKABLE) | foot.isin("yes", "designated"))


def one_way(tags: Column) -> Column:
    return (F.coalesce(tags["oneway:foot"], F.lit("")) == "yes") | (F.coalesce(tags["foot:backward"], F.lit("")) == "no")


def segments(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Consecutive known nodes of walkable ways, in both directions where both are open."""
    refs = ways.where(walkable(F.col("tags"))).select(F.col("id").alias("way_id"), "tags", F.posexplode("refs").alias("pos", "ref"))
    known = refs.join(nodes.select(F.col("id").alias("ref"), "lat", "lon"), "ref")
    along = W.partitionBy("way_id").orderBy("pos")
    nxt = F.lead(F.struct("ref", "lat", "lon")).over(along)
    forward = known.withColumn("to", nxt).where("to is not null").select("way_id", "tags", F.struct("ref", "lat", "lon").alias("a"), F.col("to").alias("b"))
    backward = forward.where(~one_way(F.col("tags"))).select("way_id", "tags", F.col("b").alias("a"), F.col("a").alias("b"))
    return forward.unionByName(backward)


def edges(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    """Directed edges with length, attributes, penalties and quality."""
    t = F.col("tags")
    get = lambda k: F.coalesce(t[k], F.lit(""))
    e = segments(nodes, ways).select(
        "way_id",
        F.col("a.ref").alias("src"),
        F.col("b.ref").alias("dst"),
        geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")).alias("dist"),
        F.coalesce(t["surface"], F.lit("unknown")).alias("surface"),
        t["smoothness"].alias("smoothness"),
        parse_metres(t["width"]).alias("width_m"),
        kerb_height(t).alias("kerb_height"),
        (get("highway") == "steps").alias("has_stairs"),
        blocking_barrier(t).alias("has_barrier"),
        (get("incline").isin("up", "down", "steep") | F.coalesce(F.abs(F.regexp_replace(get("incline"), "%$", "").try_cast("double")) >= 8, F.lit(False))).alias("is_steep"),
        crossing(t).alias("has_crossing"),
        F.when(get("lit") == "yes", 0.95).when(get("lit") == "no", 0.1).when(get("lit") == "limited", 0.55).otherwise(0.45).alias("lighting"),
        F.nullif(F.concat_ws(";", *[F.when(get(k) != "", F.concat(F.lit(f"{k}="), t[k])) for k in ("access", "foot", "wheelchair")]), F.lit("")).alias("access"),
    )
    names = ("dist", "surface", "smoothness", "has_stairs", "has_barrier", "kerb_height", "width_m", "is_steep", "access")
    for short, profile in (("standard", "standard"), ("wheelchair", "manual-wheelchair"), ("stroller", "stroller")):
        e = e.withColumn(f"{short}_penalty_s", cost.penalty(profile, *(F.col(c) for c in names)))
    return e.withColumn("data_quality", cost.data_quality(F.col("surface"), F.col("smoothness"), F.col("width_m"))).withColumn("cost_version", F.lit(1))


def assets(nodes: DataFrame) -> DataFrame:
    """Point infrastructure with its type: amenity, public transport, railway, some highways, barriers."""
    kind = asset_type(F.col("tags"))
    return nodes.withColumn("asset_type", kind).where("asset_type is not null").dropDuplicates(["id"]).select("id", "asset_type", "lat", "lon", "tags")


def write_xml(nodes: DataFrame, ways: DataFrame, folder: str) -> str:
    """Nodes and ways as XML; returns the list of paths that ``scan`` takes."""
    entries = F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    out = lambda df, row: df.write.format("xml").option("rootTag", "osm").option("rowTag", row).save(f"{folder}/{row}")
    out(nodes.select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), entries), "node")
    out(ways.select(F.col("id").alias("_id"), F.transform("refs", lambda r: F.struct(r.alias("_ref"), F.lit(None).cast("string").alias("_VALUE"))).alias("nd"), entries), "way")
    return f"{folder}/node;{folder}/way"


#: The extract of the given tables, the same text for both engines: every stretch a way, every fifth node with a tag.
EXTRACT_WAY = """select id, src, dst, case when has_stairs then 'steps' when id % 3 = 0 then 'path' when id % 7 = 0 then 'motorway' else 'footway' end as highway,
 surface, smoothness, case when width_m is not null then concat(cast(cast(round(width_m * 100) as bigint) as varchar(9)), ' cm') end as width,
 case when is_steep then '10%' end as incline, case when id % 11 = 0 then 'yes' end as oneway_foot from edge where src < dst"""
EXTRACT_NODE = "select id, lat, lon, case when id % 5 = 0 then case when id % 2 = 0 then 'crossing' else 'elevator' end end as highway from node"


def extract(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The given graph as nodes (id, lat, lon, tags) and ways (id, refs, tags), dealt so that no file that is written from them is large."""
    register(spark, sf_dir, "node", "edge")
    tags = lambda **c: F.map_filter(F.create_map(*[x for k, v in c.items() for x in (F.lit(k.replace("__", ":")), F.col(v))]), lambda k, v: v.isNotNull())
    nodes = dealt(spark.sql(EXTRACT_NODE), "id").select("id", "lat", "lon", tags(highway="highway").alias("tags"))
    ways = dealt(spark.sql(EXTRACT_WAY), "id")
    named = tags(highway="highway", surface="surface", smoothness="smoothness", width="width", incline="incline", oneway__foot="oneway_foot")
    return nodes, ways.select("id", F.array("src", "dst").alias("refs"), named.alias("tags"))


def scanned(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The extract, written as XML and read back."""
    return scan(spark, write_xml(*extract(spark, sf_dir), new_folder(spark, "xml")))


def _listed(nodes: DataFrame, ways: DataFrame) -> DataFrame:
    place = lambda c: F.round(c, 7)
    n = nodes.select("id", F.lit("node").alias("kind"), F.size("tags").cast("long").alias("tags"), place("lat").alias("lat"), place("lon").alias("lon"), F.lit(0).cast("long").alias("refs"))
    w = ways.select("id", F.lit("way").alias("kind"), F.size("tags").cast("long").alias("tags"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.size("refs").cast("long").alias("refs"))
    return n.unionByName(w)


_LISTED = with_views(f"""with w as ({EXTRACT_WAY}), n as ({EXTRACT_NODE})
select id, 'node' as kind, (highway is not null)::bigint as tags, round(lat, 7) as lat, round(lon, 7) as lon, 0::bigint as refs from n
union all select id, 'way', (2 + (smoothness is not null)::bigint + (width is not null)::bigint + (incline is not null)::bigint + (oneway_foot is not null)::bigint)::bigint, null, null, 2 from w""")


@query("scan_osm_xml", _LISTED)
def scan_osm_xml(spark, sf_dir):
    """The extract of all nodes and edges, through XML files."""
    return _listed(*scanned(spark, sf_dir))


@query("scan_osm_pbf", _LISTED)
def scan_osm_pbf(spark, sf_dir):
    """The extract of all nodes and edges, through protocol-buffer files."""
    nodes, ways = extract(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    rows = nodes.select(F.lit("node").alias("kind"), "id", "lat", "lon", none("array<long>").alias("refs"), "tags")
    rows = rows.unionByName(ways.select(F.lit("way").alias("kind"), "id", none("double").alias("lat"), none("double").alias("lon"), "refs", "tags"))
    folder = new_folder(spark, "pbf")
    pbf.write(rows, folder)
    return _listed(*pbf.scan(spark, folder))


@query("join_way_nodes", with_views(f"""with w as ({EXTRACT_WAY}) select id as way_id, src, dst from w where highway <> 'motorway'
union all select id, dst, src from w where highway <> 'motorway' and oneway_foot is null"""))
def join_way_nodes(spark, sf_dir):
    return segments(*scanned(spark, sf_dir)).select("way_id", F.col("a.ref").alias("src"), F.col("b.ref").alias("dst"))


@query("graph_etl", with_views(f"""with w as ({EXTRACT_WAY}), s as (select *, src as a, dst as b from w where highway <> 'motorway' union all select *, dst, src from w where highway <> 'motorway' and oneway_foot is null),
e as (select s.id as way_id, a as src, b as dst, {sql.haversine('m.lat', 'm.lon', 'n.lat', 'n.lon')} as dist, surface, smoothness, case when width is not null then replace(width, ' cm', '')::double / 100 end as width_m,
 0e0 as kerb_height, highway = 'steps' as has_stairs, false as has_barrier, incline is not null as is_steep, null::varchar as access from s join node m on m.id = a join node n on n.id = b)
select way_id, src, dst, round(dist, 4) as dist, surface, smoothness, round(width_m, 2) as width_m, has_stairs, is_steep, round({sql.penalty('standard', 'e')}, 3) as standard_penalty_s,
 round({sql.penalty('manual-wheelchair', 'e')}, 3) as wheelchair_penalty_s from e"""))
def graph_etl(spark, sf_dir):
    """Directed edges from the files of the extract."""
    e = edges(*scanned(spark, sf_dir))
    return e.select(
        "way_id", "src", "dst", F.round("dist", 4).alias("dist"), "surface", "smoothness", F.round("width_m", 2).alias("width_m"), "has_stairs", "is_steep",
        *[F.round(c, 3).alias(c) for c in ("standard_penalty_s", "wheelchair_penalty_s")],
    )


@query("graph_assets", with_views(f"with n as ({EXTRACT_NODE}) select id, 'highway:' || highway as asset_type, round(lat, 7) as lat, round(lon, 7) as lon from n where highway is not null"))
def graph_assets(spark, sf_dir):
    return assets(scanned(spark, sf_dir)[0]).select("id", "asset_type", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))
