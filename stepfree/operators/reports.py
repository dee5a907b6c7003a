"""Dashboards, feeds, pages, set operations, text rules, keys and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.functions import risk
from stepfree.functions.tags import asset_type, parse_metres
from stepfree.operators.filters import edges, hazards
from stepfree.registry import query
from stepfree.running import running
from stepfree.views import register, with_views


def shared(name: str, text: str, *views: str):
    """A query that is plain SQL on views: the same text runs on both engines."""

    @query(name, with_views(text))
    def run(spark, sf_dir) -> DataFrame:
        register(spark, sf_dir, *views)
        return spark.sql(text)

    return run


AS_OF = "timestamp '2024-01-20 00:00:00'"

agg_summary = shared(
    "agg_summary",
    f"""select count(*) as total, count(*) filter (where status = 'reported') as reported, count(*) filter (where status in ('reported', 'under_review')) as pending,
  (select count(distinct user_id) from refresh_token where not revoked and expires_at > timestamp '1998-01-01 00:00:00') as active_users from hazard""",
    "hazard", "refresh_token",
)
agg_status_counts = shared("agg_status_counts", "select status, count(*) as n, count(distinct reporter) as reporters from hazard group by status", "hazard")
agg_user_stats = shared(
    "agg_user_stats",
    "select reporter, count(*) as submitted, count(*) filter (where status = 'resolved') as resolved, count(*) + count(*) filter (where status = 'resolved') as contribution from hazard group by reporter",
    "hazard",
)
join_scalar_subquery = shared(
    "join_scalar_subquery", "select id, status, (select count(distinct user_id) from refresh_token where not revoked) as users from hazard", "hazard", "refresh_token"
)
join_scalar_cross = shared(
    "join_scalar_cross", "select n.id, round(abs(n.lat - q.lat) + abs(n.lon - q.lon), 6) as spread from node n cross join (select avg(lat) as lat, avg(lon) as lon from node) q", "node"
)
join_edge_nodes = shared(
    "join_edge_nodes",
    "select e.id, e.src, e.dst, round(a.lat, 6) as from_lat, round(a.lon, 6) as from_lon, round(b.lat, 6) as to_lat, round(b.lon, 6) as to_lon from edge e join node a on a.id = e.src join node b on b.id = e.dst",
    "edge", "node",
)
join_submission_asset = shared("join_submission_asset", "select h.id, h.hazard_type from hazard h where exists (select 1 from asset a where a.id = h.id % 137)", "hazard", "asset")


@query("join_enum_map", with_views("select hazard_type, count(*) as n, round(case translate(lower(trim(hazard_type)), '- /', '___') " + " ".join(f"when '{k}' then {v}e0" for k, v in risk.SEVERITY.items()) + " else 0.5e0 end, 3) as severity from hazard group by hazard_type"))
def join_enum_map(spark, sf_dir):
    """Every type of report with its severity: counted first, then joined with the table of severities (a fixed list of 46 rows)."""
    counted = hazards(spark, sf_dir).groupBy("hazard_type").agg(F.count("*").alias("n"))
    table = spark.createDataFrame(list(risk.SEVERITY.items()), "name string, severity double")
    found = counted.join(F.broadcast(table), risk.token(F.coalesce("hazard_type", F.lit(""))) == F.col("name"), "left")
    return found.select("hazard_type", "n", F.round(F.coalesce("severity", F.lit(risk.DEFAULT_SEVERITY)), 3).alias("severity"))


join_range_dim = shared(
    "join_range_dim",
    """with city as (select 'north' as city, 0 as ord, 52.49e0 as lo, 52.60e0 as hi union all select 'middle', 1, 52.47e0, 52.50e0 union all select 'south', 2, 52.40e0, 52.48e0),
m as (select h.id, c.city, row_number() over (partition by h.id order by c.ord) as rn from hazard h join city c on h.lat between c.lo and c.hi)
select id, city from m where rn = 1""",
    "hazard",
)
join_anti_delta = shared("join_anti_delta", "select id, task from prediction p where not exists (select 1 from (select id from prediction where id % 3 = 0) b where b.id = p.id)", "prediction")
agg_coverage_area = shared(
    "agg_coverage_area",
    "select round(sum(dlat * 111.32e0 * dlon * 111.32e0), 6) as km2, count(*) as regions from (select id % 10 as region, max(lat) - min(lat) as dlat, max(lon) - min(lon) as dlon from node group by id % 10) t",
    "node",
)
agg_data_quality = shared(
    "agg_data_quality",
    "select count(*) as edges, count(*) filter (where surface = 'unknown') as no_surface, count(*) filter (where width_m is null) as no_width, count(*) filter (where smoothness is null) as no_smoothness from edge",
    "edge",
)


@query("agg_percentile_nearest", with_views("""select task, round(max(score_a) filter (where rn = greatest(1, cast(ceil(0.95e0 * n) as bigint))), 6) as p95 from
(select task, score_a, row_number() over (partition by task order by score_a, id) as rn, count(*) over (partition by task) as n from prediction) t group by task"""))
def agg_percentile_nearest(spark, sf_dir):
    """The score at place ceil(0.95 n) of a task. Equal scores are counted first and places run over the distinct ones."""
    register(spark, sf_dir, "prediction")
    counted = spark.table("prediction").groupBy("task", "score_a").agg(F.count("*").alias("n"))
    placed = running(counted, ["task"], [F.asc("score_a")], last=("sum", "n"))
    place = F.greatest(F.lit(1), F.ceil(F.lit(0.95) * F.col("total_last")))
    return placed.where((F.col("last") >= place) & (F.col("last") - F.col("n") < place)).select("task", F.round("score_a", 6).alias("p95"))


@query("agg_percentile_linear", with_views("select task, round(quantile_cont(score_a, 0.5), 6) as p50, round(quantile_cont(score_a, 0.95), 6) as p95 from prediction group by task"))
def agg_percentile_linear(spark, sf_dir):
    register(spark, sf_dir, "prediction")
    return spark.table("prediction").groupBy("task").agg(F.round(F.expr("percentile(score_a, 0.5)"), 6).alias("p50"), F.round(F.expr("percentile(score_a, 0.95)"), 6).alias("p95"))


agg_split_summary = shared(
    "agg_split_summary",
    "select city, task, count(*) as n, sum(target) as positive from prediction group by grouping sets ((), (city), (task), (city, task))",
    "prediction",
)


def graph_status(nodes: DataFrame, ways: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: counts, whether there is a graph, its version, the latest import and a warning if there is none.

    ``runs``: id, status, started_at, finished_at (null while it runs); the latest is the one finished or, if not, started last; ties: larger id.
    """
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(ways.agg(F.count("*").alias("edges"))))
    latest = runs.agg(F.max_by(F.struct("id", "status", "finished_at"), F.struct(F.coalesce("finished_at", "started_at"), "id")).alias("run"))
    covered = (F.col("nodes") > 0) & (F.col("edges") > 0)
    run_id = F.coalesce("run.id", F.lit(0))
    version = F.when(covered, F.format_string("osm:%d:n%d:e%d", run_id, F.col("nodes"), F.col("edges"))).otherwise(F.format_string("osm:empty:%d", run_id))
    why = F.when(F.col("run").isNull(), " and no completed OSM import has been recorded").otherwise(" after the latest OSM import")
    warning = F.when(~covered, F.concat(F.lit("Route graph is empty"), why, F.lit("; safe-path may use fallback routing.")))
    return counts.crossJoin(F.broadcast(latest)).select(
        "nodes", "edges", covered.alias("has_coverage"), version.alias("version"), F.col("run.id").alias("run_id"), F.col("run.status").alias("run_status"), F.col("run.finished_at").alias("finished_at"), warning.alias("warning")
    )


_RUNS = "select id, status, reported_at as started_at, case when status <> 'in_progress' then reported_at + interval '20' minute end as finished_at from hazard where source = 'osm'"


@query("agg_graph_status", with_views(f"""with r as (select * from ({_RUNS}) order by coalesce(finished_at, started_at) desc, id desc limit 1), n as (select (select count(*) from node) as nodes, (select count(*) from edge) as edges)
select nodes, edges, true as has_coverage, 'osm:' || r.id || ':n' || nodes || ':e' || edges as version, r.id as run_id, r.status as run_status, strftime(r.finished_at, '%Y-%m-%d %H:%M:%S') as finished_at, null::varchar as warning from n cross join r"""))
def agg_graph_status(spark, sf_dir):
    """The graph's counts and version with its latest import (reports from the map stand for the imports)."""
    register(spark, sf_dir, "node", "edge", "hazard")
    out = graph_status(spark.table("node"), spark.table("edge"), spark.sql(_RUNS))
    return out.withColumn("finished_at", F.date_format("finished_at", "yyyy-MM-dd HH:mm:ss"))


# windows
win_segments = shared(
    "win_segments", "select id, lead(id) over (partition by id % 40 order by id) as next_id, lag(id) over (partition by id % 40 order by id) as prev_id from node", "node"
)
win_step_position = shared(
    "win_step_position",
    "select id, case when rn = 1 then 'depart' when rn = n then 'arrive' else 'continue' end as step from (select id, row_number() over (partition by id % 40 order by id) as rn, count(*) over (partition by id % 40) as n from node) t",
    "node",
)


@query("win_cumsum", with_views("select id, task, sum(target) over (partition by task order by score_a desc, id rows between unbounded preceding and current row) as tp from prediction"))
def win_cumsum(spark, sf_dir):
    """True positives down to each row, from the highest score."""
    register(spark, sf_dir, "prediction")
    rows = spark.table("prediction").select("id", "task", "score_a", "target")
    return running(rows, ["task"], [F.desc("score_a"), F.asc("id")], tp=("sum", "target")).select("id", "task", "tp")


@query("win_reverse_max", with_views("select id, round(max(score_b) over (partition by task order by score_a, id rows between current row and unbounded following), 6) as envelope from prediction"))
def win_reverse_max(spark, sf_dir):
    """The highest second score from each row on, in the order of the first one: a running maximum from the end."""
    register(spark, sf_dir, "prediction")
    rows = spark.table("prediction").select("id", "task", "score_a", "score_b")
    return running(rows, ["task"], [F.desc("score_a"), F.desc("id")], envelope=("max", "score_b")).select("id", F.round("envelope", 6).alias("envelope"))


win_topn_group = shared(
    "win_topn_group", "select task, city, id from (select *, row_number() over (partition by task, city order by score_a desc, id) as rn from prediction) t where rn <= 2", "prediction"
)
win_first_per_key = shared(
    "win_first_per_key", "select reporter, id from (select reporter, id, row_number() over (partition by reporter order by reported_at desc, id) as rn from hazard) t where rn = 1", "hazard"
)

# sorts and pages
sort_topk = shared("sort_topk", "select id, status from hazard order by reported_at desc, id limit 250", "hazard")
ui_sort = shared(
    "ui_sort",
    "select id, hazard_type, status from hazard order by case status when 'reported' then 0 when 'under_review' then 1 else 2 end, hazard_type, id limit 200",
    "hazard",
)
limit_truncate_flag = shared(
    "limit_truncate_flag",
    "select id, truncated from (select id, row_number() over (order by id) as rn, count(*) over () > 500 as truncated from (select id from edge order by id limit 501) t) u where rn <= 500",
    "edge",
)


@query(
    "page_keyset",
    with_views("""with page as (select id, reported_at, row_number() over (order by reported_at desc, id) as rn from hazard where reported_at < timestamp '2024-01-20 00:00:00' order by reported_at desc, id limit 51)
select id, (select count(*) from page) > 50 as has_more, strftime(reported_at, '%Y-%m-%dT%H:%M:%S') as at from page where rn <= 50"""),
)
def page_keyset(spark, sf_dir):
    """A page after a cursor: one row more than asked for tells whether another page follows."""
    df = hazards(spark, sf_dir).where(F.col("reported_at") < F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    page = df.orderBy(F.desc("reported_at"), "id").limit(51).withColumn("rn", F.row_number().over(W.orderBy(F.desc("reported_at"), "id"))).withColumn("n", F.count("*").over(W.partitionBy()))
    return page.where("rn <= 50").select("id", (F.col("n") > 50).alias("has_more"), F.date_format("reported_at", "yyyy-MM-dd'T'HH:mm:ss").alias("at"))


@query("sample_shuffle")
def sample_shuffle(spark, sf_dir):
    """A seeded sample of at most 100 rows a task, in hash order: the same at every run."""
    register(spark, sf_dir, "prediction")
    order = F.row_number().over(W.partitionBy("task").orderBy(F.xxhash64("id", F.lit(42)), "id"))
    return spark.table("prediction").withColumn("rn", order).where("rn <= 100").select("task", "id")


# sets
#: Reports from the map and from people that one answer holds at most.
MAX_OSM, MAX_DB = 2500, 5000


def feed(osm: DataFrame, db: DataFrame, status: str | None = None) -> DataFrame:
    """One answer of both sources: ord 0 from the map (only where no status or "reported" is asked for), then ord 1 from people, newest first; both capped."""
    own = db if status is None else db.where(F.col("status") == status)
    second = own.orderBy(F.desc("reported_at"), "id").limit(MAX_DB).withColumn("ord", F.lit(1))
    if status not in (None, "reported"):
        return second
    return osm.orderBy("id").limit(MAX_OSM).withColumn("ord", F.lit(0)).unionByName(second)


@query("set_union_all", with_views("select id, status, 0 as ord from hazard where source = 'osm' union all select id, status, 1 as ord from hazard where source <> 'osm'"))
def set_union_all(spark, sf_dir):
    """All reports of both sources, those from the map first; ``feed`` is the capped answer to one request."""
    rows = hazards(spark, sf_dir)
    part = lambda where, ord_: rows.where(where).select("id", "status", F.lit(ord_).alias("ord"))
    return part("source = 'osm'", 0).unionByName(part("source <> 'osm'", 1))


set_distinct = shared(
    "set_distinct",
    "select lower(hazard_type) as name, min(id) as first_id from (select id, case when id % 2 = 0 then upper(hazard_type) else hazard_type end as hazard_type from hazard) t group by lower(hazard_type)",
    "hazard",
)
set_graph_merge = shared(
    "set_graph_merge",
    """with shards as (select 0 as ord, src, dst, dist from edge union all select 1 as ord, src, dst, dist + 1 from edge where id % 3 = 0),
m as (select *, row_number() over (partition by src, dst order by ord desc, dist) as rn from shards) select src, dst, round(dist, 3) as dist, ord from m where rn = 1""",
    "edge",
)
set_disjoint_check = shared(
    "set_disjoint_check",
    "select count(*) as overlap from (select city from prediction where id % 2 = 0 intersect select city from prediction where id % 2 = 1) t",
    "prediction",
)
set_forbidden = shared("set_forbidden", "select id from prediction where city in ('src1', 'src2') except select id from prediction where target = 0", "prediction")

# text rules
#: Tags of a place by id; each row gives its type, or none.
_PLACES = (
    ({"amenity": "toilets", "railway": "station"}, "amenity:toilets"), ({"public_transport": "platform", "highway": "bus_stop"}, "public_transport:platform"), ({"railway": "station", "barrier": "gate"}, "railway:station"),
    ({"highway": "Elevator", "barrier": "kerb"}, "highway:Elevator"), ({"highway": "footway", "barrier": "kerb"}, "barrier:kerb"), ({"highway": "crossing"}, "highway:crossing"), ({"highway": "steps"}, None),
    ({"highway": "bus_stop"}, "highway:bus_stop"), ({"surface": "asphalt"}, None), ({"barrier": "bollard"}, "barrier:bollard"), ({"amenity": "bench"}, "amenity:bench"),
)


@query("str_asset_type", with_views(f"select id, case id % {len(_PLACES)} {' '.join(f"when {k} then '{v}'" for k, (_, v) in enumerate(_PLACES) if v)} end as asset_type from asset"))
def str_asset_type(spark, sf_dir):
    """The type of every place from its tags."""
    register(spark, sf_dir, "asset")
    maps = F.array(*[F.create_map(*[F.lit(x) for pair in t.items() for x in pair]) for t, _ in _PLACES])
    return spark.table("asset").select("id", asset_type(F.element_at(maps, (F.col("id") % len(_PLACES) + 1).cast("int"))).alias("asset_type"))


str_access = shared(
    "str_access", "select id, nullif(concat_ws(';', access, case when id % 5 = 0 then 'wheelchair=no' end), '') as access from edge", "edge"
)


@query("risk_severity", with_views("select distinct hazard_type, case translate(lower(trim(hazard_type)), '- /', '___') when 'missing_curb_ramp' then 0.9e0 when 'gravel' then 0.65e0 when 'poor_lighting' then 0.5e0 when 'pothole' then 0.5e0 else 0.5e0 end as severity from hazard"))
def risk_severity(spark, sf_dir):
    return hazards(spark, sf_dir).select("hazard_type").distinct().select("hazard_type", risk.severity(F.col("hazard_type")).alias("severity"))


@query("str_label", with_views("select distinct hazard_type, 'Hazard: ' || upper(substr(replace(hazard_type, '-', ' '), 1, 1)) || substr(replace(hazard_type, '-', ' '), 2) as label from hazard"))
def str_label(spark, sf_dir):
    words = F.regexp_replace("hazard_type", "[-_]", " ")
    label = F.concat(F.lit("Hazard: "), F.upper(F.substring(words, 1, 1)), words.substr(F.lit(2), F.length(words)))
    return hazards(spark, sf_dir).select("hazard_type").distinct().select("hazard_type", label.alias("label"))


#: Type that a rule suggests, its tag, its confidence, its keywords; the first rule that matches names the type.
KEYWORD_RULES = (
    ("missing_curb_ramp", "accessibility", 0.86, ("curb ramp", "kerb ramp", "curb cut", "dropped kerb", "missing ramp", "no ramp", "raised kerb", "high kerb")),
    ("stairs", "accessibility", 0.86, ("stairs", "steps", "stairway")),
    ("missing_sidewalk", "network_gap", 0.84, ("no sidewalk", "missing sidewalk", "no pavement", "missing pavement")),
    ("obstruction", "temporary_obstacle", 0.78, ("blocked", "obstruction", "barrier", "scaffold", "skip", "bin", "trash", "parked car", "parked van", "construction")),
    ("surface_quality", "surface", 0.74, ("uneven", "gravel", "cobblestone", "cracked", "broken pavement", "pothole", "loose surface", "mud")),
    ("steep_gradient", "grade", 0.72, ("steep", "slope", "incline", "gradient", "hill")),
    ("low_lighting", "visibility", 0.70, ("dark", "poor lighting", "no lights", "streetlight out", "unlit")),
    ("flooding", "temporary_obstacle", 0.72, ("flood", "flooding", "standing water", "puddle")),
)

#: Reports with a description beside their type.
REPORTS = """select id, hazard_type, lower(hazard_type || ' ' || case id % 9 when 0 then 'Steps and a steep hill' when 1 then 'BLOCKED by a skip' when 2 then 'dark, standing water'
 when 3 then 'no sidewalk here' when 4 then 'cannot pass, too tight' when 5 then 'uneven cobblestone' when 6 then 'High kerb and mud' when 7 then 'quiet street' else '' end) as t from hazard"""


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def suggested_type(text: Column, hazard_type: Column) -> Column:
    """The type of the first rule that matches, else the report's own type as a token."""
    out = F.regexp_replace(F.regexp_replace(F.lower(hazard_type), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    for name, _, _, words in reversed(KEYWORD_RULES):
        out = F.when(has_any(text, words), name).otherwise(out)
    return out


def rule_confidence(text: Column) -> Column:
    """Confidence of the first rule that matches, 0.03 more for each further one, 0.95 at most; 0.45 without a match."""
    matched = sum((has_any(text, words).cast("int") for _, _, _, words in KEYWORD_RULES), F.lit(0))
    first = F.lit(None).cast("double")
    for _, _, level, words in reversed(KEYWORD_RULES):
        first = F.when(has_any(text, words), level).otherwise(first)
    return F.when(matched > 0, F.least(F.lit(0.95), first + (matched - 1) * 0.03)).otherwise(0.45)


def severity_class(suggested: Column, text: Column) -> Column:
    urgent = has_any(text, ("cannot pass", "dangerous", "blocked", "no sidewalk", "missing sidewalk"))
    high = urgent | suggested.isin("stairs", "missing_curb_ramp", "missing_sidewalk")
    return F.when(high, "high").when(suggested.isin("low_lighting", "surface_quality", "obstruction"), "medium").otherwise("low")


_LIKE = {name: "(" + " or ".join(f"contains(t, '{w}')" for w in words) + ")" for name, _, _, words in KEYWORD_RULES}
_TYPE = "case " + " ".join(f"when {_LIKE[name]} then '{name}'" for name, *_ in KEYWORD_RULES) + " else trim(regexp_replace(lower(hazard_type), '[^a-z0-9]+', '_', 'g'), '_') end"
_MATCHED = "list_filter([" + ", ".join(f"case when {_LIKE[name]} then {{'tag': '{tag}', 'level': {level}e0}} end" for name, tag, level, _ in KEYWORD_RULES) + "], lambda x: x is not null)"


def reports(spark, sf_dir) -> DataFrame:
    register(spark, sf_dir, "hazard")
    return spark.sql(REPORTS)


@query(
    "str_keyword_rules",
    with_views(f"""with r as ({REPORTS}), m as (select *, {_MATCHED} as hits from r)
select id, {_TYPE} as suggested_type, round(case when len(hits) = 0 then 0.45e0 else least(0.95e0, hits[1].level + (len(hits) - 1) * 0.03e0) end, 4) as confidence,
 array_to_string(list_sort(list_distinct(list_transform(hits, lambda x: x.tag))), ';') as tags from m"""),
)
def str_keyword_rules(spark, sf_dir):
    """Type, confidence and tags that a report's type and description suggest."""
    t = F.col("t")
    tags = F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(has_any(t, words), tag) for _, tag, _, words in KEYWORD_RULES]))))
    return reports(spark, sf_dir).select(
        "id", suggested_type(t, F.col("hazard_type")).alias("suggested_type"), F.round(rule_confidence(t), 4).alias("confidence"), F.array_join(tags, ";").alias("tags")
    )


@query(
    "str_severity_class",
    with_views(f"""with r as ({REPORTS}), s as (select id, t, {_TYPE} as kind from r)
select id, case when regexp_matches(t, 'cannot pass|dangerous|blocked|no sidewalk|missing sidewalk') or kind in ('stairs', 'missing_curb_ramp', 'missing_sidewalk') then 'high'
 when kind in ('low_lighting', 'surface_quality', 'obstruction') then 'medium' else 'low' end as level from s"""),
)
def str_severity_class(spark, sf_dir):
    t = F.col("t")
    return reports(spark, sf_dir).select("id", severity_class(suggested_type(t, F.col("hazard_type")), t).alias("level"))


@query(
    "str_parse_metres",
    with_views("select id, round(case id % 5 when 0 then (id % 200) / 100e0 when 1 then (id % 300) / 1000e0 when 2 then id % 9 + 0.5e0 when 3 then null else 1.2e0 end, 6) as metres from node"),
)
def str_parse_metres(spark, sf_dir):
    register(spark, sf_dir, "node")
    text = (
        F.when(F.col("id") % 5 == 0, F.concat((F.col("id") % 200).cast("string"), F.lit(" cm")))
        .when(F.col("id") % 5 == 1, F.concat((F.col("id") % 300).cast("string"), F.lit("mm")))
        .when(F.col("id") % 5 == 2, F.concat((F.col("id") % 9).cast("string"), F.lit(",5 m")))
        .when(F.col("id") % 5 == 3, F.lit("wide"))
        .otherwise(F.lit("1.2;0.8"))
    )
    return spark.table("node").select("id", F.round(parse_metres(text), 6).alias("metres"))


# keys and hashes
hash_cache_keys = shared(
    "hash_cache_keys",
    "select id, cast(cast(round(lat * 100000) as bigint) as varchar(20)) || ':' || cast(cast(round(lon * 100000) as bigint) as varchar(20)) || ':' || cast(cast(ceil((id % 333) / 50e0) * 50 as bigint) as varchar(20)) as cache_key from node",
    "node",
)


@query("hash_job_id", with_views("select id, substr(sha256(cast(id as varchar) || ':' || cast(cast(floor(epoch(requested_at) / 30) as bigint) as varchar)), 1, 12) as job from request"))
def hash_job_id(spark, sf_dir):
    register(spark, sf_dir, "request")
    bucket = F.floor(F.unix_seconds("requested_at") / 30).cast("string")
    return spark.table("request").select("id", F.substring(F.sha2(F.concat(F.col("id").cast("string"), F.lit(":"), bucket), 256), 1, 12).alias("job"))


@query("agg_fingerprint", with_views("select reporter, substr(sha256(string_agg(cast(id as varchar) || status, '|' order by id)), 1, 16) as print from hazard group by reporter"))
def agg_fingerprint(spark, sf_dir):
    rows = F.transform(F.sort_array(F.collect_list(F.struct("id", "status"))), lambda r: F.concat(r["id"].cast("string"), r["status"]))
    return hazards(spark, sf_dir).groupBy("reporter").agg(F.substring(F.sha2(F.array_join(rows, "|"), 256), 1, 16).alias("print"))


offline_bundle = shared(
    "offline_bundle",
    "select 'hazard' as kind, id, round(lat, 6) as lat, round(lon, 6) as lon from hazard where lat between 52.47e0 and 52.49e0 and lon between -1.93e0 and -1.90e0 union all select 'asset', id, round(lat, 6), round(lon, 6) from asset where lat between 52.47e0 and 52.49e0 and lon between -1.93e0 and -1.90e0",
    "hazard", "asset",
)
safe_haven = shared("safe_haven", "select id, name from asset where asset_type in ('amenity:toilets', 'railway:station') and name <> ''", "asset")
geocode_seed = shared("geocode_seed", "select id, name from asset where lower(name) like '%0001%'", "asset")


@query("sink_geojson")
def sink_geojson(spark, sf_dir):
    """One GeoJSON feature a hazard."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct("id", "hazard_type", "status").alias("properties")))
    return hazards(spark, sf_dir).select("id", feature.alias("feature"))


@query("overpass_count", with_views("select count(*) filter (where lighting > 0.5e0) as lamps, count(*) filter (where has_crossing) as crossings from edge"))
def overpass_count(spark, sf_dir):
    return edges(spark, sf_dir).agg(F.count_if(F.col("lighting") > 0.5).alias("lamps"), F.count_if("has_crossing").alias("crossings"))
