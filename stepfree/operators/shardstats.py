"""Profile of a stored graph: sizes of shards, how requests share them, quality gates, and how throughput scales."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.operators.graph import _MID, graph, sharded
from stepfree.operators.intake import _CELLS, SIZE, shard_regions
from stepfree.registry import query
from stepfree.running import running
from stepfree.shared import stored
from stepfree.views import register, with_views

CELL = ("cell_y", "cell_x")
#: What an edge takes in a text artifact: its whole-number and text fields, a comma after each.
_LINE = "length(concat(id, ',', src, ',', dst, ',', surface, ',', coalesce(smoothness, ''), ',', coalesce(access, ''), ','))"


def percentile_nearest(df: DataFrame, by: list[str], value: str, share: float) -> DataFrame:
    """``by`` and ``value`` at place ceil(share * n), of the values that are not null; a group without one has no row. Places run over distinct values, cut by ranges."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    placed = running(counted, by, [F.asc(value)], last=("sum", "n"))
    place = F.greatest(F.lit(1), F.ceil(F.lit(min(1.0, max(0.0, share))) * F.col("total_last")))
    return placed.where((F.col("last") >= place) & (F.col("last") - F.col("n") < place)).select(*by, value)


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell_y, cell_x, nodes, edges, bytes of every shard of the graph (an edge lies where its middle lies; nodes are those edges start from)."""
    own = sharded(*graph(spark, sf_dir), SIZE).withColumnsRenamed({"shard_y": "cell_y", "shard_x": "cell_x"})
    return own.groupBy(*CELL).agg(F.countDistinct("src").alias("nodes"), F.count("*").alias("edges"), F.sum(F.expr(_LINE)).alias("bytes"))


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """request_id, cell_y, cell_x: the cells that every request loads; regions too large for cells are left to the whole graph."""
    cell = lambda c: F.round(F.col(c) / SIZE).cast("long")
    cells = shard_regions(spark, sf_dir).where(F.col("max_lon") - F.col("min_lon") < SIZE * 1.5)
    return cells.select("request_id", cell("min_lat").alias("cell_y"), cell("min_lon").alias("cell_x"))


_SHARDS = f"{_MID}, z as (select floor(mid_lat / {SIZE}e0)::bigint as cell_y, floor(mid_lon / {SIZE}e0)::bigint as cell_x, count(distinct src) as nodes, count(*) as edges, sum({_LINE})::bigint as bytes from mid group by 1, 2)"
_LOADS = f"w as (select request_id, round(min_lat / {SIZE}e0)::bigint as cell_y, round(min_lon / {SIZE}e0)::bigint as cell_x from f where max_lon - min_lon < {SIZE * 1.5}e0)"
_SHARDED = f"{_CELLS}, {_SHARDS}, {_LOADS}, l as (select w.request_id, z.* from w join z on z.cell_y = w.cell_y and z.cell_x = w.cell_x)"


@query("agg_shard_stats", with_views(f"""{_SHARDED}, r as (select request_id, count(*) as shards from l group by 1), n as (select *, row_number() over (order by bytes) as place, count(*) over () as n from z), m as (select *, row_number() over (order by shards) as place, count(*) over () as n from r)
select (select count(*) from z)::bigint as shards, (select sum(edges) from z)::bigint as edges, (select sum(bytes) from z)::bigint as bytes, (select max(bytes) from z)::bigint as max_bytes, (select max(nodes) from z)::bigint as max_nodes, (select round(avg(edges), 2) from z) as avg_edges,
 (select bytes from n where place = greatest(1, ceil(0.95e0 * n)))::bigint as p95_bytes, (select count(*) from l)::bigint as references_, (select count(*) from (select distinct cell_y, cell_x from l))::bigint as distinct_references,
 (select round(1 - (select count(*) from (select distinct cell_y, cell_x from l))::double / count(*), 4) from l) as reuse_ratio, (select round(avg(shards), 2) from r) as avg_shards, (select max(shards) from r)::bigint as max_shards,
 (select shards from m where place = greatest(1, ceil(0.95e0 * n)))::bigint as p95_shards"""))
def agg_shard_stats(spark, sf_dir):
    """One row: number and size of the shards, and how the shards that requests load repeat (reuse: 1 - distinct / all)."""
    sizes = stored(shard_sizes(spark, sf_dir), "sizes")
    used = stored(loads(spark, sf_dir).join(sizes.select(*CELL), [*CELL]).groupBy("request_id", *CELL).agg(F.count("*").alias("n")), "loads")
    whole = sizes.agg(
        F.count("*").alias("shards"), F.sum("edges").alias("edges"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("max_bytes"), F.max("nodes").alias("max_nodes"), F.round(F.avg("edges"), 2).alias("avg_edges")
    )
    by_request = used.groupBy("request_id").agg(F.count("*").alias("shards"))
    of_requests = by_request.agg(F.coalesce(F.sum("shards"), F.lit(0)).alias("references_"), F.round(F.avg("shards"), 2).alias("avg_shards"), F.max("shards").alias("max_shards"))
    distinct = used.select(*CELL).distinct().agg(F.count("*").alias("distinct_references"))
    high = lambda df, c, name: percentile_nearest(df.withColumn("all", F.lit(1)), ["all"], c, 0.95).agg(F.max(c).alias(name))
    out = whole
    for one in (of_requests, distinct, high(sizes, "bytes", "p95_bytes"), high(by_request, "shards", "p95_shards")):
        out = out.crossJoin(F.broadcast(one))  # a row each
    ratio = F.when(F.col("references_") > 0, F.round(1 - F.col("distinct_references") / F.col("references_"), 4)).otherwise(0.0)
    return out.withColumn("reuse_ratio", ratio)


# gates

#: Limits of the gates.
LIMITS = {
    "payload_bytes": 8 * 1024 * 1024, "artifact_bytes": 32 * 1024 * 1024, "cold_ms": 2000.0, "hot_ms": 100.0, "pack_ms": 750.0, "store_read_ms": 150.0, "unpack_ms": 150.0, "shards": 64,
    "alt_edges": 25_000, "distributed_bytes": 8 * 1024 * 1024,
}


def quality_gates(routes: DataFrame, sources: DataFrame, by: list[str], limits: dict[str, float] = LIMITS, landmarks: bool = True, persist: bool = True) -> DataFrame:
    """A row for each row of ``sources``: figures of its routes, warnings of the thirteen gates, whether it passed (no warning).

    ``routes``: ``by``, shards, edges, truncated, has_landmarks, artifact_bytes, payload_bytes, cold_ms, hot_ms, preprocess_ms, pack_ms, store_read_ms, unpack_ms; an unknown time counts as 0.
    ``sources``: ``by``, truncated, shards, persisted. Payloads up to ``distributed_bytes`` go to a shared cache (0: any), and only theirs are held to
    the limits of hot loads, store reads and unpacking. ``landmarks``: these are expected up to ``alt_edges`` edges; ``persist``: all shards should be stored.
    A source without routes has figures of 0 and passes but for its own gates.
    """
    cap = limits["distributed_bytes"]
    cached = F.lit(True) if cap <= 0 else F.col("payload_bytes") <= cap
    highest = lambda c: F.coalesce(F.max(c), F.lit(0))
    figures = routes.withColumn("cached", cached).groupBy(*by).agg(
        F.count("*").alias("routes"), F.coalesce(F.max("truncated"), F.lit(False)).alias("cut"), F.round(F.avg("shards"), 2).alias("avg_shards"),
        *[highest(c).alias(f"max_{c}") for c in ("payload_bytes", "artifact_bytes", "cold_ms", "preprocess_ms", "pack_ms", "shards")],
        *[highest(F.when(F.col("cached"), F.col(c))).alias(f"cached_{c}") for c in ("hot_ms", "store_read_ms", "unpack_ms")],
        F.count_if(~F.col("cached")).alias("oversized"), F.count_if((F.col("edges") <= limits["alt_edges"]) & ~F.col("has_landmarks")).alias("unprepared"),
    )
    df = sources.withColumnsRenamed({"shards": "source_shards", "truncated": "source_cut"}).join(figures, by, "left")
    for c in (x for x in figures.columns if x not in by):
        df = df.withColumn(c, F.coalesce(c, F.lit(False) if c == "cut" else F.lit(0)))
    for c in ("hot_ms", "unpack_ms"):
        high = percentile_nearest(routes.withColumn(c, F.coalesce(c, F.lit(0.0))), by, c, 0.95).withColumnRenamed(c, f"p95_{c}")
        df = df.join(high, by, "left").withColumn(f"p95_{c}", F.coalesce(f"p95_{c}", F.lit(0.0)))

    def above(value: str, limit: str, name: str, form: str = "0.0", unit: str = "ms") -> Column:
        shown = lambda x: F.expr(f"format_number({x}, '{form}')")
        return F.when(F.col(value) > limits[limit], F.concat(F.lit(f"{name} "), shown(value), F.lit(f"{unit} exceeds "), shown(limits[limit]), F.lit(unit)))

    warnings = (
        F.when(F.col("source_cut"), "source graph was truncated before profiling completed"),
        F.when(F.col("cut"), "at least one profiled route graph slice was truncated"),
        above("max_payload_bytes", "payload_bytes", "max payload", "0", " bytes"),
        above("max_artifact_bytes", "artifact_bytes", "max artifact", "0", " bytes"),
        above("max_cold_ms", "cold_ms", "max cold graph load"),
        above("cached_hot_ms", "hot_ms", "max cacheable hot graph load"),
        above("max_pack_ms", "pack_ms", "max artifact pack"),
        above("cached_store_read_ms", "store_read_ms", "max cacheable artifact store read"),
        above("cached_unpack_ms", "unpack_ms", "max cacheable artifact unpack"),
        above("max_shards", "shards", "max source shards per route", "0", ""),
        F.when(F.col("oversized") > 0, F.format_string("%d route bundle(s) exceed the limit of distributed payloads and will not be cached", F.col("oversized"))),
        F.when(F.lit(landmarks) & (F.col("unprepared") > 0), "landmarks were expected but missing on at least one eligible route slice"),
        F.when(F.lit(persist) & (F.col("source_shards") > 0) & (F.col("persisted") < F.col("source_shards")), F.format_string("only %d/%d source shards were persisted", F.col("persisted"), F.col("source_shards"))),
    )
    shown = ("routes", "avg_shards", "max_shards", "max_payload_bytes", "max_artifact_bytes", "max_preprocess_ms", "max_pack_ms", "p95_hot_ms", "p95_unpack_ms")
    return df.withColumn("warnings", F.array_compact(F.array(*warnings))).select(*by, *shown, "warnings", (F.size("warnings") == 0).alias("passed"))


#: Limits that part of the given data exceeds, as the tables are small.
TIGHT = LIMITS | {"payload_bytes": 40_000, "artifact_bytes": 150_000, "cold_ms": 99.5, "hot_ms": 99.0, "pack_ms": 750.0, "store_read_ms": 98.0, "shards": 9, "alt_edges": 500, "distributed_bytes": 60_000}
_TIMES = "select id, value as cold_ms, case when name <> 'error' then value end as hot_ms, user_id as preprocess_ms, value * 5 as pack_ms, case when name = 'view' then value end as store_read_ms, case when name = 'click' then value end as unpack_ms from metric"
_MS = ("cold_ms", "hot_ms", "preprocess_ms", "pack_ms", "store_read_ms", "unpack_ms")


@query("agg_quality_gates", with_views(f"""{_SHARDED}, t as ({_TIMES}), s as (select request_id, count(*) as shards, sum(edges) as edges, sum(bytes) as bytes from l group by 1),
r as (select q.profile, s.shards, s.edges, s.edges > 3000 as truncated, s.shards % 4 > 0 as has_landmarks, s.bytes as artifact_bytes, s.bytes // 4 as payload_bytes, {', '.join(f'coalesce(t.{c}, 0) as {c}' for c in _MS)}, s.bytes // 4 <= {TIGHT['distributed_bytes']} as cached from s join request q on q.id = s.request_id left join t on t.id = q.id),
o as (select *, row_number() over (partition by profile order by hot_ms) as hot_place, row_number() over (partition by profile order by unpack_ms) as unpack_place, count(*) over (partition by profile) as n from r),
figures as (select profile, count(*) as routes, bool_or(truncated) as cut, round(avg(shards), 2) as avg_shards, max(shards) as max_shards, max(payload_bytes) as mp, max(artifact_bytes) as ma, max(cold_ms) as mc, max(preprocess_ms) as pre, max(pack_ms) as pk, coalesce(max(hot_ms) filter (where cached), 0) as ch,
 coalesce(max(store_read_ms) filter (where cached), 0) as cs, coalesce(max(unpack_ms) filter (where cached), 0) as cu, count(*) filter (where not cached) as oversized, count(*) filter (where edges <= {TIGHT['alt_edges']} and not has_landmarks) as unprepared,
 max(hot_ms) filter (where hot_place = greatest(1, ceil(0.95e0 * n))) as p95_hot, max(unpack_ms) filter (where unpack_place = greatest(1, ceil(0.95e0 * n))) as p95_unpack from o group by profile),
z2 as (select count(*) as n, count(*) filter (where edges >= 100) as persisted from z)
select profile, routes, avg_shards, max_shards, round(p95_hot, 3) as p95_hot_ms, round(p95_unpack, 3) as p95_unpack_ms, array_to_string(w, '; ') as warnings, len(w) = 0 as passed from (select *, list_filter([case when profile = 'stroller' then 'source graph was truncated before profiling completed' end,
 case when cut then 'at least one profiled route graph slice was truncated' end, case when mp > {TIGHT['payload_bytes']} then 'max payload ' || mp || ' bytes exceeds {TIGHT['payload_bytes']} bytes' end, case when ma > {TIGHT['artifact_bytes']} then 'max artifact ' || ma || ' bytes exceeds {TIGHT['artifact_bytes']} bytes' end,
 case when mc > {TIGHT['cold_ms']} then printf('max cold graph load %.1fms exceeds {TIGHT['cold_ms']}ms', mc) end, case when ch > {TIGHT['hot_ms']} then printf('max cacheable hot graph load %.1fms exceeds {TIGHT['hot_ms']}ms', ch) end,
 case when pk > {TIGHT['pack_ms']} then printf('max artifact pack %.1fms exceeds {TIGHT['pack_ms']}ms', pk) end, case when cs > {TIGHT['store_read_ms']} then printf('max cacheable artifact store read %.1fms exceeds {TIGHT['store_read_ms']}ms', cs) end,
 case when cu > {TIGHT['unpack_ms']} then printf('max cacheable artifact unpack %.1fms exceeds {TIGHT['unpack_ms']}ms', cu) end, case when max_shards > {TIGHT['shards']} then 'max source shards per route ' || max_shards || ' exceeds {TIGHT['shards']}' end,
 case when oversized > 0 then oversized || ' route bundle(s) exceed the limit of distributed payloads and will not be cached' end, case when unprepared > 0 then 'landmarks were expected but missing on at least one eligible route slice' end,
 case when n > 0 and persisted < n then 'only ' || persisted || '/' || n || ' source shards were persisted' end], lambda x: x is not null) as w from figures cross join z2)"""))
def agg_quality_gates(spark, sf_dir):
    """The thirteen gates over the routes of every profile: shards, edges and bytes that their requests load, times from events."""
    register(spark, sf_dir, "request", "metric")
    sizes = stored(shard_sizes(spark, sf_dir), "sizes")
    used = loads(spark, sf_dir).join(sizes, [*CELL]).groupBy("request_id").agg(F.count("*").alias("shards"), F.sum("edges").alias("edges"), F.sum("bytes").alias("artifact_bytes"))
    routes = used.join(spark.table("request").select(F.col("id").alias("request_id"), "profile"), "request_id").join(spark.sql(_TIMES).withColumnRenamed("id", "request_id"), "request_id", "left")
    routes = routes.withColumns({
        "truncated": F.col("edges") > 3000, "has_landmarks": F.col("shards") % 4 > 0, "payload_bytes": F.floor(F.col("artifact_bytes") / 4), **{c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in _MS}
    })
    whole = sizes.agg(F.count("*").alias("shards"), F.count_if(F.col("edges") >= 100).alias("persisted"))
    sources = routes.select("profile").distinct().crossJoin(F.broadcast(whole)).withColumn("truncated", F.col("profile") == "stroller")
    out = quality_gates(stored(routes, "routes"), sources, ["profile"], TIGHT)
    return out.select(
        "profile", "routes", "avg_shards", "max_shards", F.round("p95_hot_ms", 3).alias("p95_hot_ms"), F.round("p95_unpack_ms", 3).alias("p95_unpack_ms"), F.array_join("warnings", "; ").alias("warnings"), "passed"
    )


# scalability

#: Steps of the grid of contention (to 0.2) and of crosstalk (to 0.05).
SIGMA, KAPPA = (0.0005, 401), (0.0001, 501)


def usl_fit(points: DataFrame) -> DataFrame:
    """gamma, sigma, kappa, peak and the throughput there of the scalability law gamma n / (1 + sigma (n - 1) + kappa n (n - 1)), by least squares over a grid.

    ``points``: n (load), x (throughput), any number of them. They are averaged by doublings of the load first, so the law is fitted to 64 points at most. gamma is
    the throughput for one of load at the lowest doubling. No peak (null) without crosstalk. No row without points.
    """
    tiers = points.where("n >= 1 and x is not null").groupBy(F.floor(F.log2("n")).alias("tier")).agg(F.avg("n").alias("n"), F.avg("x").alias("x"))
    one = tiers.agg(F.array_sort(F.collect_list(F.struct("n", "x"))).alias("p")).where(F.size("p") > 0)
    one = one.withColumn("gamma", F.element_at("p", 1)["x"] / F.element_at("p", 1)["n"])
    cells = F.broadcast(one).crossJoin(one.sparkSession.range(SIGMA[1] * KAPPA[1]))  # the points are one row
    cells = cells.withColumn("sigma", F.floor(F.col("id") / KAPPA[1]) * SIGMA[0]).withColumn("kappa", F.col("id") % KAPPA[1] * KAPPA[0])
    model = lambda n: F.col("gamma") * n / (1 + F.col("sigma") * (n - 1) + F.col("kappa") * n * (n - 1))
    err = F.aggregate("p", F.lit(0.0), lambda acc, q: acc + (q["x"] - model(q["n"])) * (q["x"] - model(q["n"])))
    best = cells.select("gamma", "sigma", "kappa", "id", F.round(err, 9).alias("err")).agg(F.min_by(F.struct("gamma", "sigma", "kappa"), F.struct("err", "id")).alias("b")).where("b is not null").select("b.*")
    peak = F.when(F.col("kappa") > 0.00001, F.sqrt((1 - F.col("sigma")) / F.col("kappa")))
    return best.withColumn("peak", peak).withColumn("at_peak", model(F.col("peak")))


_HOURS = "select count(*) as n, count(distinct user_id) as x from metric group by name, date_trunc('hour', ts)"


@query("agg_usl_fit", with_views(f"""with h as ({_HOURS}), p as (select avg(n) as n, avg(x) as x from h group by floor(log2(n))), g as (select arg_min(x, n) / min(n) as gamma from p),
c as (select s * 0.0005e0 as sigma, k * 0.0001e0 as kappa, s * 501 + k as id from (select unnest(range(0, 401)) as s), (select unnest(range(0, 501)) as k)),
e as (select gamma, sigma, kappa, id, round(sum((x - gamma * n / (1 + sigma * (n - 1) + kappa * n * (n - 1))) * (x - gamma * n / (1 + sigma * (n - 1) + kappa * n * (n - 1)))), 9) as err from c, p, g group by 1, 2, 3, 4),
b as (select *, case when kappa > 0.00001e0 then sqrt((1 - sigma) / kappa) end as peak from e order by err, id limit 1)
select round(gamma, 6) as gamma, round(sigma, 4) as sigma, round(kappa, 4) as kappa, round(peak, 4) as peak, round(gamma * peak / (1 + sigma * (peak - 1) + kappa * peak * (peak - 1)), 4) as at_peak from b"""))
def agg_usl_fit(spark, sf_dir):
    """How many users an hour serves as its events grow: the scalability law over all hours and kinds of events."""
    register(spark, sf_dir, "metric")
    fit = usl_fit(spark.sql(_HOURS))
    return fit.select(F.round("gamma", 6).alias("gamma"), *[F.round(c, 4).alias(c) for c in ("sigma", "kappa", "peak", "at_peak")])
