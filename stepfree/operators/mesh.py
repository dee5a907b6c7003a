"""Synthetic meshes: where no mapped way is, a grid between both ends of a trip, joined to its eight neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.functions import geo, risk
from stepfree.functions import sqltext as sql
from stepfree.registry import query
from stepfree.views import register, with_views

#: Straight metres from which on steps of latitude and longitude hold; steps added around both ends; most rows and columns.
STEPS = ((50_000.0, 0.02, 0.03), (10_000.0, 0.005, 0.007), (0.0, 0.0007, 0.0010))
MARGIN, MOST = 5, 150
#: Shares of surfaces up to each limit; chances of stairs, a crossing, construction and steepness.
SURFACES = ((0.70, "asphalt"), (0.85, "paving_stones"), (0.92, "cobblestone"), (0.97, "gravel"), (1.0, "unpaved"))
CHANCES = {"has_stairs": 0.03, "has_crossing": 0.25, "is_under_construction": 0.02, "is_steep": 0.05}
START, END = 0, -1
#: Degrees of a cell in which hazards count.
HAZARD_CELL = 0.002


def drawn(place: Column, k: int) -> Column:
    """A number from 0 to 1 that a place (a text) always draws."""
    return F.conv(F.substring(F.md5(F.concat(place, F.lit(f":{k}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def grids(trips: DataFrame) -> DataFrame:
    """``trips`` (id, lat0, lon0, lat1, lon1) with the grid of each: dlat, dlon, south, west, rows, cols (the highest numbers; MOST at most)."""
    direct = geo.haversine(F.col("lat0"), F.col("lon0"), F.col("lat1"), F.col("lon1"))
    step = lambda at: F.when(F.col("__m") > STEPS[0][0], STEPS[0][at]).when(F.col("__m") > STEPS[1][0], STEPS[1][at]).otherwise(STEPS[2][at])
    df = trips.withColumn("__m", direct).withColumns({"dlat": step(1), "dlon": step(2)})
    df = df.withColumns({"south": F.least("lat0", "lat1") - F.col("dlat") * MARGIN, "west": F.least("lon0", "lon1") - F.col("dlon") * MARGIN})
    high = lambda a, b, low, d: F.least(F.ceil((F.greatest(a, b) + F.col(d) * MARGIN - F.col(low)) / F.col(d)), F.lit(MOST))
    return df.withColumns({"rows": high("lat0", "lat1", "south", "dlat"), "cols": high("lon0", "lon1", "west", "dlon")}).drop("__m")


def meshes(trips: DataFrame, hazards: DataFrame) -> DataFrame:
    """Arcs id, src, dst, dist, base_safety, surface, lighting and flags of every trip's mesh.

    Points are numbered from 1, row by row; START and END stand for both ends, which are joined, both ways, with the points around the one nearest
    to them. Attributes are drawn by an arc's middle, so they are the same at every run, both ways and in all meshes. ``base_safety`` is the risk of the active
    hazards (lat, lon, severity) in the middle's cell, which meet the arcs by equality. A trip makes at most 151 * 151 * 8 arcs, where it is read.
    """
    around = F.array(*[F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y in (-1, 0, 1) for x in (-1, 0, 1) if y or x])
    inside = F.col("y2").between(0, F.col("rows")) & F.col("x2").between(0, F.col("cols"))
    number = lambda y, x: F.col(y) * (F.col("cols") + 1) + F.col(x) + 1
    lat, lon = (lambda y: F.col("south") + F.col(y) * F.col("dlat")), (lambda x: F.col("west") + F.col(x) * F.col("dlon"))
    g = grids(trips)
    p = g.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows")))).withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cols")))).withColumn("d", F.explode(around))
    p = p.withColumns({"y2": F.col("y") + F.col("d.dy"), "x2": F.col("x") + F.col("d.dx")}).where(inside)
    p = p.select("id", number("y", "x").alias("src"), number("y2", "x2").alias("dst"), lat("y").alias("alat"), lon("x").alias("alon"), lat("y2").alias("blat"), lon("x2").alias("blon"))
    p = p.withColumns({"mlat": (F.col("alat") + F.col("blat")) / 2, "mlon": (F.col("alon") + F.col("blon")) / 2})
    cells = hazards.groupBy(geo.cell(F.col("lat"), HAZARD_CELL).alias("cy"), geo.cell(F.col("lon"), HAZARD_CELL).alias("cx")).agg(F.count("*").alias("n"), F.sum("severity").alias("total"))
    p = p.join(cells, (geo.cell(F.col("mlat"), HAZARD_CELL) == F.col("cy")) & (geo.cell(F.col("mlon"), HAZARD_CELL) == F.col("cx")), "left")
    place = F.concat(F.round(F.col("mlat") * 100_000).cast("long"), F.lit(","), F.round(F.col("mlon") * 100_000).cast("long"))
    p = p.withColumn("place", place).withColumn("u0", drawn(F.col("place"), 0))
    surface = F.lit(SURFACES[-1][1])
    for limit, name in reversed(SURFACES[:-1]):
        surface = F.when(F.col("u0") < limit, name).otherwise(surface)
    dist = geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon"))
    flags = [(drawn(F.col("place"), k) < chance).alias(name) for k, (name, chance) in enumerate(CHANCES.items(), 1)]
    safety = risk.normalised(F.coalesce("total", F.lit(0.0)), F.coalesce("n", F.lit(0)))
    grid = p.select("id", "src", "dst", dist.alias("dist"), safety.alias("base_safety"), surface.alias("surface"), (0.4 + 0.6 * drawn(F.col("place"), 5)).alias("lighting"), *flags)

    ends = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.col(f"lat{i}").alias("lat"), F.col(f"lon{i}").alias("lon")) for i, k in ((0, START), (1, END))])
    e = g.withColumn("e", F.explode(ends)).withColumn("d", F.explode(around))
    near = lambda c, low, d, most: F.greatest(F.lit(0), F.least(F.rint((F.col(f"e.{c}") - F.col(low)) / F.col(d)).cast("long"), F.col(most)))
    e = e.withColumns({"y2": near("lat", "south", "dlat", "rows") + F.col("d.dy"), "x2": near("lon", "west", "dlon", "cols") + F.col("d.dx")}).where(inside)
    e = e.withColumns({"at": number("y2", "x2"), "dist": geo.haversine(F.col("e.lat"), F.col("e.lon"), lat("y2"), lon("x2"))})
    both = F.explode(F.array(F.struct(F.col("e.k").alias("src"), F.col("at").alias("dst")), F.struct(F.col("at").alias("src"), F.col("e.k").alias("dst"))))
    e = e.select("id", both.alias("arc"), "dist").select("id", "arc.*", "dist", F.lit(0.1).alias("base_safety"), F.lit("asphalt").alias("surface"), F.lit(0.8).alias("lighting"), *[F.lit(False).alias(name) for name in CHANCES])
    return grid.unionByName(e)


#: Requests between the same two cells (0.02 degrees) share a mesh, from the middle of all their starts to that of their ends.
_TRIPS = """select concat(cast(floor(a.lat / 0.02e0) as bigint), ',', cast(floor(a.lon / 0.02e0) as bigint), '-', cast(floor(b.lat / 0.02e0) as bigint), ',', cast(floor(b.lon / 0.02e0) as bigint)) as id,
 round(avg(a.lat), 6) as lat0, round(avg(a.lon), 6) as lon0, round(avg(b.lat), 6) as lat1, round(avg(b.lon), 6) as lon1 from request r join node a on a.id = r.start_node join node b on b.id = r.end_node group by 1"""
_U = lambda k: f"(('0x' || substr(md5(place || ':{k}'), 1, 8))::bigint / 4294967296e0)"


def _at(y: str, x: str) -> tuple[str, str]:
    return f"(south + {y} * dlat)", f"(west + {x} * dlon)"


@query("graph_mesh", with_views(f"""with t as ({_TRIPS}), m as (select *, {sql.haversine('lat0', 'lon0', 'lat1', 'lon1')} as m from t), s as (select *, case when m > 50000 then 0.02e0 when m > 10000 then 0.005e0 else 0.0007e0 end as dlat, case when m > 50000 then 0.03e0 when m > 10000 then 0.007e0 else 0.001e0 end as dlon from m),
o as (select *, least(lat0, lat1) - dlat * 5 as south, least(lon0, lon1) - dlon * 5 as west from s), g as (select *, least(150, ceil((greatest(lat0, lat1) + dlat * 5 - south) / dlat))::bigint as nr, least(150, ceil((greatest(lon0, lon1) + dlon * 5 - west) / dlon))::bigint as nc from o),
y as (select *, unnest(range(0, nr + 1)) as y from g), x as (select *, unnest(range(0, nc + 1)) as x from y), d as (select * from (select unnest([-1, 0, 1]) as dy), (select unnest([-1, 0, 1]) as dx) where dy <> 0 or dx <> 0),
n as (select x.*, y + dy as y2, x + dx as x2, south + y * dlat as alat, west + x * dlon as alon, south + (y + dy) * dlat as blat, west + (x + dx) * dlon as blon from x, d where y + dy between 0 and nr and x + dx between 0 and nc),
h as (select floor(lat / 0.002e0)::bigint as cy, floor(lon / 0.002e0)::bigint as cx, count(*) as n, sum({sql.severity('hazard_type')}) as total from hazard where status in ({sql.quoted(risk.ACTIVE)}) group by 1, 2),
q as (select *, (alat + blat) / 2 as mlat, (alon + blon) / 2 as mlon from n), p as (select *, round(mlat * 100000)::bigint || ',' || round(mlon * 100000)::bigint as place from q left join h on cy = floor(mlat / 0.002e0)::bigint and cx = floor(mlon / 0.002e0)::bigint),
e as (select g.*, k, case when k = 0 then lat0 else lat1 end as elat, case when k = 0 then lon0 else lon1 end as elon, dy, dx from g, (select unnest([0, -1]) as k), d),
f as (select *, greatest(0, least(nr, round_even((elat - south) / dlat, 0)::bigint)) + dy as y2, greatest(0, least(nc, round_even((elon - west) / dlon, 0)::bigint)) + dx as x2 from e),
a as (select id, k, y2 * (nc + 1) + x2 + 1 as pt, {sql.haversine('elat', 'elon', *_at('y2', 'x2'))} as dist from f where y2 between 0 and nr and x2 between 0 and nc)
select id, (y * (nc + 1) + x + 1)::bigint as src, (y2 * (nc + 1) + x2 + 1)::bigint as dst, round({sql.haversine('alat', 'alon', 'blat', 'blon')}, 3) as dist, round({sql.normalised('coalesce(total, 0)', 'coalesce(n, 0)')}, 6) as base_safety,
 case {' '.join(f"when {_U(0)} < {limit}e0 then '{name}'" for limit, name in SURFACES)} end as surface, round(0.4e0 + 0.6e0 * {_U(5)}, 6) as lighting, {', '.join(f'{_U(k)} < {c}e0 as {name}' for k, (name, c) in enumerate(CHANCES.items(), 1))} from p
union all select id, k, pt, round(dist, 3), 0.1e0, 'asphalt', 0.8e0, false, false, false, false from a union all select id, pt, k, round(dist, 3), 0.1e0, 'asphalt', 0.8e0, false, false, false, false from a"""))
def graph_mesh(spark, sf_dir):
    """Meshes for all requests, one for each pair of cells between which requests go."""
    register(spark, sf_dir, "request", "node", "hazard")
    active = spark.table("hazard").where(risk.is_active(F.col("status"))).select("lat", "lon", risk.severity(F.col("hazard_type")).alias("severity"))
    out = meshes(spark.sql(_TRIPS), active)
    return out.select("id", "src", "dst", F.round("dist", 3).alias("dist"), F.round("base_safety", 6).alias("base_safety"), "surface", F.round("lighting", 6).alias("lighting"), *CHANCES)
