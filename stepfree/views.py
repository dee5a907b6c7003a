"""Accessible-mobility tables as views over the driver tables.

One SQL text for each view runs on Spark and on DuckDB, so that a query and its oracle
start from the same rows. ``register`` creates temporary views; ``with_views`` puts the
same texts in front of a DuckDB query as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
TEXT_TABLES = ("documents", "labels")

#: View name -> SQL; a view may use those above it.
VIEWS: dict[str, str] = {
    "hazard": """
select event_id as id, 52.45e0 + (event_id % 701) / 10000e0 as lat, -1.95e0 + ((event_id * 37) % 701) / 10000e0 as lon,
  case event_type when 'error' then 'missing curb ramp' when 'view' then 'gravel' when 'click' then 'poor-lighting'
                  when 'signup' then 'pothole' else 'unknown thing' end as hazard_type,
  case event_id % 8 when 0 then 'reported' when 1 then 'under_review' when 2 then 'verified' when 3 then 'action_planned'
       when 4 then 'in_progress' when 5 then 'resolved' when 6 then 'rejected' else 'duplicate' end as status,
  case when event_id % 3 = 0 then 'osm' else 'user' end as source,
  cast(ts as timestamp) as reported_at, user_id as reporter, value as amount from events""",
    "node": """
select p_partkey as id, 52.48e0 + floor(p_partkey / 40e0) * 0.0005e0 as lat, -1.90e0 + (p_partkey % 40) * 0.0008e0 as lon from part""",
    "edge": """
select a.p_partkey * 4 + s.k as id,
  case when s.k % 2 = 0 then a.p_partkey else a.p_partkey + case when s.k < 2 then 1 else 40 end end as src,
  case when s.k % 2 = 0 then a.p_partkey + case when s.k < 2 then 1 else 40 end else a.p_partkey end as dst,
  case when s.k < 2 then 50e0 + a.p_size else 40e0 + a.p_size * 2 end as dist,
  case a.p_size % 8 when 0 then 'asphalt' when 1 then 'paved' when 2 then 'gravel' when 3 then 'cobblestone' when 4 then 'concrete'
       when 5 then 'unknown' when 6 then 'sand' else 'paving_stones' end as surface,
  case a.p_partkey % 6 when 0 then 'good' when 1 then 'bad' when 2 then 'intermediate' when 3 then 'excellent' when 4 then 'very_bad' else null end as smoothness,
  case when a.p_size % 5 = 0 then null else 0.6e0 + (a.p_size % 19) / 10e0 end as width_m,
  (a.p_size % 7) / 100e0 as kerb_height, a.p_partkey % 11 = 0 as has_stairs, a.p_partkey % 13 = 0 as has_barrier, a.p_partkey % 9 = 0 as is_steep,
  a.p_partkey % 17 = 0 as is_under_construction, a.p_partkey % 3 = 0 as has_crossing,
  case a.p_partkey % 4 when 0 then 0.95e0 when 1 then 0.55e0 when 2 then 0.1e0 else 0.45e0 end as lighting,
  case a.p_partkey % 19 when 0 then 'access=no' when 1 then 'access=private;foot=yes' else null end as access
from part a cross join (select 0 as k union all select 1 union all select 2 union all select 3) s
where (s.k < 2 and a.p_partkey % 40 < 39 and a.p_partkey + 1 <= (select max(p_partkey) from part))
   or (s.k >= 2 and a.p_partkey + 40 <= (select max(p_partkey) from part))""",
    "asset": """
select s_suppkey as id, case s_nationkey % 4 when 0 then 'amenity:toilets' when 1 then 'highway:elevator' when 2 then 'barrier:kerb' else 'railway:station' end as asset_type,
  52.47e0 + (s_suppkey % 97) / 2000e0 as lat, -1.93e0 + (s_suppkey % 89) / 1500e0 as lon,
  s_acctbal as balance, 'osm' as source_system, s_name as name from supplier""",
    "incident": """
select event_id as id, 52.45e0 + (event_id % 701) / 10000e0 as lat, -1.95e0 + ((event_id * 37) % 701) / 10000e0 as lon from events where event_type = 'error'""",
    "fixture": """
select e.id, 'lamp' as kind, n.lat, n.lon from edge e join node n on n.id = e.src where e.lighting >= 0.95e0
union all select id, 'camera', lat, lon from asset where asset_type = 'railway:station'""",
    "request": """
select o_orderkey as id, o_custkey % 1000 as start_node, (o_custkey * 7 + o_orderkey) % 1000 as end_node,
  case substr(o_orderpriority, 1, 1) when '1' then 'manual-wheelchair' when '2' then 'power-wheelchair' when '3' then 'stroller' else 'standard' end as profile,
  (o_orderkey % 101) / 100e0 as safety_weight, o_totalprice as price, cast(o_orderdate as timestamp) as requested_at from orders""",
    "refresh_token": """
select o_orderkey as id, o_custkey as user_id, cast(o_orderdate as timestamp) + interval '30' day as expires_at, o_orderstatus = 'F' as revoked from orders""",
    "prediction": """
select d.doc_id as id, d.lang as task, d.source as city, l.quality as target, (d.doc_id * 7919 % 1009) / 1009e0 as score_a, (d.doc_id * 104729 % 997) / 997e0 as score_b
from labels l join documents d on l.doc_id = d.doc_id""",
    "metric": """
select event_id as id, cast(ts as timestamp) as ts, event_type as name, user_id, value from events""",
    "route_alternative": """
select o.o_orderkey as request_id, k.alt, 400e0 + (o.o_orderkey * (k.alt + 3)) % 977 as distance_m, (300e0 + (o.o_orderkey * (k.alt + 5)) % 577) as duration_s,
  ((o.o_orderkey * (k.alt + 1)) % 300) / 10e0 as risk, ((o.o_orderkey + k.alt) % 9) / 2e0 as obstacle
from orders o cross join (select 0 as alt union all select 1 union all select 2) k""",
}


def needed(names: set[str]) -> list[str]:
    """The views of ``names`` and those they use, in order."""
    order = list(VIEWS)
    todo, found = list(names), set()
    while todo:
        name = todo.pop()
        if name in found or name not in VIEWS:
            continue
        found.add(name)
        todo += [v for v in order if re.search(rf"\b{v}\b", VIEWS[name])]
    return [v for v in order if v in found]


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Temporary views of the driver tables that the named views read, and of these views (all, if none is named)."""
    chosen = needed(set(names) or set(VIEWS))
    text = " ".join(VIEWS[v] for v in chosen) + " " + " ".join(names)
    for table in (*BASE_TABLES, *TEXT_TABLES):
        if not names or re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    for name in chosen:
        spark.sql(VIEWS[name]).createOrReplaceTempView(name)


def with_views(sql: str) -> str:
    """``sql`` for DuckDB, with the views it reads in front."""
    chosen = needed({v for v in VIEWS if re.search(rf"\b{v}\b", sql)})
    ctes = [f"{v} as ({VIEWS[v]})" for v in chosen]
    body = sql.strip()
    if body.lower().startswith("with recursive"):
        return f"with recursive {', '.join(ctes)}, {body[14:]}" if ctes else body
    if body.lower().startswith("with "):
        return f"with {', '.join(ctes)}, {body[5:]}" if ctes else body
    return f"with {', '.join(ctes)} {body}" if ctes else body
