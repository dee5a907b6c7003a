"""Answers that hold all their rows."""

from __future__ import annotations

import duckdb

import __spark_entry__


def test_union_is_not_capped(spark, tmp_path):
    """9000 reports, 3000 of them from the map: all come back."""
    duckdb.connect().execute(f"copy (select range as event_id, 'view' as event_type, timestamp '2024-01-01' as ts, range as user_id, 1e0 as value from range(9000)) to '{tmp_path}/events.parquet' (format parquet)")
    rows = __spark_entry__.queries()["set_union_all"](spark, str(tmp_path)).groupBy("ord").count().collect()
    assert {r["ord"]: r["count"] for r in rows} == {0: 3000, 1: 6000}


def test_duplicates_as_classes_lose_no_pair(spark, tmp_path):
    """Against all pairs of 1402 reports at two places for each of the types: rows grow with the reports, links stay."""
    con = duckdb.connect()
    con.execute(f"copy (select case when range < 1400 then (range // 2) * 701 + 3 + range % 2 * 19 else range end as event_id, 'view' as event_type, timestamp '2024-01-01' as ts, range as user_id, 1e0 as value from range(1402)) to '{tmp_path}/events.parquet' (format parquet)")
    rows = __spark_entry__.queries()["set_duplicates"](spark, str(tmp_path)).collect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    from stepfree.functions import sqltext as sql
    from stepfree.views import with_views

    every = con.execute(with_views(f"select a.id, b.id from hazard a join hazard b on a.id < b.id and a.hazard_type = b.hazard_type where {sql.haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 75")).fetchall()
    first = {r["other"]: r["id"] for r in rows if r["same_place"]}
    pairs = {(r["id"], r["other"]) for r in rows if not r["same_place"]}
    ids = [r[0] for r in con.execute("select event_id from events order by 1").fetchall()]
    of = {i: first.get(i, i) for i in ids}
    ours = {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if of[a] == of[b] or (min(of[a], of[b]), max(of[a], of[b])) in pairs}
    assert ours == set(every) and len(every) > 100_000 and len(rows) < 2 * len(ids)
