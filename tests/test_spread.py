"""Distance joins, and what rides on them: nothing as large as the map is broadcast, and rows of one place count as they are."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from stepfree.spatial import first_of_place, nearest

DATA = os.environ.get("STEPFREE_TEST_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", ["join_distance", "join_knn", "agg_hazard_risk", "agg_infra_risk"])
def test_no_side_is_broadcast(spark, name):
    """The plan, before anything ran."""
    plan = __spark_entry__.queries()[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_prompts_meet_their_texts_unbroadcast(spark):
    plan = __spark_entry__.queries()["geo_nav_prompt"](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin [trip") >= 2


def test_crowded_places(spark):
    """Of rows at one place the smallest ids are the nearest; other places keep theirs."""
    left = spark.createDataFrame([(1, 52.0, -1.0)], "id long, lat double, lon double")
    right = spark.createDataFrame([(k, 52.0, -1.0) for k in range(9, 0, -1)] + [(0, 52.0001, -1.0)], "r_id long, r_lat double, r_lon double")
    assert sorted(r["r_id"] for r in nearest(left, first_of_place(right, 3), "id", 50.0, k=3).collect()) == [1, 2, 3]
    assert first_of_place(right, 3).count() == 4


def test_small_tables_are_dealt_to_tasks(spark):
    """Places, and the rows that map files are written from, lie in as many tasks as there are cores, and in more once their rows need it."""
    from stepfree.operators import places
    from stepfree.shared import dealt
    from stepfree.sources import osm

    data, cores = "/root/testdata/sf0.001", spark.sparkContext.defaultParallelism
    assert all(df.rdd.getNumPartitions() >= cores for df in (places.places(spark, data), *osm.extract(spark, data)))
    many = dealt(spark.range(0, 1000, 1, 1), "id", rows=50)
    assert many.rdd.getNumPartitions() == 20 and max(many.rdd.glom().map(len).collect()) < 100 and many.count() == 1000


def test_alerts_are_made_by_many_tasks(spark):
    """Few rows meet in the last join and very many come out: its tasks are not put together for the few."""
    from stepfree.operators import profiles

    alerts = profiles.stream_alerts(spark, "/root/testdata/sf0.001")
    assert alerts.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert alerts.groupBy("route_id", "hazard_id").count().where("count > 1").isEmpty()
