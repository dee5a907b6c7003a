"""The keys of a class are worked out once, however many passes go over them."""

from __future__ import annotations

from stepfree.llm import jaccard


def test_passes_read_stored_keys(spark):
    full = spark.createDataFrame([(5, 0, [(1, 1, [7, 8])]), (5, 1, [(1, 1, [7, 8])]), (6, 1, [(1, 1, [9])]), (4, 0, [])], "cls long, task int, keys array<struct<ring:int,need:int,keys:array<long>>>")
    once = jaccard.once_keyed(full, full.select("cls", "task"))
    assert sorted((r.cls, r["keys"][0]["keys"]) for r in once.collect()) == [(5, [7, 8]), (6, [9])]
    assert "Join" not in once._jdf.queryExecution().optimizedPlan().toString()
