"""Keys are shuffled once to find those that several classes have, and crowded ones don't gather in a task."""

from __future__ import annotations

import re

import pytest

from stepfree.llm import common, jaccard

KEYED = "cls long, task int, keys array<struct<ring:int,need:int,keys:array<long>>>"


def keyed_rows(spark):
    """Key 1 of classes -3 to 8 (5 keyed by two tasks), key 2 of 6 and 7, and keys of one class; 9 is keyed twice and meets none."""
    rows = [(c, c % 3, [(4, 2, [1, 100 + c])]) for c in range(-3, 9)]
    rows += [(5, 7, [(4, 2, [1, 105])]), (6, 0, [(5, 1, [2])]), (7, 0, [(5, 1, [2])]), (9, 0, [(4, 2, [50])]), (9, 1, [(4, 2, [50])]), (None, 0, [])]
    return spark.createDataFrame(rows, KEYED)


@pytest.mark.parametrize(("crowded", "drawn"), [(4000, 128), (8, 1)])
def test_keys_of_several_classes(spark, monkeypatch, crowded, drawn):
    monkeypatch.setattr(jaccard, "CROWDED", crowded)
    monkeypatch.setattr(jaccard, "DRAWN", drawn)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    full = keyed_rows(spark)
    held = jaccard.crowded_keys(full, full.select("cls", "task"))
    assert [tuple(r) for r in held.collect()] == ([(1, -3)] if drawn == 1 else [])
    met = jaccard.met_keys(jaccard.keys_of(full), held, held.count())
    want = [(1, c, 4, 2, -3) for c in range(-3, 9)] + [(2, 6, 5, 1, 6), (2, 7, 5, 1, 6)]
    assert sorted((r.key, r.cls, r.ring, r.need, r.low) for r in met.collect()) == want


def test_one_shuffle_of_keys(spark):
    full = keyed_rows(spark)
    plan = jaccard.met_keys(jaccard.keys_of(full), full.limit(0), 0)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "Join" not in plan


def test_segments_stay_while_pairs_are_few(spark):
    pairs = common.stored(spark.createDataFrame([(1, 2, 0)], "hub long, cls long, salt long"), "pairs")
    segments = spark.createDataFrame([(c, 3, 0, [c, 7, 8]) for c in (1, 2)], "cls long, size long, frag int, seg array<long>")
    out = jaccard.beside_hub(pairs, segments, [0])
    assert [(r.hub, r.cls, r.seg, r.hub_seg) for r in out.collect()] == [(1, 2, [2, 7, 8], [1, 7, 8])]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") == 1
