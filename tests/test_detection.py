"""Greedy matches in rounds against one detection after the other; precision under its envelope."""

from __future__ import annotations

import math
import random

import pytest

from stepfree import registry
from stepfree.operators import evaluation

DATA = "/root/testdata/sf0.001"


def one_by_one(found, truth, radius):
    free = {}
    for image, t, tx in truth:
        free.setdefault(image, {})[t] = tx
    out = set()
    for image, i, _, x in sorted(found, key=lambda r: (-r[2], r[1])):
        near = min(((abs(tx - x), t) for t, tx in free.get(image, {}).items() if abs(tx - x) <= radius), default=None)
        if near:
            del free[image][near[1]]
            out.add((i, near[1]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rounds(spark, seed):
    rng = random.Random(seed)
    found = [(rng.randrange(4), i, rng.choice([0.1, 0.5, 0.5, 0.9, rng.random()]), float(rng.randrange(0, 60))) for i in range(150)]
    truth = [(rng.randrange(5), 1000 + t, float(rng.randrange(-3, 60))) for t in range(90)]
    got = evaluation.greedy_matches(spark.createDataFrame(found, "image int, id long, score double, x double"), spark.createDataFrame(truth, "image int, truth_id long, tx double"), 5.0)
    assert {tuple(r) for r in got.collect()} == one_by_one(found, truth, 5.0)


def test_no_pairs(spark):
    none = evaluation.greedy_matches(spark.createDataFrame([(1, 1, 0.5, 0.0)], "image int, id long, score double, x double"), spark.createDataFrame([(1, 2, 6.0), (2, 3, 0.0)], "image int, truth_id long, tx double"), 5.0)
    assert none.count() == 0


def test_average_precision(spark):
    rows = evaluation.predictions(spark, DATA).collect()
    place = lambda r: float(r["id"] * 13 % 100)
    image = lambda r: (r["city"], r["id"] // evaluation.PER_IMAGE)
    matched = {i for i, _ in one_by_one([(image(r), r["id"], round(r["score_a"], 6), place(r)) for r in rows], [(image(r), r["id"], place(r)) for r in rows if r["target"] == 1], 5.0)}
    want = {}
    for city in {r["city"] for r in rows}:
        own = sorted((r for r in rows if r["city"] == city), key=lambda r: (-r["score_a"], r["id"]))
        hits, best, area = [r["id"] in matched for r in own], 0.0, 0.0
        for k in range(len(own) - 1, -1, -1):
            best = max(best, sum(hits[: k + 1]) / (k + 1))
            area += best if hits[k] else 0.0
        want[city] = area / max(1, sum(r["target"] for r in own))
    got = {r["city"]: r["ap"] for r in registry.all_queries()["agg_detection_ap"](spark, DATA).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[c], want[c], abs_tol=1e-6) for c in want)
