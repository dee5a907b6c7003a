"""Running aggregates against loops, with one key that holds most rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from stepfree.running import running


def test_running_sums_and_maxima(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), rng.randrange(20), k, rng.choice([None, 1, 2, 5])) for k in range(900)]
    df = spark.createDataFrame(rows, "key string, at int, id long, v long").repartition(7)
    out = running(df, ["key"], [F.desc("at"), F.asc("id")], s=("sum", "v"), m=("max", "v")).collect()
    assert len(out) == len(rows)
    by_id = {r.id: r for r in out}
    for key in ("hot", "a", None):
        seen = []
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for r in mine:
            seen += [] if r[3] is None else [r[3]]
            if seen:
                assert (by_id[r[2]].s, by_id[r[2]].m) == (sum(seen), max(seen))
        assert {by_id[r[2]].total_s for r in mine} == {sum(seen)}


def test_running_on_nothing_and_on_one_row(spark):
    df = spark.createDataFrame([("a", 1, 2)], "key string, at int, v long")
    assert running(df.where("false"), ["key"], [F.asc("at")], s=("sum", "v")).count() == 0
    assert [tuple(r) for r in running(df, ["key"], [F.asc("at")], s=("sum", "v")).collect()] == [("a", 1, 2, 2, 2)]
