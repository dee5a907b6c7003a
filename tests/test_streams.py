"""Streams against replays of the same messages, across restarts and repeated batches."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from stepfree import registry
from stepfree.shared import new_folder
from stepfree.streaming import ingest, jobstate

DATA = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def plain(key, messages):
    """The rules, message by message, in another form: (before, action) looked up."""
    rows, status, since, sent, until = [], None, 0, 0, None
    for at, seq, kind in sorted(messages):
        if until is not None and at >= until:
            rows.append((key, until, None, "expiry", status, None, "forgotten"))
            status, until = None, None
        before = status
        if kind == "submit" and status in ("pending", "processing"):
            action = "joined" if at - sent < 5000 else "dispatched again"
            sent = sent if action == "joined" else at
        elif kind == "submit" and (status == "completed" or (status == "failed" and at - since < 30000)):
            action = "answered"
        elif kind == "submit":
            action, status, since, sent, until = "dispatched", "pending", at, at, None
        elif kind == "start" and status in (None, "pending"):
            sent = sent if status else at
            action, status, since = "started", "processing", at
        elif kind in ("complete", "fail") and status in ("pending", "processing"):
            action, status, since, until = "finished", {"complete": "completed", "fail": "failed"}[kind], at, at + 300000
        else:
            action = "ignored"
        rows.append((key, at, seq, kind, before, status, action))
    return rows, until, status


def expected(rows, mark):
    """Output of all messages, and of expiries up to the watermark ``mark``."""
    by_job = {}
    for job, at, seq, kind in rows:
        by_job.setdefault(job, []).append((at, seq, kind))
    out = []
    for job, messages in by_job.items():
        own, until, status = plain(job, messages)
        out += own + ([(job, until, None, "expiry", status, None, "forgotten")] if until is not None and until <= mark else [])
    return Counter(out)


def ms(t):
    return round(t.replace(tzinfo=timezone.utc).timestamp() * 1000)


def collected(df):
    rows = df.withColumn("ms", F.unix_millis("at")).collect()
    return Counter((r["job_id"], r["ms"], r["seq"], r["kind"], r["before"], r["after"], r["action"]) for r in rows)


def test_job_states_across_a_restart(spark):
    rng = random.Random(3)
    rows, at = [], 0
    for seq in range(600):
        at += rng.choice([10, 900, 4000, 9000, 60_000])
        rows.append((f"j{rng.randrange(25)}", at, seq, rng.choice(["submit", "submit", "start", "complete", "fail"])))
    base = new_folder(spark, "test-jobs")
    frame = spark.createDataFrame([(j, START + timedelta(milliseconds=a), s, k) for j, a, s, k in rows], "job_id string, ts timestamp_ntz, seq long, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
    zero = ms(START)
    shifted = [(j, a + zero, s, k) for j, a, s, k in rows]
    for k, (low, high) in enumerate(((0, 150), (150, 400), (400, 600))):
        frame.where(f"seq >= {low} and seq < {high}").coalesce(1).write.json(f"{base}/messages/{k}")
        # every call is a new query that goes on from the checkpoint
        out = jobstate.run_job_states(spark, f"{base}/messages", f"{base}/out", f"{base}/checkpoint", files=1)
    got = collected(out)
    whole = expected(shifted, shifted[-1][1] - 60_000)
    assert got == whole
    assert {r[6] for r in got} == {"dispatched", "dispatched again", "joined", "answered", "started", "finished", "ignored", "forgotten"}


def test_job_state_query(spark):
    rows = [(r["job_id"], r["ms"], r["seq"], r["kind"]) for r in jobstate.job_messages(spark, DATA).withColumn("ms", F.unix_millis("ts")).collect()]
    got = collected(registry.all_queries()["stream_job_state"](spark, DATA))
    assert got == expected(rows, max(r[1] for r in rows) - 60_000)


def test_a_batch_run_twice_leaves_one_copy(spark):
    sink = ingest.Ingest(new_folder(spark, "test-ingest"))
    make = lambda ids: spark.createDataFrame([(i, START + timedelta(hours=i), "view") for i in ids], "event_id long, ts timestamp_ntz, event_type string").withColumn("ts", F.col("ts").cast("timestamp"))
    sink.write(make(range(10)), 0)
    sink.write(make(range(10, 20)), 1)
    sink.write(make(range(10, 20)), 1)
    assert sorted(r["event_id"] for r in sink.read(spark, ingest.EVENT).collect()) == list(range(20))
    # rows without a ledger entry are not seen, and the run that repeats them replaces them
    make(range(90, 99)).withColumn("late", F.lit(False)).write.parquet(f"{sink.folder}/rows/batch_id=2")
    assert sink.read(spark, ingest.EVENT).count() == 20
    sink.write(make([3, 17, 18, 30]), 2)
    got = {r["event_id"]: r["late"] for r in sink.read(spark, ingest.EVENT).where("batch_id = 2").collect()}
    assert got == {3: True, 17: True, 18: False, 30: False}  # behind hour 19 less one
    sink.write(make([3, 17, 18, 30]), 2)
    assert {r["event_id"]: r["late"] for r in sink.read(spark, ingest.EVENT).where("batch_id = 2").collect()} == got


@pytest.mark.parametrize("empty_first", [True, False])
def test_empty_batches(spark, empty_first):
    sink = ingest.Ingest(new_folder(spark, "test-ingest"))
    none = spark.createDataFrame([], ingest.EVENT)
    some = spark.createDataFrame([(1, START, "view"), (2, None, None)], ingest.EVENT)
    for k, batch in enumerate((none, some) if empty_first else (some, none)):
        sink.write(batch, k)
    assert sorted((r["event_id"], r["late"]) for r in sink.read(spark, ingest.EVENT).collect()) == [(1, False), (2, False)]
