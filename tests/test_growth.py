"""Work that must not grow with copies: hops of requests for the same nodes, calls to the state of jobs."""

from __future__ import annotations


import pandas as pd
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from stepfree.operators import graph
from stepfree.streaming import jobstate

DATA = "/root/testdata/sf0.001"


def test_hops_are_summed_once_for_each_pair(spark):
    """No window over the hops of all requests: a pair's path becomes hops in its own row, and requests get the pair's sums."""
    paths = spark.createDataFrame([(1, 3, 2.0, 2, [1, 2, 3]), (3, 1, float("inf"), -1, []), (2, 2, 0.0, 0, [2])], "start_node long, end_node long, cost double, hops int, path array<long>")
    edges = spark.createDataFrame([(1, 2, 10.0, 0.5), (1, 2, 30.0, 0.1), (2, 3, 20.0, 0.2)], "src long, dst long, dist double, lighting double")
    asked = spark.createDataFrame([(7, 1, 3), (8, 1, 3), (9, 3, 1), (10, 2, 2)], "id long, start_node long, end_node long")
    got = graph.route_summaries(asked, paths, edges).collect()
    assert sorted(tuple(r) for r in got) == [(7, 30.0, 0.3, 2), (8, 30.0, 0.3, 2)]
    assert [tuple(r) for r in graph.path_hops(paths).orderBy("src").collect()] == [(1, 3, 1, 2), (1, 3, 2, 3)]
    assert "Window" not in graph.agg_route_summary(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert [r.broken_hops for r in graph.graph_path_check(spark, DATA).collect()] == [0]


class Handle:
    """A stand-in for the process that keeps state, which counts calls."""

    def __init__(self):
        self.calls, self.value, self.timers = 0, None, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.discard(at)


def test_calls_to_state_do_not_grow_with_jobs():
    """A bucket of 500 jobs: a handful of calls a batch, one timer, and every expiry is told."""
    handle, jobs = Handle(), jobstate.Jobs()
    jobs.init(handle)
    zero = pd.Timestamp("2024-01-01")
    rows = [(f"j{i}", zero + pd.Timedelta(seconds=k, milliseconds=i), 2 * i + k, kind) for i in range(500) for k, kind in enumerate(("submit", "complete"))]
    batch = pd.DataFrame(rows, columns=["job_id", "ts", "seq", "kind"])
    out = pd.concat(jobs.handleInputRows((0,), iter([batch[:700], batch[700:]]), TimerValues(0, 0)))
    assert len(out) == 1000 and handle.calls <= 5 and len(handle.timers) == 1
    ended = zero.value // 1_000_000 + 1000 + jobstate.JOB_TTL
    assert handle.timers == {ended}
    handle.timers.clear()  # it fires, at a watermark that 200 jobs are not yet behind
    handle.calls = 0
    gone = pd.concat(jobs.handleExpiredTimer((0,), TimerValues(0, ended + 299), ExpiredTimerInfo(ended)))
    assert sorted(gone["job_id"]) == sorted(f"j{i}" for i in range(300)) and set(gone["action"]) == {"forgotten"}
    assert handle.calls <= 5 and handle.timers == {ended + 300} and len(handle.value[0]) == 200
