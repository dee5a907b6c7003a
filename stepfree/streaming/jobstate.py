"""Life of route jobs on an event stream: one value state and one timer for a bucket of jobs.

A job is pending when submitted, processing when a worker starts it, and completed or failed
when the worker says so; JOB_TTL after that it is forgotten. Submitting again while it is
pending or processing dispatches it again, at most once in REDISPATCH; while its result is
kept the result answers, but a failure older than DEDUPE does not, and the job starts anew. A
job that a worker starts unasked is taken as submitted. Messages out of turn (a start or an
end after the end, an end of no job) change nothing.

Every message, and every expiry, is a row of the output. Expiry is worked out when the next
message of the job comes or when the watermark passes it, whichever is first, and says the
same either way: the rows do not depend on how messages fall into batches, as long as those
of a job come in order of time.

A call to the process that keeps state costs milliseconds, so jobs are dealt by hash to BUCKETS
buckets: a batch reads and writes each bucket it touches once, whatever number of jobs is in it,
and a bucket has one timer, for the job that expires first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from stepfree.registry import query
from stepfree.shared import new_folder
from stepfree.streaming.jobs import event_table

MESSAGE = "job_id string, ts timestamp, seq long, kind string"
#: Fixed values, in milliseconds: a result is kept, a failure answers, a job is dispatched again.
JOB_TTL, DEDUPE, REDISPATCH = 300_000, 30_000, 5_000
STATE = "jobs array<struct<job_id:string,status:string,since:long,dispatched:long,expires:long>>"
#: Buckets of jobs; fixed for the life of a checkpoint.
BUCKETS = 1024
OUTPUT = "job_id string, at timestamp, seq long, kind string, before string, after string, action string"
Job = tuple[str, int, int, int | None]


def advance(job: Job | None, at: int, kind: str) -> tuple[Job | None, str]:
    """The job after a message, and what was done about it."""
    status = job[0] if job else None
    if kind == "submit":
        if status in ("pending", "processing"):
            if at - job[2] < REDISPATCH:
                return job, "joined"
            return (status, job[1], at, None), "dispatched again"
        if status == "completed" or (status == "failed" and at - job[1] < DEDUPE):
            return job, "answered"
        return ("pending", at, at, None), "dispatched"
    if kind == "start" and status in (None, "pending"):
        return ("processing", at, job[2] if job else at, None), "started"
    if kind in ("complete", "fail") and status in ("pending", "processing"):
        return ("completed" if kind == "complete" else "failed", at, job[2], at + JOB_TTL), "finished"
    return job, "ignored"


def expired(job: Job | None, at: int) -> bool:
    return job is not None and job[3] is not None and at >= job[3]


def replayed(key: str, job: Job | None, messages: list[tuple[int, int, str]]) -> tuple[Job | None, list[tuple]]:
    """The job after messages (ms, seq, kind) in order, and the rows they give."""
    rows = []
    for at, seq, kind in sorted(messages):
        if expired(job, at):
            rows.append((key, job[3], None, "expiry", job[0], None, "forgotten"))
            job = None
        before = job[0] if job else None
        job, action = advance(job, at, kind)
        rows.append((key, at, seq, kind, before, job[0] if job else None, action))
    return job, rows


def table_of(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["job_id", "at", "seq", "kind", "before", "after", "action"])
    return out.assign(at=pd.to_datetime(out["at"], unit="ms"), seq=out["seq"].astype("Int64"))


def first_expiry(jobs: dict[str | None, Job]) -> int | None:
    return min((j[3] for j in jobs.values() if j[3] is not None), default=None)


class Jobs(StatefulProcessor):
    """Keeps the jobs of a bucket in a value state; its one timer is set to the first expiry among them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.jobs = handle.getValueState("jobs", STATE)

    def kept(self) -> dict[str | None, Job]:
        return {j[0]: tuple(j[1:]) for j in self.jobs.get()[0]} if self.jobs.exists() else {}

    def keep(self, jobs: dict[str | None, Job], timer: int | None) -> None:
        """Write the jobs, and move the timer from ``timer`` (none: it has fired, or there was none) to their first expiry."""
        if jobs:
            self.jobs.update(([(k, *j) for k, j in jobs.items()],))
        else:
            self.jobs.clear()
        first = first_expiry(jobs)
        if timer is not None and timer != first:
            self.handle.deleteTimer(timer)
        if first is not None and timer != first:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        messages: dict[str | None, list[tuple[int, int, str]]] = {}
        for part in rows:
            ms = part["ts"].astype("datetime64[ms]").astype("int64")
            for k, *message in zip(part["job_id"].tolist(), ms.tolist(), part["seq"].tolist(), part["kind"].tolist(), strict=True):
                messages.setdefault(k, []).append(tuple(message))
        jobs, out = self.kept(), []
        timer = first_expiry(jobs)
        for k, own in messages.items():
            job, made = replayed(k, jobs.pop(k, None), own)
            if job is not None:
                jobs[k] = job
            out += made
        self.keep(jobs, timer)
        yield table_of(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        jobs, mark = self.kept(), max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        gone = {k: j for k, j in jobs.items() if expired(j, mark)}
        if gone:
            self.keep({k: j for k, j in jobs.items() if k not in gone}, None)
            yield table_of([(k, j[3], None, "expiry", j[0], None, "forgotten") for k, j in gone.items()])

    def close(self) -> None:
        pass


def job_states(messages: DataFrame, delay: str = "1 minute") -> DataFrame:
    """The rows of OUTPUT of a stream of MESSAGE rows."""
    # the process that sets up state beside the driver gets no files that were added to the application: the class travels whole
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(BUCKETS)).cast("int")
    keyed = messages.withWatermark("ts", delay).withColumn("bucket", bucket).groupBy("bucket")
    return keyed.transformWithStateInPandas(Jobs(), OUTPUT, "Append", "EventTime")


#: The state store that value states and timers need.
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_job_states(spark: SparkSession, messages: str, out: str, checkpoint: str, files: int | None = None) -> DataFrame:
    """Work off the message files (JSON) below a folder that are not yet, append the rows to ``out``, and read all of it."""
    before = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        stream = spark.readStream.schema(MESSAGE)
        stream = (stream.option("maxFilesPerTrigger", files) if files else stream).json(f"{messages}/*")
        sink = job_states(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(ROCKS[0])
        else:
            spark.conf.set(ROCKS[0], before)
    return spark.read.schema(OUTPUT).parquet(out)


def job_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: six in a row are one job's."""
    e = event_table(spark, sf_dir)
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "purchase", "complete").when(F.col("event_type") == "error", "fail").otherwise("submit")
    return e.select(F.concat(F.lit("job-"), F.floor(F.col("event_id") / 6)).alias("job_id"), F.date_trunc("millisecond", "ts").alias("ts"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query("stream_job_state")
def stream_job_state(spark, sf_dir):
    """All events, in two deliveries, through the stream; the second goes on from the checkpoint of the first."""
    messages = job_messages(spark, sf_dir)
    middle = messages.agg(F.expr("percentile_approx(ts, 0.5)")).first()[0]
    base = new_folder(spark, "jobs")
    for k, part in enumerate((messages.where(F.col("ts") <= F.lit(middle)), messages.where(F.col("ts") > F.lit(middle)))):
        part.write.json(f"{base}/messages/{k}")
        out = run_job_states(spark, f"{base}/messages", f"{base}/out", f"{base}/checkpoint")
    return out
