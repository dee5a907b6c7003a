"""Event streams and service-level windows.

Each job is a function of a DataFrame that works on a stream as on a table; the registered
queries run them over the events table, the tests over a file stream with ``availableNow``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.registry import query

ENVELOPE = "message_id long, topic string, key string, attempt int, event_type string, ts timestamp, payload string"
RETENTION = "7 days"


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """JSON files of event envelopes as a stream; a connector with the same columns takes its place in deployment."""
    return spark.readStream.schema(ENVELOPE).json(folder)


def deduplicated(stream: DataFrame) -> DataFrame:
    """First delivery of each message; ids are remembered for RETENTION, which bounds the state."""
    return stream.withWatermark("ts", RETENTION).dropDuplicatesWithinWatermark(["message_id"])


def routed(batch: DataFrame, max_attempts: int = 3) -> DataFrame:
    """Adds ``route``: ok, retry or dead. A payload that is no JSON object is dead at once."""
    parsed = F.try_parse_json("payload") if hasattr(F, "try_parse_json") else F.from_json("payload", "map<string,string>")
    bad = F.col("payload").isNull() | parsed.isNull()
    failed = F.col("event_type") == "error"
    return batch.withColumn("route", F.when(bad, "dead").when(failed & (F.col("attempt") < max_attempts), "retry").when(failed, "dead").otherwise("ok"))


def bucketed(df: DataFrame, seconds: int, *keys: str) -> DataFrame:
    """Adds the start of the tumbling bucket of ``ts`` and keeps the first row (by event_id) of each bucket and key."""
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / seconds) * seconds)
    first = F.row_number().over(W.partitionBy("bucket", *keys).orderBy("event_id"))
    return df.withColumn("bucket", bucket).withColumn("rn", first).where("rn = 1").drop("rn")


@query("stream_dedupe", "select event_id from (select event_id, row_number() over (partition by event_id // 3 order by event_id) as rn from events) where rn = 1")
def stream_dedupe(spark, sf_dir):
    """Three deliveries of a message count once."""
    df = event_table(spark, sf_dir).withColumn("message_id", F.floor(F.col("event_id") / 3))
    return df.groupBy("message_id").agg(F.min("event_id").alias("event_id")).select("event_id")


@query(
    "stream_dedupe_30s",
    "select min(event_id) as event_id from events group by user_id, event_type, floor(epoch(ts) / 30)",
)
def stream_dedupe_30s(spark, sf_dir):
    return bucketed(event_table(spark, sf_dir), 30, "user_id", "event_type").select("event_id")


@query("stream_retry_dlq", "select route, count(*) as n from (select case when event_type = 'error' and event_id % 5 < 3 then 'retry' when event_type = 'error' then 'dead' else 'ok' end as route from events) group by route")
def stream_retry_dlq(spark, sf_dir):
    df = event_table(spark, sf_dir).select("event_type", (F.col("event_id") % 5).cast("int").alias("attempt"), F.col("props").alias("payload"))
    return routed(df).groupBy("route").agg(F.count("*").alias("n"))


@query(
    "stream_rate_limit",
    "select event_id, n > 3 as limited from (select event_id, count(*) over (partition by user_id order by ts range between interval 60 minutes preceding and current row) as n from events)",
)
def stream_rate_limit(spark, sf_dir):
    """More than three events of a user within the last hour."""
    hour = W.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-3600 * 1_000_000, 0)
    return event_table(spark, sf_dir).select("event_id", (F.count("*").over(hour) > 3).alias("limited"))


@query(
    "stream_circuit_breaker",
    """with f as (select event_id, user_id, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type = 'error' order by ts, event_id) as grp from events)
select user_id, count(*)::bigint as streak, min(event_id) as first_id from f where bad group by user_id, grp having count(*) >= 3""",
)
def stream_circuit_breaker(spark, sf_dir):
    """Runs of at least three failures of a user: gaps and islands."""
    bad = F.col("event_type") == "error"
    order = [F.col("ts"), F.col("event_id")]
    df = event_table(spark, sf_dir).withColumn("bad", bad)
    island = F.row_number().over(W.partitionBy("user_id").orderBy(*order)) - F.row_number().over(W.partitionBy("user_id", "bad").orderBy(*order))
    return df.withColumn("island", island).where("bad").groupBy("user_id", "island").agg(F.count("*").alias("streak"), F.min("event_id").alias("first_id")).where("streak >= 3").drop("island")


@query("stream_single_flight", "select count(*) as calls, sum(n)::bigint as requests from (select user_id, event_type, floor(epoch(ts) / 1800) as w, count(*) as n from events group by 1, 2, 3)")
def stream_single_flight(spark, sf_dir):
    """Like requests within a window share one call."""
    calls = event_table(spark, sf_dir).groupBy("user_id", "event_type", F.window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return calls.agg(F.count("*").alias("calls"), F.sum("n").alias("requests"))


def windowed(df: DataFrame, length: str, slide: str | None = None, *keys: str) -> DataFrame:
    """Count and sum of values by sliding window (start) and keys."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return df.groupBy(w, *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.unix_seconds("window.start").alias("start"), *keys, "n", "total")


@query("ext_tumbling", "select (floor(epoch(ts) / 3600) * 3600)::bigint as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def ext_tumbling(spark, sf_dir):
    return windowed(event_table(spark, sf_dir), "1 hour", None, "event_type")


@query(
    "ext_sliding",
    "select ((floor(epoch(ts) / 900) - k) * 900)::bigint as start, count(*) as n, round(sum(value), 4) as total from events, (select unnest(range(0, 4)) as k) group by 1",
)
def ext_sliding(spark, sf_dir):
    return windowed(event_table(spark, sf_dir), "1 hour", "15 minutes")


@query(
    "ext_session",
    """with g as (select *, case when epoch(ts) - epoch(lag(ts) over (partition by user_id order by ts)) < 1800 then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as session from g)
select user_id, floor(epoch(min(ts)))::bigint as start, count(*) as n from s group by user_id, session""",
)
def ext_session(spark, sf_dir):
    s = event_table(spark, sf_dir).groupBy("user_id", F.session_window("ts", "30 minutes")).agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_seconds("session_window.start").alias("start"), "n")


@query("ts_rate", "select (floor(epoch(ts) / 300) * 300)::bigint as start, event_type, round(count(*) / 300, 8) as rate from events group by 1, 2")
def ts_rate(spark, sf_dir):
    w = windowed(event_table(spark, sf_dir), "5 minutes", None, "event_type")
    return w.select("start", "event_type", F.round(F.col("n") / 300, 8).alias("rate"))


@query("ts_ratio", "select (floor(epoch(ts) / 3600) * 3600)::bigint as start, round(count(*) filter (where event_type = 'error') / greatest(1, count(*)), 8) as ratio from events group by 1")
def ts_ratio(spark, sf_dir):
    w = event_table(spark, sf_dir).groupBy(F.window("ts", "1 hour")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    return w.select(F.unix_seconds("window.start").alias("start"), F.round(F.col("bad") / F.greatest(F.lit(1), F.col("n")), 8).alias("ratio"))


@query(
    "ts_burn",
    """with h as (select floor(epoch(ts) / 3600)::bigint as h, count(*) filter (where event_type = 'error') as bad, count(*) as n from events group by 1),
w as (select h, bad / n as short, sum(bad) over six / sum(n) over six as long from h window six as (order by h range between 5 preceding and current row))
select (h * 3600)::bigint as start, round(short / 0.1e0, 6) as burn_1h, round(long / 0.1e0, 6) as burn_6h, short > 0.2e0 and long > 0.2e0 as alert from w""",
)
def ts_burn(spark, sf_dir):
    """Burn of a 10 % error budget over one and six hours; both above twice the budget raise an alert."""
    hours = event_table(spark, sf_dir).groupBy(F.floor(F.unix_seconds("ts") / 3600).alias("h")).agg(F.count_if(F.col("event_type") == "error").alias("bad"), F.count("*").alias("n"))
    # every hour adds to its own window and to the five after it: sums need no global order
    spread = hours.select("bad", "n", "h", F.explode(F.sequence(F.col("h"), F.col("h") + 5)).alias("at"))
    own = F.col("h") == F.col("at")
    w = spread.groupBy("at").agg(F.sum(F.when(own, F.col("bad"))).alias("b1"), F.sum(F.when(own, F.col("n"))).alias("n1"), F.sum("bad").alias("b6"), F.sum("n").alias("n6")).where("n1 is not null")
    short, long = F.col("b1") / F.col("n1"), F.col("b6") / F.col("n6")
    return w.select((F.col("at") * 3600).alias("start"), F.round(short / 0.1, 6).alias("burn_1h"), F.round(long / 0.1, 6).alias("burn_6h"), ((short > 0.2) & (long > 0.2)).alias("alert"))


def bucket_quantile(counts: list[tuple[float, Column]], q: float) -> Column:
    """Quantile from cumulative counts by upper bound, linear inside the bucket that reaches it."""
    total = counts[-1][1]
    rank = total * q
    out = F.lit(None).cast("double")
    for k in range(len(counts) - 1, -1, -1):
        bound, cum = counts[k]
        low, below = (counts[k - 1][0], counts[k - 1][1]) if k else (0.0, F.lit(0))
        out = F.when(cum >= rank, low + (bound - low) * (rank - below) / F.greatest(F.lit(1), cum - below)).otherwise(out)
    return out


@query(
    "ts_hist_quantile",
    """with c as (select event_type, count(*) filter (where value <= 50) as a, count(*) filter (where value <= 100) as b, count(*) filter (where value <= 200) as c, count(*) as d from events where value <= 400 group by 1)
select event_type, round(case when a >= d * 0.95e0 then 50 * d * 0.95e0 / greatest(1, a) when b >= d * 0.95e0 then 50 + 50 * (d * 0.95e0 - a) / greatest(1, b - a) when c >= d * 0.95e0 then 100 + 100 * (d * 0.95e0 - b) / greatest(1, c - b) else 200 + 200 * (d * 0.95e0 - c) / greatest(1, d - c) end, 6) as p95 from c""",
)
def ts_hist_quantile(spark, sf_dir):
    df = event_table(spark, sf_dir).where("value <= 400")
    bounds = (50, 100, 200, 400)
    c = df.groupBy("event_type").agg(*[F.count_if(F.col("value") <= b).alias(f"le{b}") for b in bounds])
    return c.select("event_type", F.round(bucket_quantile([(float(b), F.col(f"le{b}")) for b in bounds], 0.95), 6).alias("p95"))
