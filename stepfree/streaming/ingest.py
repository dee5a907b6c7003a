"""Replay-safe ingestion: rows by batch, a ledger that commits them, and late rows told apart.

A source delivers at least once, and a failed batch is run again under its number. Rows of a
batch go to a folder of that number, which a second run replaces; the ledger's entry comes
last and is the commit: readers take the rows of batches in the ledger only, so a batch is
seen whole or not at all, and once.

The ledger also holds each batch's latest event time. The watermark of a batch is the latest
time of all batches before it less the allowed delay, as the engine's own is; rows behind it
are late and marked as such instead of being dropped. It follows from the ledger, so a batch
that is run again finds the same watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.registry import query
from stepfree.shared import new_folder
from stepfree.streaming.jobs import event_table

LEDGER = "batch_id long, n long, latest timestamp"


class Ingest:
    """Rows with an event time ``ts`` below a folder; ``seconds``: how far behind the latest time a row may be."""

    def __init__(self, folder: str, seconds: int = 3600) -> None:
        self.folder, self.seconds = folder, seconds

    def ledger(self, spark: SparkSession) -> DataFrame:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return spark.createDataFrame([], LEDGER)
        return spark.read.schema(LEDGER).parquet(f"{self.folder}/ledger")

    def write(self, batch: DataFrame, batch_id: int) -> None:
        """Write and commit a batch; the same number again replaces what it left."""
        spark = batch.sparkSession
        latest = self.ledger(spark).where(F.col("batch_id") < batch_id).agg(F.max("latest")).first()[0]
        late = F.lit(False) if latest is None else F.coalesce(F.col("ts") < F.lit(latest) - F.expr(f"interval {self.seconds} seconds"), F.lit(False))
        target = f"{self.folder}/rows/batch_id={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").parquet(target)
        done = spark.read.parquet(target)
        entry = done.agg(F.lit(batch_id).cast("long").alias("number"), F.count("*").alias("n"), F.max("ts").alias("latest"))
        entry.withColumnRenamed("number", "batch_id").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch_id}")

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The rows of committed batches with ``batch_id`` and ``late``."""
        rows = spark.read.schema(f"{schema}, late boolean, batch_id long").parquet(f"{self.folder}/rows")
        return rows.join(self.ledger(spark).select("batch_id"), "batch_id", "left_semi")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Work off what a stream has by now."""
        stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


EVENT = "event_id long, ts timestamp, event_type string"


def delivered(spark: SparkSession, sf_dir: str, parts: dict[int, DataFrame]) -> Ingest:
    """Write deliveries as files, one after the other, and ingest them a file at a time."""
    base = new_folder(spark, "ingest")
    for k, part in sorted(parts.items()):
        part.coalesce(1).write.json(f"{base}/in/{k}")
    sink = Ingest(f"{base}/table")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(f"{base}/in/*")
    sink.run(stream, f"{base}/checkpoint")
    return sink


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_table(spark, sf_dir).select("event_id", "ts", "event_type")


@query("stream_ingest", "select event_id, event_type from events")
def stream_ingest(spark, sf_dir):
    """All events in three deliveries, one of whose batches is run twice: every event is there once."""
    events = _events(spark, sf_dir)
    sink = delivered(spark, sf_dir, {k: events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k) for k in range(3)})
    again = spark.read.schema(f"{EVENT}, late boolean").parquet(f"{sink.folder}/rows/batch_id=1").drop("late")
    again.write.parquet(f"{sink.folder}-again")
    sink.write(spark.read.schema(EVENT).parquet(f"{sink.folder}-again"), 1)
    return sink.read(spark, EVENT).select("event_id", "event_type")


#: Deliveries hold ten days each; every seventh event comes three days late.
_ARRIVAL = "floor((epoch(ts) + case when event_id % 7 = 0 then 259200 else 0 end) / 864000)"


@query("ext_watermark_late", f"""with a as (select event_id, ts, {_ARRIVAL} as batch from events), m as (select batch, max(ts) as latest from a group by batch),
w as (select batch, max(latest) over (order by batch rows between unbounded preceding and 1 preceding) - interval 1 hour as mark from m)
select event_id, coalesce(ts < mark, false) as late from a join w using (batch)""")
def ext_watermark_late(spark, sf_dir):
    """All events by the order of their arrival: those behind the watermark of their batch are late."""
    events = _events(spark, sf_dir)
    seconds = F.unix_micros("ts") / 1e6 + F.when(F.col("event_id") % 7 == 0, 259200).otherwise(0)
    events = events.withColumn("batch", F.floor(seconds / 864000))
    numbers = [r["batch"] for r in events.select("batch").distinct().orderBy("batch").collect()]  # one for ten days
    sink = delivered(spark, sf_dir, {n: events.where(F.col("batch") == n).drop("batch") for n in numbers})
    return sink.read(spark, EVENT).select("event_id", "late")
