"""Snapshots of what is active, rebuilt from a stream of updates: the hazards and the risk grid around them.

An update carries a hazard's whole row; the latest ``at`` of an id counts (ties: the later batch, then the larger status). A
refresh lays its batch over the state of the last committed refresh, writes state, active hazards and grid under its own number,
and the ledger's entry, written last, makes them what readers see: they get one whole snapshot, the old or the new. A batch that is
run again starts from the same state and replaces its own folders. Work grows with the state and the batch, not with the history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.functions import risk
from stepfree.operators.filters import hazards
from stepfree.operators.risk import risk_cells
from stepfree.registry import query
from stepfree.shared import new_folder
from stepfree.views import with_views

UPDATE = "id long, at timestamp, status string, hazard_type string, lat double, lon double"
LEDGER = "version long, active long"
LEAST_SECONDS = 5


class Snapshots:
    """Snapshots below a folder; ``seconds`` between refreshes, five at least."""

    def __init__(self, folder: str, seconds: int = 30) -> None:
        self.folder, self.seconds = folder, max(LEAST_SECONDS, seconds)

    def version(self, spark: SparkSession, before: int | None = None) -> int | None:
        """The last committed version (below ``before``)."""
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        entries = spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{self.folder}/ledger")
        return (entries if before is None else entries.where(F.col("version") < before)).agg(F.max("version")).first()[0]

    def refresh(self, batch: DataFrame, batch_id: int) -> None:
        """Lay a batch over the last state and commit what comes of it."""
        spark = batch.sparkSession
        rows = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        last = self.version(spark, batch_id)
        if last is not None:
            rows = rows.unionByName(spark.read.schema(f"{UPDATE}, batch long").parquet(f"{self.folder}/state/{last}"))
        columns = ["at", "status", "hazard_type", "lat", "lon", "batch"]
        latest = rows.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("at", "batch", "status")).alias("r")).select("id", "r.*")
        target = f"{self.folder}/state/{batch_id}"
        latest.write.mode("overwrite").parquet(target)
        active = spark.read.schema(f"{UPDATE}, batch long").parquet(target).where(risk.is_active(F.col("status"))).drop("batch")
        active.write.mode("overwrite").parquet(f"{self.folder}/active/{batch_id}")
        risk_cells(active).write.mode("overwrite").parquet(f"{self.folder}/grid/{batch_id}")
        entry = active.agg(F.lit(batch_id).cast("long").alias("version"), F.count("*").alias("active"))
        entry.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/ledger/{batch_id}")

    def read(self, spark: SparkSession, what: str) -> DataFrame:
        """``active`` or ``grid`` of the last committed snapshot."""
        last = self.version(spark)
        if last is None:
            raise FileNotFoundError(f"no snapshot in {self.folder}")
        return spark.read.parquet(f"{self.folder}/{what}/{last}")

    def run(self, stream: DataFrame, checkpoint: str, until_done: bool = False):
        """Refresh every ``seconds``; ``until_done``: work off what the stream has by now."""
        writer = stream.writeStream.foreachBatch(self.refresh).option("checkpointLocation", checkpoint)
        if until_done:
            writer.trigger(availableNow=True).start().awaitTermination()
            return None
        return writer.trigger(processingTime=f"{self.seconds} seconds").start()


@query("stream_snapshot_refresh", with_views(f"""with latest as (select id, hazard_type, lat, lon, case when id % 6 = 0 then 'resolved' when id % 10 = 1 then 'under_review' else status end as status from hazard)
select id, status, hazard_type, round(lat, 6) as lat, round(lon, 6) as lon from latest where status in ('reported', 'under_review')"""))
def stream_snapshot_refresh(spark, sf_dir):
    """The active hazards after three deliveries: all reports, those that were resolved since, those that were reopened."""
    base = new_folder(spark, "snapshot")
    rows = hazards(spark, sf_dir).select("id", F.col("reported_at").alias("at"), "status", "hazard_type", "lat", "lon")
    later = lambda days, status: rows.withColumn("at", F.col("at") + F.make_dt_interval(F.lit(days))).withColumn("status", F.lit(status))
    for k, part in enumerate((rows, later(2, "resolved").where("id % 6 = 0"), later(1, "under_review").where("id % 10 = 1"))):
        part.coalesce(1).write.json(f"{base}/in/{k}")
        shots = Snapshots(f"{base}/table")
        shots.run(spark.readStream.schema(UPDATE).json(f"{base}/in/*"), f"{base}/checkpoint", until_done=True)
    return shots.read(spark, "active").select("id", "status", "hazard_type", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))
