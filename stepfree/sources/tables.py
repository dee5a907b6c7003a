"""JSON lines, CSV and lists of files: reading, and writing to the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepfree.registry import query


#: How CSV files write a null, to tell it from an empty text.
NULL = "\\N"


def work_folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session that names none gets one of its own, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/stepfree/tables-{uuid.uuid4().hex}"


def read_many(spark: SparkSession, paths: str) -> DataFrame:
    """Parquet files of a list parted by ``;``: missing ones are skipped, none at all is an error."""
    hadoop = spark._jsc.hadoopConfiguration()
    found = []
    for path in (p.strip() for p in paths.split(";")):
        if path and (at := spark._jvm.org.apache.hadoop.fs.Path(path)).getFileSystem(hadoop).exists(at):
            found.append(path)
    if not found:
        raise FileNotFoundError(f"none of the files is there: {paths}")
    return spark.read.parquet(*found)


def write_jsonl(df: DataFrame, folder: str, split: str | None = None) -> None:
    """JSON lines; a folder for each value of ``split``, if given."""
    writer = df.write.mode("errorifexists").option("ignoreNullFields", "false")
    (writer.partitionBy(split) if split else writer).json(folder)


def read_jsonl(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of JSON lines with ``source_file``, the name of the file they came from."""
    return spark.read.schema(schema).option("basePath", folder).json(folder).withColumn("source_file", F.col("_metadata.file_name"))


def read_jsonl_placed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, with ``source_split`` (the file's folder below ``folder``, or its name without ending) and ``source_index``, the row's place in its file from 0.

    A file may be read in several blocks: rows are numbered where they are read, and of a block only its first number and its rows (one row a block)
    are shuffled. Blank lines are no rows. Row numbers hold as long as the files stay as they are.
    """
    place = {"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start")}
    rows = spark.read.schema(schema).option("basePath", folder).json(folder).withColumns(place).withColumn("__row", F.monotonically_increasing_id())
    blocks = rows.groupBy("__file", "__block").agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("__offset", F.coalesce(before, F.lit(0)) - F.col("__first")).drop("__n", "__first")
    parts = F.split("__file", "/")
    last, above = F.regexp_replace(F.element_at(parts, -1), r"\.jsonl?$", ""), F.element_at(parts, -2)
    split = F.when(F.element_at(parts, -1).startswith("part-"), F.regexp_replace(above, "^[^=]*=", "")).otherwise(last)
    placed = rows.join(blocks, ["__file", "__block"]).withColumn("source_index", F.col("__row") + F.col("__offset")).withColumn("source_split", split)
    return placed.drop("__file", "__block", "__row", "__offset")


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV with a header; quotes inside values are doubled, nulls are written as NULL; values hold no line breaks."""
    df.write.mode("errorifexists").option("header", True).option("escape", '"').option("nullValue", NULL).csv(folder)


def read_csv(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').option("nullValue", NULL).csv(folder)


@query("scan_multi_file", "select n_nationkey as id, n_name as name from nation")
def scan_multi_file(spark, sf_dir):
    return read_many(spark, f"{sf_dir}/nation.parquet; {sf_dir}/nation-of-no-such-name.parquet;").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("double").alias("balance"), F.col("s_nationkey").alias("place"))


_SUPPLIERS = "select s_suppkey::bigint as id, s_name as name, s_acctbal::double as balance, s_nationkey::bigint as place from supplier"
_SCHEMA = "id long, name string, balance double, place long"


def _json(spark, sf_dir) -> DataFrame:
    folder = work_folder(spark)
    write_jsonl(suppliers(spark, sf_dir), folder, "place")
    return read_jsonl(spark, folder, _SCHEMA)


def _csv(spark, sf_dir) -> DataFrame:
    folder = work_folder(spark)
    write_csv(suppliers(spark, sf_dir), folder)
    return read_csv(spark, folder, _SCHEMA)


@query("sink_jsonl", _SUPPLIERS)
def sink_jsonl(spark, sf_dir):
    """Rows written as JSON lines, a folder a place, and read again."""
    return _json(spark, sf_dir).drop("source_file")


@query("scan_jsonl", "select s_suppkey::bigint as id, s_nationkey::bigint as place, s_nationkey::varchar as source_split, row_number() over (partition by s_nationkey order by s_suppkey) - 1 as source_index from supplier")
def scan_jsonl(spark, sf_dir):
    """Rows of JSON lines, a file a place, with the split and the line that they came from."""
    folder = work_folder(spark)
    rows = suppliers(spark, sf_dir)
    write_jsonl(rows.repartition("place").sortWithinPartitions("place", "id"), folder, "place")
    return read_jsonl_placed(spark, folder, _SCHEMA).select("id", "place", "source_split", "source_index")


@query("sink_csv", _SUPPLIERS)
def sink_csv(spark, sf_dir):
    """Rows written as CSV and read again."""
    return _csv(spark, sf_dir)


@query("scan_csv", "select s_nationkey::bigint as place, count(*) as n, min(s_name) as first_name from supplier group by s_nationkey")
def scan_csv(spark, sf_dir):
    """Counts over rows read from CSV."""
    return _csv(spark, sf_dir).groupBy("place").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))
