"""Helpers that several operators share: words, shared-folder tables, guarded joins, document hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows and bytes (as the planner sees them) of a table that may be broadcast; above either, ``attach`` shuffles with salt.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` splits at exactly the six separators of WORD."""
    return text.encode().split() if text else []


def lower_words(text: str | None) -> list[bytes]:
    """As ``words``, with A-Z (and nothing else) in lower case."""
    return text.encode().lower().split() if text else []


#: Folders made for applications that name none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; where none is configured a local session gets one of its own, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="stepfree-")
    return _LOCAL[app]


#: Folders that ``stored`` has made and nothing has deleted yet, by application.
_MADE: dict[str, list[str]] = {}


def made(spark: SparkSession) -> list[str]:
    """The folders that ``stored`` has made in this application and ``discard_made`` has not deleted."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def discard_made(spark: SparkSession, before: list[str], *keep: DataFrame) -> None:
    """Delete what ``stored`` has made since ``made`` gave ``before``, but for the files of some tables."""
    stay = {f.rstrip("/").rsplit("/stepfree/", 1)[-1].split("/")[0] for table in keep for f in table.inputFiles() if "/stepfree/" in f}
    earlier = set(before)
    for folder in made(spark):
        if folder not in earlier and folder.rsplit("/", 1)[-1] not in stay:
            discard_folder(spark, folder)
            _MADE[spark.sparkContext.applicationId].remove(folder)


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder (a folder for each value of ``by``) and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stepfree/{uuid.uuid4().hex}-{name}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote and nothing reads any more."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            discard_folder(table.sparkSession, folder)


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results."""
    if "/stepfree/" in folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop what is out of use, so that Spark removes the shuffle files of finished steps."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def planned_bytes(df: DataFrame) -> int:
    """The planner's size of a table: that of its files, for one that ``stored`` wrote."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits(table: DataFrame, rows: int) -> bool:
    """Whether a table of so many rows may be broadcast."""
    return rows <= BROADCAST_ROWS and planned_bytes(table) <= BROADCAST_BYTES


def attach(big: DataFrame, small: DataFrame, keys: Sequence[str], rows: int, salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``small`` (``rows`` rows, unique by ``keys``) to ``big``; null keys match null keys.

    Up to BROADCAST_ROWS rows of BROADCAST_BYTES in all it is broadcast. Above, it is copied ``salts`` times and
    both sides shuffle on keys and salt, so that a hot key spreads over that many tasks.
    """
    right = small.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    if fits(small, rows):
        joined = big.join(F.broadcast(right), on, how)
    else:
        right = right.withColumn("__r_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = big.withColumn("__salt", F.pmod(salt, F.lit(salts)).cast("int")).join(right, [*on, F.col("__salt") == F.col("__r_salt")], how)
    return joined.drop("__salt", "__r_salt", *[f"__r_{k}" for k in keys])


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text; a null id counts as empty text (0)."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def id_crc_py(value: object) -> int:
    """``id_crc`` for one Python value."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def size_words(column: Column) -> Column:
    """Number of words of a text column (null: 0)."""
    return F.coalesce(F.regexp_count(column, F.lit(WORD)), F.lit(0)).cast("long")


def finite(column: str) -> Column:
    """Whether a vector is there and holds neither a null nor a non-finite component."""
    bad = F.exists(column, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == F.lit(float("inf"))))
    return F.col(column).isNotNull() & ~bad


def matrix_of(column: pa.ChunkedArray | pa.Array, kind: type = np.float64, least: int = 0) -> np.ndarray:
    """The lists of a column as rows of a matrix of at least ``least`` columns, shorter ones filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    width = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(width), int(width.max(initial=least))), kind)
    row = np.repeat(np.arange(len(width)), width)
    start = np.repeat(np.cumsum(width) - width, width)
    out[row, np.arange(len(row)) - start] = lists.flatten().to_numpy()
    return out


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers by the thousand, not ten thousand at a time (unless the session says otherwise)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
