"""Running sums and maxima along an order, without one task for a whole key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.shared import stored

#: How the aggregate of the parts before joins that of the rows so far.
_JOIN = {"sum": lambda before, own: F.coalesce(before, F.lit(0)) + own, "max": F.greatest}


def running(df: DataFrame, keys: list[str], order: list[Column], **columns: tuple[str, str]) -> DataFrame:
    """``df`` with, for each name in ``columns``, ``sum`` or ``max`` of a column over the rows of a key up to the row's own in ``order``.

    ``total_<name>`` is the aggregate over the whole key. ``order`` must tell the rows of a key apart. Rows are cut by ranges of keys
    and order, so a key with many rows lies in many parts; a part's aggregates, a row for each key in it, give what comes before.
    The cut is written to the shared folder: a part stays what it was if an executor is lost. Null keys are a key; nulls are passed
    over (a sum over nulls only is null). An empty table stays empty.
    """
    ranged = stored(df.repartitionByRange(*[F.col(k).asc() for k in keys], *order).withColumn("__part", F.spark_partition_id()), "running")
    of = {name: getattr(F, how) for name, (how, _) in columns.items()}
    by_part = ranged.groupBy(*keys, "__part").agg(*[of[name](c).alias(f"__{name}") for name, (_, c) in columns.items()])
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = by_part.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__at"),
        *[of[n](f"__{n}").over(earlier).alias(f"__before_{n}") for n in columns], *[of[n](f"__{n}").over(W.partitionBy(*keys)).alias(f"total_{n}") for n in columns],
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys], F.col("__part") == F.col("__at"))
    inside = W.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = ranged.select("*", *[of[n](c).over(inside).alias(f"__own_{n}") for n, (_, c) in columns.items()]).join(before, same)
    so_far = [_JOIN[how](F.col(f"__before_{n}"), F.col(f"__own_{n}")).alias(n) for n, (how, _) in columns.items()]
    return rows.select(*df.columns, *so_far, *[f"total_{n}" for n in columns])
