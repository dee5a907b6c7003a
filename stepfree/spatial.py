"""Plan builders for distance joins: a theta join becomes an equi-join on grid cells."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepfree.functions import geo


def within_distance(left: DataFrame, right: DataFrame, metres: float, max_lat: float = 60.0) -> DataFrame:
    """Pairs of ``left`` (lat, lon) and ``right`` (r_lat, r_lon) at most ``metres`` apart, with ``distance_m``.

    Cells are as large as the radius at ``max_lat`` (rows beyond it raise no error but need a
    higher value), so a point's partners lie in the nine cells around it. Every left row is
    copied to them and meets right rows by equality: no nested loop, one shuffle on the
    cell, which adaptive execution can split where a cell is crowded. Neither side is
    broadcast: the nine copies are planned at the size of the compressed file, a fraction
    of what the driver would have to hold.
    """
    size_lat = metres / geo.DEGREE_M
    size_lon = metres / (geo.DEGREE_M * max(0.1, cos(radians(max_lat))))
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        left.withColumn("__dy", F.explode(step))
        .withColumn("__dx", F.explode(step))
        .withColumn("__cy", geo.cell(F.col("lat"), size_lat) + F.col("__dy"))
        .withColumn("__cx", geo.cell(F.col("lon"), size_lon) + F.col("__dx"))
    )
    own = right.withColumn("__ry", geo.cell(F.col("r_lat"), size_lat)).withColumn("__rx", geo.cell(F.col("r_lon"), size_lon))
    near = spread.join(own.hint("merge"), (F.col("__cy") == F.col("__ry")) & (F.col("__cx") == F.col("__rx")))
    distance = geo.haversine(F.col("lat"), F.col("lon"), F.col("r_lat"), F.col("r_lon"))
    return near.withColumn("distance_m", distance).where(F.col("distance_m") <= metres).drop("__dy", "__dx", "__cy", "__cx", "__ry", "__rx")


def nearest(left: DataFrame, right: DataFrame, key: str, metres: float, k: int = 1) -> DataFrame:
    """The ``k`` nearest right rows (r_id breaks ties) within ``metres`` of each left row, with ``rank``."""
    from pyspark.sql import Window as W

    rank = F.row_number().over(W.partitionBy(key).orderBy("distance_m", "r_id"))
    return within_distance(left, right, metres).withColumn("rank", rank).where(F.col("rank") <= k)


def first_of_place(right: DataFrame, k: int) -> DataFrame:
    """The ``k`` smallest r_id of every place: all that ``nearest`` with this ``k`` can take, as rows of a place are equally far."""
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy("r_lat", "r_lon").orderBy("r_id"))
    return right.withColumn("__n", place).where(F.col("__n") <= k).drop("__n")
