"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a 60-bit hash. A source's target is met by whole copies of the
source plus the documents whose hash lies below a threshold. The threshold comes from
histograms: words by (source, hash bucket), a running sum over at most 4096 buckets,
then a finer histogram of the boundary bucket alone, until that bucket holds one hash.
Thresholds are nested: a larger budget keeps every document a smaller one took. Nothing
is sorted but bucket totals, and only one-row sums reach the driver.

Defined cases: null or empty text has size 0 and takes 0 words; the null source is a
source of its own, ranked last; rows equal in id and text share one hash and are taken
together; of the two cuts around the boundary hash the nearer one counts (tie: the lower).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.llm.common import attach, documents, size_words, stored

HASH_BITS = 60
LEVEL_BITS = 12


def row_hash() -> Column:
    """60 bits of the md5 of id and text."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), h."""
    return docs.select("doc_id", "source", size_words(F.col("text")).alias("size"), row_hash().alias("h"))


def ranked_sources(sized: DataFrame, weights: Sequence[float]) -> tuple[DataFrame, int]:
    """source, source_size, weight (by rank in code point order, null last), and their number.

    Ranks come from a range partitioning and row counts by partition, so no task holds all sources.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = stored(totals.repartitionByRange(16, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    counts = {r["part"]: r["n"] for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    before, shift = 0, F.lit(0)
    for part in sorted(counts):
        shift = F.when(F.col("part") == part, F.lit(before)).otherwise(shift)
        before += counts[part]
    place = shift + F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    return ranged.select("source", "source_size", weight.alias("weight")), before


def water_level(sources: DataFrame, share: float, epochs: int) -> float:
    """The words a unit of weight gets once all excess over ``epochs`` times a source is reshared."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level, capped = (budget / weight if weight else 0.0), 0
    while True:
        over = F.col("weight") * F.lit(level) > F.col("source_size") * epochs
        n, spent, free = sources.agg(
            F.count_if(over), F.sum(F.when(over, F.col("source_size") * epochs).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("weight")))
        ).first()
        if not n or n == capped or not free:
            return level
        capped, level = n, (budget - spent) / free


def thresholds(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Adds ``threshold``: hashes below it give the source's ``rest`` words, as near as one hash allows."""
    front = sources.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"))
    done = None
    shift = HASH_BITS
    while shift:
        shift -= LEVEL_BITS
        inside = attach(sized, front, ["source"], n_sources, F.col("h")).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("s"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.first("rest").alias("rest"), F.first("below").alias("below")
        )
        upto = F.col("below") + F.sum("s").over(W.partitionBy("source").orderBy("bucket"))
        cut = (
            buckets.withColumn("upto", upto)
            .where("upto > rest")
            .groupBy("source")
            .agg(F.min_by(F.struct("bucket", "s", "upto", "h0", "h1", "rest"), "bucket").alias("b"))
            .select("source", "b.*")
        )
        cut = stored(cut.withColumn("below", F.col("upto") - F.col("s")), f"cut{shift}")
        # one hash is left in the bucket: take it if that comes nearer
        single = F.col("h0") == F.col("h1")
        nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
        found = cut.where(single if shift else F.lit(True)).select("source", F.when(nearer, F.col("h1") + 1).otherwise(F.col("h0")).alias("threshold"))
        done = found if done is None else done.unionByName(found)
        front = cut.where(~single).select("source", "rest", F.col("bucket").alias("prefix"), "below")
        if not shift or front.isEmpty():
            break
    # no bucket goes beyond the rest: rounding only, the whole source is taken
    return attach(sources, done, ["source"], n_sources, F.col("source_size"), "left").withColumn(
        "threshold", F.coalesce("threshold", F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(F.lit(0)).cast("long"))
    )


def mixing_plan(docs: DataFrame, weights: Sequence[float], share: float, epochs: int) -> tuple[DataFrame, DataFrame, int]:
    """Sizes and hashes of the rows; by source its size, target, whole copies and threshold; the number of sources."""
    sized = stored(document_sizes(docs), "sizes")
    sources, n = ranked_sources(sized, weights)
    sources = stored(sources, "weights")
    level = water_level(sources, share, epochs)
    cap = F.col("source_size") * epochs
    target = F.when(F.col("weight") * F.lit(level) > cap, cap.cast("double")).otherwise(F.col("weight") * F.lit(level))
    sources = sources.withColumn("target", target).withColumn(
        "whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    )
    sources = stored(sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    plan = stored(thresholds(sized, sources, n).select("source", "source_size", "target", "whole", "threshold"), "thresholds")
    return sized, plan, n


def copies_of(size: Column, h: Column) -> Column:
    """How often the mix takes a row; a row without words is not taken."""
    return F.when(size > 0, F.col("whole") + F.when(h < F.col("threshold"), 1).otherwise(0)).otherwise(F.lit(0)).cast("int")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, copies, taken.

    ``share`` times all words is split over the sources by ``weights`` (repeating in rank
    order); no source goes beyond ``epochs`` times its own words. ``copies`` is 0..epochs.
    """
    sized, plan, n = mixing_plan(docs, weights, share, epochs)
    mixed = attach(sized, plan, ["source"], n, F.col("h")).withColumn("copies", copies_of(F.col("size"), F.col("h")))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """The mix itself: every input row with all its columns, as often as it is taken."""
    _, plan, n = mixing_plan(docs, weights, share, epochs)
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("source"), size_words(F.col("text")).alias("__size"), row_hash().alias("__h"))
    joined = attach(rows, plan.select("source", "whole", "threshold"), ["source"], n, F.col("__h"))
    copies = copies_of(F.col("__size"), F.col("__h"))
    return joined.select("__row", F.explode(F.array_repeat(F.lit(0), copies)).alias("__copy")).select("__row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by sorting: a running sum in hash order, cut at the nearer side of the rest.
OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT source, source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5e0 WHEN 1 THEN 2e0 ELSE 1e0 END AS weight
  FROM totals),
steps AS (
  SELECT *, 2 * source_size / weight AS ratio,
         1.5e0 * (SELECT sum(source_size) FROM totals)
         - coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM ranked),
level AS (SELECT arg_min(left_over / free, ratio) AS level FROM steps WHERE left_over / free <= ratio),
targets AS (
  SELECT source, source_size, CASE WHEN weight * level > 2 * source_size THEN (2 * source_size)::DOUBLE ELSE weight * level END AS target
  FROM ranked, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
cum AS (
  SELECT s.*, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY h) AS upto,
         sum(size) OVER (PARTITION BY s.source, h) AS tie
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - tie <= rest AND upto - rest < rest - (upto - tie))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum
"""
