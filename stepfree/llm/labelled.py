"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.llm.common import stored

#: UTF-8 bytes of text that one sample brings to the driver at most (one text at least comes, of any length).
SAMPLE_BYTES = 32 << 20


def hashed_first(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """The ``n`` values of ``keys`` (doc_id) of smallest hash, a row for each, with the hash as ``place``: the same ones at every run.

    A hash range that holds a little over ``n`` rows is cut out first, so the top list is made from few rows.
    """
    keys = keys or ("doc_id",)
    place = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1_000_000_000))
    total = df.count()
    aim = n + 6 * n**0.5 + 10
    near = df.withColumn("place", place).where(F.col("place") <= (1_000_000_000 if total <= aim else int(aim * 1_000_000_000 / total)))
    return near.dropDuplicates(list(keys)).orderBy("place", *keys).limit(n)


def sample_texts(docs: DataFrame, ids: DataFrame, max_bytes: int = SAMPLE_BYTES) -> list[tuple]:
    """(doc_id, label, text) of the documents in ``ids`` (doc_id, label, place; a bounded table), in order.

    Null and empty texts are left out; of rows that repeat an id the text of smallest hash counts. Texts are taken
    whole and whatever their length, by ``place``, until ``max_bytes`` are reached.
    """
    texts = docs.select("doc_id", "text").where(F.octet_length("text") > 0).join(F.broadcast(ids), "doc_id")
    one = texts.groupBy("doc_id", "label", "place").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    held = stored(one.select("doc_id", "label", "place", F.col("t.text").alias("text")), "sample")
    sizes = sorted(tuple(r) for r in held.select("place", "doc_id", F.octet_length("text")).collect())
    taken, last = 0, None
    for place, doc_id, size in sizes:
        taken += size
        if last is not None and taken > max_bytes:
            break
        last = (place, doc_id)
    if last is None:
        return []
    inside = (F.col("place") < last[0]) | ((F.col("place") == last[0]) & (F.col("doc_id") <= F.lit(last[1])))
    rows = held.where(inside).select("doc_id", "label", "text").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0], r[1], r[2]))


def labelled_ids(labels: DataFrame, column: str, value: int, train: Column, n: int, seed: int = 7) -> DataFrame:
    """doc_id, label, place of at most ``n`` training rows with ``column`` = ``value``; a doc_id labelled both ways is left out."""
    clear = labels.where(train & F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy("doc_id").agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return hashed_first(clear.where((F.col("lo") == value) & (F.col("hi") == value)), n, seed).select("doc_id", F.lit(value).alias("label"), "place")
