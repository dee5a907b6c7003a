"""Line dedup by site-relative frequency.

Rows are grouped by host. For every line of a host, the share of the host's pages that
hold it is counted; lines above ``max_ratio`` are boilerplate and go. A line counts once
a page, so counting is one partial aggregation on (host, line hash). At most
(lines a page) / max_ratio lines of a host can exceed the ratio, which bounds the list
that is kept by host; lists join to the pages by a guarded broadcast or with salt.

Defined cases: lines are split at newlines and compared whole; lines without a word are
left alone and never counted; null texts stay null; null hosts form one host; exact copies of
a page in one host count as one page, so a group of copies makes no line boilerplate; the
ratio decides for hosts of any size, but a line on one page of its host only (on fewer than
``min_count``) does not repeat and stays; a line is dropped when its pages exceed the ratio and stays when they equal it. A page
of which every worded line goes keeps the lines without a word only; ``spare_copies`` leaves
such a page as it is (near-duplicate detection, which follows in the pipeline, thins near
copies out, and would find nothing left of them otherwise).

The pipeline goes further, by ``drop_repeats``: the ratio is also taken over all hosts as
one, and a long line needs few pages to count as repeated, wherever they lie. There a line
must be on five pages of its host: near copies are still among them, and what two near
copies of a small host share is for the stage after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepfree.llm.common import attach, documents, size_words, stored

WORDED = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _worded(line: Column) -> Column:
    return line.rlike(WORDED)


def boilerplate(docs: DataFrame, host: Column, max_ratio: float, min_count: int) -> DataFrame:
    """host, lines: 64-bit hashes of the lines above the ratio; a row for each host that has any."""
    pages = docs.select(host.alias("host"), F.col("text"), F.xxhash64("text").alias("page"))
    totals = pages.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _worded), lambda x: F.xxhash64(x)))
    counts = pages.select("host", "page", F.explode(distinct).alias("line")).distinct().groupBy("host", "line").agg(F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= min_count)  # most lines end here
    totals = stored(totals, "hosts")
    many = attach(counts, totals, ["host"], totals.count(), F.col("line"))
    return many.where(F.col("n") > max_ratio * F.col("pages")).groupBy("host").agg(F.collect_set("line").alias("lines"))


def drop_boilerplate(
    docs: DataFrame, host: str | Column = "source", max_ratio: float = 0.08, min_count: int = 2, spare_copies: bool = False
) -> DataFrame:
    """The input rows and columns, with boilerplate lines taken out of ``text``; adds ``n_dropped_lines``.

    An input column of that name is replaced.
    """
    host = F.col(host) if isinstance(host, str) else host
    frequent = stored(boilerplate(docs, host, max_ratio, min_count), "boilerplate")
    # the row travels as one struct, so its columns may have any names
    rows = docs.select(F.struct(*[c for c in docs.columns if c != "n_dropped_lines"]).alias("__row"), host.alias("host"))
    joined = attach(rows, frequent, ["host"], frequent.count(), F.xxhash64("__row.text"), "left")
    text = F.col("__row.text")
    all_lines = _lines(text)
    stay = F.filter(all_lines, lambda x: ~_worded(x) | ~F.array_contains(F.col("lines"), F.xxhash64(x)))
    left = F.when(F.exists(stay, _worded), stay).otherwise(all_lines) if spare_copies else stay
    untouched = F.col("lines").isNull() | text.isNull()
    clean = F.when(untouched, text).otherwise(F.array_join(left, "\n"))
    gone = F.when(untouched, F.lit(0)).otherwise(F.size(all_lines) - F.size(left))
    names = [c for c in docs.columns if c != "n_dropped_lines"]
    done = joined.select("__row", clean.alias("__clean"), gone.cast("int").alias("__gone"))
    return done.select(*[F.col("__clean").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names], F.col("__gone").alias("n_dropped_lines"))


def pages_needed(words: Column) -> Column:
    """Pages that must hold a line of so many words before it counts as a repeated passage: 50 at ten words, 2 from fifty on."""
    return F.greatest(F.lit(2), F.ceil(5000 / (words * words)))


def repeated_passages(docs: DataFrame, min_words: int, copy_share: float) -> DataFrame:
    """key, lines: for each page (hash of doc_id and text) the passages of which another page holds the first copy.

    The first page is the one with the smallest doc_id (nulls last), the page that near-duplicate
    detection keeps too. A page that has ``copy_share`` of its words in common with one first page is
    a copy of it as a whole and gets no row: near-duplicate detection thins it out.
    """
    key = F.xxhash64("doc_id", "text")
    passages = F.filter(F.transform(_lines(F.col("text")), lambda x: F.struct(F.xxhash64(x).alias("line"), size_words(x).alias("words"))), lambda x: x["words"] >= min_words)
    pages = docs.select(key.alias("key"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key.alias("key")).alias("page"), size_words(F.col("text")).alias("size"), F.array_distinct(passages).alias("passages"))
    held = pages.select("key", "page", "size", F.inline("passages"))
    often = held.groupBy("line", "words").agg(F.count("*").alias("n"), F.min("page").alias("first"))
    often = stored(often.where(F.col("n") >= pages_needed(F.col("words"))).select("line", F.col("first.key").alias("first")), "passages")
    found = attach(held, often, ["line"], often.count(), F.col("key")).where("key != first").select("key", "size", "line", "words", "first").distinct()
    by_first = found.groupBy("key", "size", "first").agg(F.sum("words").alias("words"), F.collect_set("line").alias("lines"))
    by_page = by_first.groupBy("key", "size").agg(F.max("words").alias("words"), F.flatten(F.collect_list("lines")).alias("lines"))
    return by_page.where(F.col("words") < copy_share * F.col("size")).select("key", "lines")


def drop_repeats(docs: DataFrame, host: str | Column = "source", min_words: int = 10, copy_share: float = 0.2) -> DataFrame:
    """As ``drop_boilerplate``, for hosts of any size and for all hosts as one; then of every long passage one copy stays."""
    names = [c for c in docs.columns if c != "n_dropped_lines"]
    clean = drop_boilerplate(docs, host, min_count=5, spare_copies=True).withColumnRenamed("n_dropped_lines", "__own")
    clean = drop_boilerplate(clean, F.lit(""), min_count=5, spare_copies=True).withColumnRenamed("n_dropped_lines", "__all")
    gone = stored(repeated_passages(clean, min_words, copy_share), "repeats")
    rows = clean.select(F.struct(*names).alias("__row"), (F.col("__own") + F.col("__all")).alias("__gone"), F.xxhash64("doc_id", "text").alias("key"))
    joined = attach(rows, gone, ["key"], gone.count(), F.monotonically_increasing_id(), "left")
    text, untouched = F.col("__row.text"), F.col("lines").isNull()
    stay = F.filter(_lines(text), lambda x: ~F.array_contains(F.col("lines"), F.xxhash64(x)))
    done = joined.select("__row", F.when(untouched, text).otherwise(F.array_join(stay, "\n")).alias("__clean"), (F.col("__gone") + F.when(untouched, 0).otherwise(F.size(_lines(text)) - F.size(stay))).cast("int").alias("__gone"))
    return done.select(*[F.col("__clean").alias(c) if c == "text" else F.col("__row")[c].alias(c) for c in names], F.col("__gone").alias("n_dropped_lines"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_dropped_lines, n_chars_left and the text that is left of every document, by source."""
    left = drop_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    n_chars = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    return left.select("doc_id", "n_dropped_lines", n_chars.alias("n_chars_left"), "text")


OP2_SQL = r"""
WITH pages AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
totals AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM pages) GROUP BY source),
worded AS (
  SELECT source, line, count(DISTINCT text) AS n
  FROM (SELECT source, text, unnest(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS line FROM pages)
  GROUP BY source, line),
frequent AS (
  SELECT w.source, list(w.line) AS gone FROM worded w JOIN totals t ON w.source IS NOT DISTINCT FROM t.source
  WHERE n >= 2 AND n > 0.08e0 * t.pages GROUP BY w.source),
res AS (
  SELECT p.doc_id, p.text, p.lines, CASE WHEN f.gone IS NULL THEN p.lines ELSE
    list_filter(lines, lambda x: NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR NOT list_contains(f.gone, x)) END AS kept
  FROM pages p LEFT JOIN frequent f ON p.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, coalesce(len(lines) - len(kept), 0)::INTEGER AS n_dropped_lines,
       length(coalesce(array_to_string(kept, chr(10)), ''))::BIGINT AS n_chars_left,
       array_to_string(kept, chr(10)) AS text
FROM res
"""
