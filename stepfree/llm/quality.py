"""Quality rules on repetition, from suffix arrays.

The words of a text are numbered and sorted as suffixes by prefix doubling, many texts
of a batch at once. Neighbours in the suffix array share their longest common prefix
(LCP); the LCP intervals of at least ``min_repeat`` words are the maximal repeated
substrings. Their spans are united: a text is rejected when they cover too large a share
of its words, or when one repeat is too long.

Defined cases: null and empty texts have no words and fail the base rule; a text of any
length is taken whole (a batch is cut between texts, never inside one); equal rows get
equal results; further input columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from stepfree.llm.common import documents, words

#: Words that one suffix array holds at most, unless a single text is longer.
CHUNK_WORDS = 200_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE_WINDOW = 5


def suffix_lcp(ids: np.ndarray, doc: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each position the longest prefix its suffix shares with another suffix of the same text.

    ids: word numbers; doc: text of each position; end: end of that text. Prefix doubling
    keeps refining only positions whose rank is shared; the ranks of each round are kept
    to read the LCP of neighbours off them, from the longest power down.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, np.int64)
    key = doc * (int(ids.max()) + 1) + ids
    order = np.argsort(key, kind="stable")
    rank = _ranks(key[order], order, np.zeros(n, np.int64), np.arange(n))
    levels, width = [rank], 1
    while True:
        count = np.bincount(rank, minlength=n)
        active = np.flatnonzero(count[rank] > 1)
        if not len(active):
            break
        after = active + width
        inside = after < end[active]
        nxt = np.where(inside, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[active] * (n + 1) + nxt
        o = np.argsort(both, kind="stable")
        rank = rank.copy()
        rank[active[o]] = _ranks(both[o], np.arange(len(o)), np.zeros(len(o), np.int64), rank[active[o]])
        levels.append(rank)
        width *= 2
    place = np.empty(n, np.int64)
    place[rank] = np.arange(n)
    left, right = place[:-1], place[1:]
    pair = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[pair], right[pair]
    common = np.zeros(len(pair), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        step = 1 << k
        a, b = i + common, j + common
        live = (a < end[i]) & (b < end[j])
        same = live & (levels[k][np.minimum(a, n - 1)] == levels[k][np.minimum(b, n - 1)])
        common += np.where(same, step, 0)
    best = np.zeros(n, np.int64)
    np.maximum.at(best, i, common)
    np.maximum.at(best, j, common)
    return best


def _ranks(ordered: np.ndarray, target: np.ndarray, out: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Rank of each element of a sorted array: the start of its run, counted from the start of its old rank."""
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(ordered)]))
    first_of_base = np.flatnonzero(np.r_[True, base[1:] != base[:-1]])
    base_start = np.repeat(first_of_base, np.diff(np.r_[first_of_base, len(base)]))
    value = starts[run] if np.array_equal(base, np.arange(len(base))) else base + starts[run] - base_start
    out[target] = value
    return out


def covered(span: np.ndarray, n: int) -> np.ndarray:
    """Positions inside any [p, p + span[p]) with span[p] > 0."""
    start = np.flatnonzero(span > 0)
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + span[start], minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def repetition(texts: list[list[bytes]], min_repeat: int) -> dict[str, np.ndarray]:
    """Per text: n_words, n_repeat_words (in 5-word windows seen twice), covered words and longest repeat."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    n = int(size.sum())
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    ids = np.fromiter((number[w] for t in texts for w in t), np.int64, n)
    doc = np.repeat(np.arange(len(texts)), size)
    best = suffix_lcp(ids, doc, np.repeat(np.cumsum(size), size))
    window = covered(np.where(best >= BASE_WINDOW, BASE_WINDOW, 0), n)
    spans = covered(np.where(best >= min_repeat, best, 0), n)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, doc, best)
    count = lambda flags: np.bincount(doc[flags], minlength=len(texts))
    return {"n_words": size, "n_repeat_words": count(window), "n_covered_words": count(spans), "longest_repeat": longest}


def character_counts(text: str) -> tuple[int, int, int]:
    """word_chars, n_symbols, n_dup_lines."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines))


COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_covered_words long, longest_repeat long"
)


def measure(texts: list[str | None], min_repeat: int, max_covered: float, longest: int) -> pd.DataFrame:
    """The columns of COUNTS for a list of texts."""
    texts = [t or "" for t in texts]
    chars = np.array([character_counts(t) for t in texts], np.int64).reshape(-1, 3)
    parts, chunk, held = [], [], 0
    for t in texts:
        chunk.append(words(t))
        held += len(chunk[-1])
        if held >= CHUNK_WORDS:
            parts.append(repetition(chunk, min_repeat))
            chunk, held = [], 0
    parts.append(repetition(chunk, min_repeat))
    out = pd.DataFrame({k: np.concatenate([p[k] for p in parts]) for k in parts[0]})
    out["word_chars"], out["n_symbols"], out["n_dup_lines"] = chars[:, 0], chars[:, 1], chars[:, 2]
    out["base_failed"] = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    repeats = (out.n_covered_words > max_covered * out.n_words) | (out.longest_repeat > longest)
    out["kept"] = ~out.base_failed & ~repeats
    return out[[c.split()[0] for c in COUNTS.split(", ")]]


def quality_rules(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.2, longest: int = 100) -> DataFrame:
    """One row per input row: doc_id and the columns of COUNTS.

    min_repeat: words of the shortest repeat that counts; max_covered: share of the words
    that repeats may cover; longest: words that one repeat may have.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = measure(batch.column("text").to_pylist(), min_repeat, max_covered, longest)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(out[c].to_numpy()) for c in out]], ["doc_id", *out])

    return docs.select("doc_id", "text").mapInArrow(measured, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {COUNTS}")


def keep_good(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.2, longest: int = 100) -> DataFrame:
    """The input rows that pass, with all their columns: the rules run beside the rows, so no join is needed."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = measure(batch.column("text").to_pylist(), min_repeat, max_covered, longest)["kept"]
            yield batch.filter(pa.array(kept.to_numpy(bool)))

    return docs.mapInArrow(good, docs.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))
