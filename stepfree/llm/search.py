"""Exact top-k search by inner product, term at a time.

Vectors are sparse rows of (dimension, weight). Queries and candidates are dealt into
blocks; each pair of blocks is one task's work. In it the candidates are postings by
dimension, and each dimension's postings, weighted by the queries' components, are
scattered into a dense score array (queries x candidates). The k best of a row come from
a partition selection, and the lists of all candidate blocks are merged per query.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no
part; vectors of different length meet on the dimensions both have; zero components cost
nothing; ties go to the smaller id; rows that repeat an id are queries and candidates of
their own, a query meets every row but its own; rows with a null id are no queries, and
as candidates come last among ties. Scores are exact: a bound is worked out for every pair of
blocks, and Python integers count where it exceeds 2**53. Scores beyond 64 bits count as the
largest or smallest long, before ranking.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stepfree.llm.common import finite, matrix_of, stored

#: Rows of a block, of equal size so that copies of queries and of candidates balance.
QUERY_BLOCK = CANDIDATE_BLOCK = 8192
#: Candidates of one dense score array, and queries of one.
TILE, ROWS = 4096, 256
#: What a long holds.
LEAST, MOST = -(2**63), 2**63 - 1


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Dense score array by accumulating one dimension after the other."""
    d = min(queries.shape[1], candidates.shape[1])
    total = np.zeros((len(queries), len(candidates)), queries.dtype)
    step = np.empty_like(total)
    for t in range(d):
        rows, posted = np.flatnonzero(queries[:, t]), np.flatnonzero(candidates[:, t])
        if 2 * len(rows) >= len(queries) and 2 * len(posted) >= len(candidates):
            np.multiply(queries[:, t, None], candidates[None, :, t], out=step)
            total += step
        elif len(rows) and len(posted):
            total[np.ix_(rows, posted)] += queries[rows, t, None] * candidates[None, posted, t]
    return total


def best_of_block(
    q_rows: np.ndarray, queries: np.ndarray, c_rows: np.ndarray, candidates: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query (place), candidate (place) and score of the k best of each query, ties to the earlier candidate; equal row numbers don't meet."""
    c_ids = np.arange(len(c_rows))
    bound = np.abs(queries).sum(1).max(initial=0) * np.abs(candidates).max(initial=0)
    exact = bound < 2**53
    # float32 holds integers up to 2**24 and moves half the bytes
    kind = np.float32 if bound < 2**24 else np.float64 if exact else object
    if kind is object:
        queries, candidates = (np.array([[int(x) for x in row] for row in m], object).reshape(m.shape) for m in (queries, candidates))
    queries, candidates = queries.astype(kind), candidates.astype(kind)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), ROWS):
        q, own_rows = queries[a : a + ROWS], q_rows[a : a + ROWS].tolist()
        found_s: list[list] = [[] for _ in own_rows]
        found_c: list[list] = [[] for _ in own_rows]
        for b in range(0, len(candidates), TILE):
            s, rows, cand = scores(q, candidates[b : b + TILE]), c_rows[b : b + TILE], c_ids[b : b + TILE]
            if kind is object:
                s = np.clip(s, LEAST, MOST)
            for i, own in enumerate(own_rows):
                row = s[i]
                keep = min(k + 1, len(row))  # one of them may be the query itself
                cut = np.partition(row, len(row) - keep)[len(row) - keep]
                hit = np.flatnonzero(row >= cut)
                hit = hit[rows[hit] != own]
                hit = hit[np.argsort(-row[hit], kind="stable")][:k]  # candidates ascend, so ties keep the smaller id
                found_s[i].append(row[hit])
                found_c[i].append(cand[hit])
        for i in range(len(own_rows)):
            s, c = np.concatenate(found_s[i]), np.concatenate(found_c[i])
            top = sorted(range(len(s)), key=lambda j: (-s[j], c[j]))[:k]
            out.append((np.full(len(top), a + i), c[top], s[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) where ``is_query`` holds.

    Components become floor(scale * x), with x as double. Each query meets every other row.
    """
    x = F.transform("embedding", lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("double"))
    rows = stored(vectors.where(finite("embedding")).select("vec_id", x.alias("v"), F.coalesce(is_query & F.col("vec_id").isNotNull(), F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("row")), "vectors")
    n_queries, n = rows.agg(F.count_if("q"), F.count("*")).first()
    q_blocks, c_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n // CANDIDATE_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    queries = rows.where("q").select(block(q_blocks).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"), "row", "vec_id", "v")
    candidates = rows.select(F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"), block(c_blocks).alias("cb"), "row", "vec_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            q = c = s = np.zeros(0, np.int64)
        else:
            right = right.sort_by("vec_id")  # nulls last
            q, c, s = best_of_block(left["row"].to_numpy(), matrix_of(left["v"]), right["row"].to_numpy(), matrix_of(right["v"]), k)
        query, found = pa.array(q, pa.int64()), pa.array(c, pa.int64())
        ids = {"query_id": left["vec_id"].take(query).cast(pa.int64()), "vec_id": right["vec_id"].take(found).cast(pa.int64())}
        return pa.table({"row": left["row"].take(query), **ids, "score": pa.array([int(y) for y in s], pa.int64())})

    parts = queries.groupBy("qb", "cb").cogroup(candidates.groupBy("qb", "cb")).applyInArrow(meet, "row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return parts.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP6_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64e0 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST))::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) <= 20
"""
