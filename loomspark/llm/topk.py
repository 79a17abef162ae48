"""Exact top-k search by distributed histogram selection.

Everything is scored, but only counts travel: each round every task bins its scores of each query, the bins are
summed over the cluster, and each query keeps the bin that holds its k-th best score, until the bins left hold few
rows or a single value. Then rows at or above each query's threshold are filtered, cut to k in each task and ranked.
Ties go to the smaller id, so thousands of equal vectors cost k rows a task and no more.

Queries are taken in blocks of bounded size, each against all rows, and each block's results are written. Scores are
longs: vectors so long that an inner product might not fit 62 bits raise an OverflowError. Nulls: a null id, a null vector and a vector
with a null or non-finite component take no part. Vectors of another length than the query's aren't its candidates.
A row with the query's own id isn't either; other repeated rows are candidates of their own. An empty table or one
without queries gives no rows; fewer candidates than k give all. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import vectors
from loomspark.llm.common import scratch_path, tidy
from loomspark.llm.vectors import best, by_length, matrices, query_blocks, ranked, taking_part

BINS = 64
#: Selection stops when no more than this many times k rows are at or above a query's bin.
SLACK = 4
FOUND = "query_id long, rank int, vec_id long, score long"


def quantize(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def _scores(ids, own, queries, cand, exact):
    """Integer scores (rows by queries), and where a row is the query's own."""
    got = queries @ cand.T if exact else (queries.astype(np.int64) @ cand.astype(np.int64).T)
    return got.astype(np.int64), own[:, None] == ids[None, :]


def topk(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, block: int = vectors.BLOCK) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` largest inner products of floor(scale * x) vectors."""
    spark = table.sparkSession
    rows = table.where(taking_part()).select("vec_id", "embedding")

    def norms(batches):
        for b in batches:
            for _, m in matrices(b):
                yield pa.RecordBatch.from_pydict({"m": [float(np.sqrt((quantize(m, scale) ** 2).sum(1)).max())] if m.size else [0.0]})

    longest = rows.mapInArrow(norms, "m double").agg(F.max("m")).first()[0] or 0.0
    with tidy(spark):
        out = scratch_path(spark, "topk", keep=True)
        spark.createDataFrame([], FOUND).write.parquet(out)
        for q in query_blocks(queries.where(taking_part()).select("vec_id", "embedding"), block):
            one_block(spark, rows, q, k, scale, longest, out)
    return spark.read.schema(FOUND).parquet(out)


def one_block(spark: SparkSession, rows: DataFrame, block, k: int, scale: int, longest: float, out: str) -> None:
    groups = {n: (at, ids, quantize(m, scale)) for n, (at, ids, m) in by_length(block).items()}
    reach = np.zeros(len(block))
    for at, _, m in groups.values():
        reach[at] = np.sqrt((m * m).sum(1)) * longest
    if reach.max(initial=0) >= 2.0**62:
        raise OverflowError("inner products of these vectors may not fit a long; take a smaller scale")
    exact = reach.max(initial=0) < 2.0**52
    shared = spark.sparkContext.broadcast(groups)
    size = len(block)
    reach = np.ceil(reach).astype(np.int64) + 1
    low, width = -reach, (2 * reach + BINS) // BINS  # scores are in [low, low + BINS * width)
    above, count = np.zeros(size, np.int64), np.zeros(size, np.int64)
    live = np.ones(size, bool)
    names = [f"h{i}" for i in range(BINS)]
    while live.any():
        edges = spark.sparkContext.broadcast((low, width, live))

        def bins(batches, edges=edges):
            low, width, live = edges.value
            total = np.zeros((size, BINS), np.int64)
            for b in batches:
                for ids, cand in matrices(b):
                    at, own, q = shared.value.get(cand.shape[1], (np.zeros(0, int), None, None))
                    keep = live[at]
                    if not keep.any():
                        continue
                    score, self_row = _scores(ids, own[keep], q[keep], quantize(cand, scale), exact)
                    at = at[keep]
                    bin_ = (score - low[at, None]) // width[at, None]
                    ok = (bin_ >= 0) & (bin_ < BINS) & ~self_row
                    line, _ = np.nonzero(ok)
                    total += np.bincount(at[line] * BINS + bin_[ok], minlength=size * BINS).reshape(size, BINS)
            some = np.flatnonzero(total.any(1))
            if len(some):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *[pa.array(total[some, i], pa.int64()) for i in range(BINS)]], names=["q", *names])

        summed = rows.mapInArrow(bins, "q int, " + ", ".join(f"{n} long" for n in names)).groupBy("q").agg(*[F.sum(n).alias(n) for n in names])
        got = {r[0]: np.array(r[1:], np.int64) for r in summed.collect()}
        for i in np.flatnonzero(live):
            hist = got.get(i, np.zeros(BINS, np.int64))
            down = above[i] + np.cumsum(hist[::-1])
            if down[-1] < k:  # fewer candidates than k: all of them
                live[i] = False
                continue
            j = int(np.argmax(down >= k))
            above[i], count[i] = (down[j - 1] if j else above[i]), down[j]
            low[i] += (BINS - 1 - j) * width[i]
            if width[i] == 1 or count[i] <= SLACK * k:
                live[i] = False
            width[i] = max(1, (width[i] + BINS - 1) // BINS)
        edges.destroy()
    floor = spark.sparkContext.broadcast(low)

    def keep(batches):
        parts = []
        for b in batches:
            for ids, cand in matrices(b):
                at, own, q = shared.value.get(cand.shape[1], (np.zeros(0, int), None, None))
                if len(at):
                    score, self_row = _scores(ids, own, q, quantize(cand, scale), exact)
                    line, col = np.nonzero((score >= floor.value[at, None]) & ~self_row)
                    parts.append((own[line], ids[col], score[line, col]))
            if len(parts) > 1:
                parts = [tuple(map(np.concatenate, zip(*parts, strict=True)))]
            if parts:
                q_id, vec, s = parts[0]
                top = best(s, q_id, vec, k)
                parts = [(q_id[top], vec[top], s[top])]
        for q_id, vec, s in parts:
            yield pa.RecordBatch.from_arrays([pa.array(q_id, pa.int64()), pa.array(vec, pa.int64()), pa.array(s, pa.int64())], names=["query_id", "vec_id", "score"])

    ranked(rows.mapInArrow(keep, "query_id long, vec_id long, score long"), k).write.mode("append").parquet(out)
    shared.destroy()
    floor.destroy()


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return topk(table, table.where(F.col("vec_id") % 50 == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
