"""Approximate nearest neighbours by a permutation index.

A bounded sample of vectors serves as pivots. Each vector is represented by its ``PREFIX`` nearest pivots in order of
nearness, and is posted, with the place of the pivot in that order, in the inverted files of these pivots. A query
reads the files of its ``ASKED`` nearest pivots: a vector's footrule distance to the query (places of shared pivots,
absent ones counted as ``PREFIX``) comes from adding up postings, ``ASKED * PREFIX / PIVOTS`` of them a row. A
histogram of the distances over the whole index gives each query the distance that admits its candidates, ``WIDTH``
times the square root of the number of rows; these are reranked by the exact inner product.

Inner products become angles by one more component, sqrt(M^2 - |v|^2) with M the largest norm. The index is cut into
parts of bounded size, each holding its vectors and the inverted files over them; every row is indexed. Queries run in
blocks of bounded size, and each block's results are written. Recall against brute force is measured in the tests and
given in the README.

Nulls: null ids and null, zero or non-finite vectors take no part, as vectors whose length isn't the pivots' (the
length of most sampled rows). A row with the query's own id isn't its candidate; other repeated rows count each.
Ties go to the smaller id. An empty table gives none.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, scratch_path, tidy
from loomspark.llm.vectors import by_length, matrices, query_blocks, ranked, taking_part

#: Pivots: a sample of at most so many rows.
PIVOTS = 2048
#: Nearest pivots that represent a vector, and nearest pivots whose files a query reads.
PREFIX, ASKED = 128, 64
#: Rows reranked for each query: so many times the square root of the rows.
WIDTH = 12
#: Vectors in a part of the index.
PART = 8192
#: Queries in a block.
QUERIES = 4096
BINS = 64


FOUND = "query_id long, rank int, vec_id long, score double"


def sampled_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """At most ``pivots`` different vectors of the most frequent length, those of the smallest id hashes."""
    got = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    if not got:
        return np.zeros((0, 0))
    size = Counter(len(r[1]) for r in got).most_common(1)[0][0]
    return np.unique(np.array([r[1] for r in got if len(r[1]) == size], np.float64).reshape(-1, size), axis=0)


def raised(m: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that turns the inner product into an angle."""
    rest = np.sqrt(np.maximum(0.0, longest**2 - (m * m).sum(1)))
    return np.concatenate([m, rest[:, None]], 1)


def permutations(m: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """For each row, its nearest pivots in order."""
    near = m @ pivots.T
    some = np.argpartition(-near, min(prefix, near.shape[1] - 1), axis=1)[:, :prefix] if prefix < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(m), 1))
    order = np.lexsort((some, -np.take_along_axis(near, some, 1)), axis=1)
    return np.take_along_axis(some, order, 1)


def build(rows: DataFrame, pivots: np.ndarray, longest: float, prefix: int, part: int) -> DataFrame:
    """Rows (part, ids, vecs, starts, posted, places): parts of the index, written to the shared folder."""
    shared = rows.sparkSession.sparkContext.broadcast(raised(pivots, longest) / longest)
    size = pivots.shape[1]

    def packed(ids, m, number):
        order = permutations(raised(m, longest), shared.value, prefix)
        flat = order.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        starts = np.searchsorted(flat[by_pivot], np.arange(len(shared.value) + 1))
        posted, places = np.divmod(by_pivot, order.shape[1])
        cells = [number, *(a.astype(t).tobytes() for a, t in ((ids, "<i8"), (m, "<f8"), (starts, "<i4"), (posted, "<i4"), (places, "<i2")))]
        return pa.RecordBatch.from_pydict(dict(zip(("part", "ids", "vecs", "starts", "posted", "places"), ([c] for c in cells), strict=True)))

    def index(batches):
        number, ids, vecs = TaskContext.get().partitionId() << 32, np.zeros(0, np.int64), np.zeros((0, size))
        for b in batches:
            for i, m in matrices(b):
                if m.shape[1] == size:
                    ids, vecs = np.concatenate([ids, i]), np.concatenate([vecs, m])
                while len(ids) >= part:
                    yield packed(ids[:part], vecs[:part], number)
                    number, ids, vecs = number + 1, ids[part:], vecs[part:]
        if len(ids):
            yield packed(ids, vecs, number)

    return materialize(rows.mapInArrow(index, "part long, ids binary, vecs binary, starts binary, posted binary, places binary"), "permutations")


def nearness(row: dict, order: np.ndarray, prefix: int):
    """For each query (its pivots in order) the nearness of a part's rows: prefix minus difference of places, summed over shared pivots."""
    starts, posted, places = (np.frombuffer(row[c], t) for c, t in (("starts", "<i4"), ("posted", "<i4"), ("places", "<i2")))
    rows = len(row["ids"]) // 8
    for own in order:
        a, n = starts[own], starts[own + 1] - starts[own]
        at = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        worth = prefix - np.abs(places[at].astype(np.int32) - np.repeat(np.arange(len(own), dtype=np.int32), n))
        yield np.bincount(posted[at], worth, rows).astype(np.int32)


def search(index: DataFrame, block, pivots: np.ndarray, longest: float, prefix: int, asked: int, candidates: int, k: int, out: str) -> None:
    """Write rows (query_id, rank, vec_id, score) of a block of queries."""
    spark = index.sparkSession
    dim = pivots.shape[1]
    _, own, q = by_length(block).get(dim, (None, np.zeros(0, np.int64), np.zeros((0, dim))))
    if not len(q):
        return
    order = permutations(np.concatenate([q, np.zeros((len(q), 1))], 1), raised(pivots, longest) / longest, min(asked, prefix))
    shared = spark.sparkContext.broadcast((own, q, order))
    prefix = min(prefix, len(pivots))
    step = max(1, -(-(prefix * order.shape[1] + 1) // BINS))

    def bins(batches):
        own, _, order = shared.value
        total = np.zeros((len(own), BINS), np.int64)
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                for i, near in enumerate(nearness(row, order, prefix)):
                    total[i] += np.bincount(near[ids != own[i]] // step, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(own)), pa.int32()), *[pa.array(total[:, i], pa.int64()) for i in range(BINS)]], names=["q", *names])

    names = [f"h{i}" for i in range(BINS)]
    summed = index.mapInArrow(bins, "q int, " + ", ".join(f"{n} long" for n in names)).groupBy("q").agg(*[F.sum(n).alias(n) for n in names])
    floor = np.zeros(len(own), np.int64)
    for r in summed.collect():
        down = np.cumsum(np.array(r[1:], np.int64)[::-1])
        floor[r[0]] = (BINS - 1 - int(np.argmax(down >= candidates))) * step if down[-1] >= candidates else 0
    admitted = spark.sparkContext.broadcast(floor)

    def rerank(batches):
        own, q, order = shared.value
        for b in batches:
            for row in b.to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                m = np.frombuffer(row["vecs"], "<f8").reshape(len(ids), dim)
                kept = []
                for i, near in enumerate(nearness(row, order, prefix)):
                    at = np.flatnonzero((near >= admitted.value[i]) & (ids != own[i]))
                    score = np.einsum("ij,j->i", m[at], q[i])
                    top = np.lexsort((ids[at], -score))[:k]
                    kept.append((np.full(len(top), own[i]), ids[at][top], score[top]))
                who, vec, score = map(np.concatenate, zip(*kept, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(vec, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "vec_id", "score"])

    ranked(index.mapInArrow(rerank, "query_id long, vec_id long, score double"), k).write.mode("append").parquet(out)
    shared.destroy()
    admitted.destroy()


def neighbours(table: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX, asked: int = ASKED, candidates: int | None = None) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's ``k`` nearest found by inner product."""
    spark = table.sparkSession
    with tidy(spark):
        rows = table.where(taking_part(nonzero=True)).select("vec_id", "embedding")
        squares = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        n, longest = rows.agg(F.count(F.lit(1)), F.max(F.sqrt(squares))).first()
        chosen = sampled_pivots(rows, pivots)
        out = scratch_path(spark, "neighbours", keep=True)
        spark.createDataFrame([], FOUND).write.parquet(out)
        if len(chosen):
            index = build(rows, chosen, longest, prefix, PART)
            want = candidates or max(k, int(np.ceil(WIDTH * np.sqrt(n))))
            for block in query_blocks(queries.where(taking_part(nonzero=True)).select("vec_id", "embedding"), QUERIES):
                search(index, block, chosen, longest, prefix, asked, want, k, out)
    return spark.read.schema(FOUND).parquet(out)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return neighbours(table, table.where(F.col("vec_id") % 20 == 0))
