"""Vector tables as arrays: parsing, query blocks of bounded size, and the last ranking step."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm.common import materialize, positions

#: Queries scored against all candidates at a time: what is broadcast is at most this many vectors.
BLOCK = 4096
#: Candidate rows turned into one score matrix.
ROWS = 512


def taking_part(nonzero: bool = False) -> Column:
    """Rows with an id and a vector of finite components (``nonzero``: and not all zero)."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite
    if nonzero:
        ok = ok & F.exists("embedding", lambda x: x != 0)
    return F.coalesce(ok, F.lit(False))


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors as doubles) of a batch's valid rows, for each vector length, ``ROWS`` at a time."""
    ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
    col = batch.column("embedding")
    lengths = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    for size in np.unique(lengths):
        rows = np.flatnonzero(lengths == size)
        for at in range(0, len(rows), ROWS):
            part = rows[at : at + ROWS]
            yield ids[part], flat[(ends[part] - size)[:, None] + np.arange(size)]


def query_blocks(queries: DataFrame, block: int = BLOCK) -> Iterator[list[tuple[int, list[float]]]]:
    """The query rows, at most ``block`` on the driver at a time. A repeated query id counts once, by its smallest vector."""
    once = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    numbered = materialize(positions(once, [], [F.col("vec_id")], "_llm_k").withColumn("_llm_b", F.floor(F.col("_llm_k") / block)), "queries")
    last = numbered.agg(F.max("_llm_b")).first()[0]
    for i in range(-1 if last is None else last, -1, -1):
        yield [(r[0], r[1]) for r in numbered.where(F.col("_llm_b") == i).orderBy("vec_id").select("vec_id", "embedding").collect()]


def by_length(block: list[tuple[int, list[float]]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Vector length -> (places in the block, ids, vectors)."""
    out = {}
    for size in {len(v) for _, v in block}:
        at = [i for i, (_, v) in enumerate(block) if len(v) == size]
        out[size] = (np.array(at), np.array([block[i][0] for i in at], np.int64), np.array([block[i][1] for i in at], np.float64).reshape(len(at), size))
    return out


def best(scores: np.ndarray, query: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best rows: score falling, then id rising."""
    order = np.lexsort((vec, -scores, query))
    q = query[order]
    first = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return order[rank < k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query of what the tasks have kept (at most k for each task and query)."""
    over = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(over)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
