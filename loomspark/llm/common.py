"""Shared helpers: scratch tables, distributed positions, components, whole-array text scanning."""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import inspect
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Sequence
from contextlib import contextmanager
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediate tables.

    ``spark.checkpoint.dir`` names it. Where it is unset, a context's checkpoint folder is taken, then, on a
    cluster, a folder in the warehouse (shared by definition), and only in local mode a temporary folder.
    """
    if root := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return root
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    root = tempfile.mkdtemp(prefix="loomspark-")
    atexit.register(shutil.rmtree, root, True)
    spark.sparkContext.setCheckpointDir(root)
    return root


#: Paths of the operators that run now, innermost last; of the results of the last pipeline stage; of other results.
_running: list[list[str]] = []
_staged: list[str] = []
_results: list[str] = []


def scratch_path(spark: SparkSession, tag: str, keep: bool = False) -> str:
    """A new path, deleted when the operator that asks for it ends; ``keep``: when the one around it does."""
    path = f"{scratch_root(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    level = len(_running) - 1 - keep
    (_running[level] if level >= 0 else _results).append(path)
    return path


def delete(spark: SparkSession, paths: Sequence[str]) -> None:
    """Delete written tables, and let the driver's garbage go, and with it the shuffle files of what has ended."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(conf).delete(where, True)
    gc.collect()
    jvm.System.gc()


@contextmanager
def tidy(spark: SparkSession):
    """What is written inside is deleted at the end, but for what is kept."""
    own: list[str] = []
    _running.append(own)
    try:
        yield
    finally:
        _running.pop()
        delete(spark, own)


def roots(df: DataFrame) -> str:
    """The folders that a DataFrame's files lie in."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation":
            out.append(leaves.apply(i).relation().location().rootPaths().mkString(" "))
    return " ".join(out)


def stage(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A pipeline stage: as it starts, the tables that the stage before read go, unless ``docs`` still reads them."""

    @wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _staged:
            read = roots(docs)
            gone = [p for p in _staged if p.rsplit("/", 1)[-1] not in read]
            delete(spark, gone)
            _staged[:] = [p for p in _staged if p not in gone]
        before = len(_results)
        out = work(spark, docs, sf_dir)
        _staged.extend(_results[before:])
        del _results[before:]
        return out

    return run


def clear(spark: SparkSession) -> None:
    """Delete everything that results of this session's operators still read."""
    delete(spark, [*_staged, *_results])
    _staged.clear()
    _results.clear()


def materialize(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, tag, keep)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give this process's free memory back to the system: allocators keep it, and Spark keeps idle workers."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library's
    if trim:
        trim(0)


def lean(work: Callable) -> Callable:
    """``work`` of mapInArrow or of (cogrouped) applyInArrow, whose worker releases memory at the end of each partition or group."""
    if inspect.isgeneratorfunction(work):

        def rows(batches):
            try:
                yield from work(batches)
            finally:
                release()

        return rows

    def one(a):
        try:
            return work(a)
        finally:
            release()

    def two(a, b):
        try:
            return work(a, b)
        finally:
            release()

    return {1: one, 2: two}[len(inspect.signature(work).parameters)]  # Spark looks at how many there are


def same(left: DataFrame, right: DataFrame, names: Sequence[str]) -> Column:
    """Null-safe equality of the columns ``names`` of both sides."""
    out = F.lit(True)
    for name in names:
        out = out & left[name].eqNullSafe(right[name])
    return out


def positions(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str = "_pos", total: str | None = None) -> DataFrame:
    """Number the rows of each group from 0 in ``order``, without ever bringing a group to one task.

    Rows are range-partitioned by (group, order), sorted inside the partitions and written with their place in
    the partition; per-partition counts of each group then give where each partition starts in its group. The
    only window runs over these counts: at most partitions + groups rows. ``total``: also the group's size.
    """
    keys = [F.col(c).asc_nulls_last() for c in group] + list(order)
    rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_llm_m", F.monotonically_increasing_id())
    rows = materialize(rows, "positions")
    rows = rows.withColumn("_llm_part", F.shiftright("_llm_m", 33)).withColumn("_llm_row", F.col("_llm_m").bitwiseAND(F.lit((1 << 33) - 1)))
    starts = rows.groupBy("_llm_part", *group).agg(F.count(F.lit(1)).alias("_llm_n"), F.min("_llm_row").alias("_llm_first"))
    over = Window.partitionBy(*group)
    before = F.coalesce(F.sum("_llm_n").over(over.orderBy("_llm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = starts.withColumn("_llm_before", before)
    if total:
        starts = starts.withColumn(total, F.sum("_llm_n").over(over))
    on = ["_llm_part", *group]
    right = starts.select(*[F.col(c).alias(f"_llm_r{i}") for i, c in enumerate(on)], "_llm_first", "_llm_before", *([total] if total else []))
    match = F.lit(True)
    for i, c in enumerate(on):
        match = match & F.col(c).eqNullSafe(F.col(f"_llm_r{i}"))
    out = rows.join(right, match).withColumn(name, F.col("_llm_row") - F.col("_llm_first") + F.col("_llm_before"))
    return out.select(*[c for c in df.columns if c not in (name, total)], name, *([total] if total else []))


def doc_key(text: str = "text") -> Column:
    """A 64-bit digest that, beside the id, tells apart rows which repeat an id with another text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("\x00null")))


def components(edges: DataFrame, a: str, b: str, tag: str = "cc") -> DataFrame:
    """Connected components of an undirected edge table over longs: rows (node, comp), comp the smallest node.

    Alternating large-star and small-star steps (Kiveris et al., 2014), each written to the shared folder.
    Every step is a distributed aggregation and join; no link reaches the driver. Stops when every component is a star,
    which a count by node with partial sums tells: each node above the centre has one link, and none is a centre too.
    """
    cur = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    cur = materialize(cur, tag)
    while True:
        ends = cur.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(cur.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up > 0 and down > 0").limit(1).count():
            break
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialize(large, tag)  # one link of ``cur`` makes one; what repeats goes in the next step
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        cur = materialize(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), tag)
    out = cur.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return out.union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


# ---------------------------------------------------------------- whole arrays of text

M64 = np.uint64(0xFFFFFFFFFFFFFFFF)
_SPACE = np.zeros(256, np.bool_)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_EDGE = re.compile(rb"[\x20\x09-\x0D]")


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes hashed at a time; longer texts are taken block by block, cut at white space.
BLOCK = 1 << 21


def word_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    inside = ~_SPACE[buf]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


class _Words(dict):
    """Keyed 64-bit digests of words; so many of the shorter ones are remembered."""

    def __missing__(self, word: bytes) -> int:
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"loomspark words").digest(), "little")
        if len(word) <= 32 and len(self) < 1 << 18:
            self[word] = h
        return h


_words = _Words()


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word; bytes.split() parts words at ASCII white space. Block by block, cut at white space.

    The digest is keyed, so unlike sums of powers no two words can be written down that meet.
    """
    out, at = [], 0
    while at < len(text):
        to = at + BLOCK
        if to < len(text):
            edge = _EDGE.search(text, to)
            to = edge.start() if edge else len(text)
        part = text[at:to].split()
        out.append(np.fromiter(map(_words.__getitem__, part), np.uint64, len(part)))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; fewer words make one run; none makes none."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out = mix64(out ^ words[i : len(words) - n + 1 + i]) + np.uint64(0x9E3779B97F4A7C15)
    return mix64(out + np.uint64(n))


def chunks(sizes: Sequence[int], most: int):
    """Runs of consecutive items whose sizes add up to about ``most``; an item over it stands alone."""
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > most:
            yield at, i
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield at, len(sizes)
