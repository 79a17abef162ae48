"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into chunks of eight bits; level 0 has the lowest
chunk of every id, level k + 1 the next chunk of those that go on, and a bitmap on each level says which go on. A
rank directory (ones before every 512th bit) turns a place on one level into a place on the next in constant time, so
any token is read without decoding a block. A file is one or more segments, each followed by a line feed:

    8s  b"LOOMDAC1"      q  bytes of the segment      q  number (orders segments)
    q   documents        q  tokens                    q  levels
    documents x q  doc_id       documents x B  1 if doc_id is null      documents x q  end of the document in tokens
    each level: q entries, entries x B chunks, (entries + 7) // 8 x B bitmap, (entries + 511) // 512 x q ones before

All numbers are little-endian. Files are written and read by Spark alone, in any store it knows.

Nulls: a null text is empty (the end id only); rows with a null doc_id come first. Rows that repeat a doc_id follow
each other, ordered by a digest of the text. An empty table gives no segments and no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.llm.common import doc_key, materialize, scratch_path
from loomspark.llm.tokens import encoder

MAGIC = b"LOOMDAC1"
#: Tokens in a segment, unless a single document has more.
SEGMENT = 1 << 20
#: Bytes of text that go into one file.
FILE = 32 << 20
_HEAD = struct.Struct("<8sqqqqq")
_BLOCK = 512


def pack(number: int, doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray) -> bytes:
    levels = []
    rest = ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        before = np.concatenate([[0], np.cumsum(np.add.reduceat(more, np.arange(0, len(more), _BLOCK), dtype=np.int64))[:-1]]) if len(more) else np.zeros(0)
        levels.append(struct.pack("<q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + before.astype("<i8").tobytes())
        if not more.any():
            break
        rest = rest[more] >> 8
    docs = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + ends.astype("<i8").tobytes()
    size = _HEAD.size + len(docs) + sum(map(len, levels))
    return b"".join([_HEAD.pack(MAGIC, size, number, len(doc_ids), len(ids), len(levels)), docs, *levels])


class Segment:
    """A view of a segment's bytes; nothing is decoded until asked for."""

    def __init__(self, data: memoryview) -> None:
        magic, self.size, self.number, docs, self.tokens, levels = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token segment")
        at = _HEAD.size

        def take(count: int, kind: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null, self.ends = take(docs, "<i8"), take(docs, "u1"), take(docs, "<i8")
        self.levels = []
        for _ in range(levels):
            n = int(take(1, "<q")[0])
            self.levels.append((take(n, "u1"), take((n + 7) // 8, "u1"), take((n + _BLOCK - 1) // _BLOCK, "<i8")))

    def token(self, i: int) -> int:
        """The i-th token: one chunk, one bit and one rank a level."""
        value = 0
        for k, (chunk, bits, before) in enumerate(self.levels):
            value |= int(chunk[i]) << 8 * k
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // _BLOCK * _BLOCK
            part = int.from_bytes(bits[first >> 3 : (i >> 3) + 1].tobytes(), "little") & ((1 << (i - first)) - 1)
            i = int(before[i // _BLOCK]) + part.bit_count()
        return value

    def ids(self) -> np.ndarray:
        """All tokens."""
        out = np.zeros(self.tokens, "<u4")
        at = np.arange(self.tokens)
        for k, (chunk, bits, _) in enumerate(self.levels):
            out[at] |= chunk.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunk), bitorder="little").astype(bool)]
        return out


def segments(data: bytes) -> Iterator[Segment]:
    view, at = memoryview(data), 0
    while at < len(view):
        part = Segment(view[at:])
        yield part
        at += part.size + 1


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Encode ``docs`` (doc_id, text) and write the token files in ascending doc_id order under ``path``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", doc_key().alias("_llm_key"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(-(-total // FILE), min(spark.sparkContext.defaultParallelism, -(-total // (1 << 20))), 1)
    ordered = docs.repartitionByRange(parts, "doc_id", "_llm_key").sortWithinPartitions("doc_id", "_llm_key")
    last = np.array([end], "<u4").tobytes()

    def write(batches):
        encode, number = encoder(tokenizer), TaskContext.get().partitionId() << 32
        doc_ids, ends, parts, tokens = [], [], [], 0
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                if tokens >= SEGMENT:
                    yield pa.RecordBatch.from_pydict({"data": [pack(number, doc_ids, np.array(ends), np.frombuffer(b"".join(parts), "<u4"))]})
                    number, doc_ids, ends, parts, tokens = number + 1, [], [], [], 0
                ids = encode(text.as_py() or "") + last
                tokens += len(ids) // 4
                doc_ids.append(doc_id)
                ends.append(tokens)
                parts.append(ids)
        if doc_ids:
            yield pa.RecordBatch.from_pydict({"data": [pack(number, doc_ids, np.array(ends), np.frombuffer(b"".join(parts), "<u4"))]})

    ordered.mapInArrow(write, "data binary").select(F.col("data").cast("string").alias("value")).write.option("compression", "none").option("lineSep", "\n").text(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows (segment, place, doc_id, first, n_tokens, ids_crc32) of the token files under ``path``; first counts within the segment."""

    def read(batches):
        for b in batches:
            for data in b.column("content"):
                for s in segments(data.as_py()):
                    ids = memoryview(s.ids().tobytes())
                    first = np.concatenate([[0], s.ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(first.tolist(), s.ends.tolist(), strict=True)]
                    n = len(crc)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, s.number)), pa.array(np.arange(n)), pa.array(s.doc_ids, mask=s.null.astype(bool)), pa.array(first), pa.array(s.ends - first), pa.array(crc, pa.int64())],
                        names=["segment", "place", "doc_id", "first", "n_tokens", "ids_crc32"],
                    )

    schema = "segment long, place long, doc_id long, first long, n_tokens long, ids_crc32 long"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(read, schema)


def with_start(rows: DataFrame) -> DataFrame:
    """Add start: tokens of all documents before. The window has a row a segment (millions of tokens), not a row a document."""
    rows = materialize(rows, "tokens")
    sums = rows.groupBy("segment").agg(F.sum("n_tokens").alias("_llm_n"))
    over = Window.orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("segment", F.coalesce(F.sum("_llm_n").over(over), F.lit(0)).alias("_llm_before"))
    return rows.join(before, "segment").withColumn("start", F.col("_llm_before") + F.col("first")).drop("_llm_before")


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"), 0)
    return with_start(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")
