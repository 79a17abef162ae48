"""Documents in blocks of some megabytes that ask shards by digest and meet the answers.

A block row holds its documents (an Arrow stream, compressed); further rows list, for each shard, what the block asks
about, each thing once however often the block has it. Shards answer a bounded number of blocks at a time, and each
block is joined with its answers. Texts move once, compressed; nothing grows with the square of anything.
"""

from __future__ import annotations

import bz2
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loomspark.llm.common import chunks, lean


def small(a: np.ndarray, kind: str) -> bytes:
    """An array of fixed-size numbers, compressed by byte plane."""
    return zstandard.compress(a.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes(), 1)


def unsmall(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def squeeze(a: np.ndarray) -> bytes:
    """A rising array of unsigned 64-bit numbers."""
    return small(np.diff(a, prepend=np.zeros(1, a.dtype)), "<u8")


def loosen(data: bytes) -> np.ndarray:
    return np.cumsum(unsmall(data, "<u8"), dtype=np.uint64)


def split(of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of each value of an array of shards."""
    order = np.argsort(of, kind="stable")
    cut = np.flatnonzero(np.diff(of[order], prepend=-1))
    for a, z in zip(cut, np.append(cut[1:], len(order)), strict=True):
        yield int(of[order[a]]), order[a:z]


def encoded(table: pa.Table) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in table.column("text").to_pylist()]


def documents(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(bz2.decompress(data)).read_all()


def write_blocks(docs: DataFrame, path: str, block: int, ask: Callable[[pa.Table, int], Iterator[tuple[int, int, bytes, bytes | None]]]) -> None:
    """Write blocks of ``docs`` as Parquet: kind 0 the documents, and what ``ask(documents, block)`` gives as (kind, shard, data, more)."""

    def emit(number, batches):
        table = pa.Table.from_batches(batches).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        rows = [(0, number, -1, bz2.compress(sink.getvalue()), None)]
        for kind, shard, data, more in ask(table, number):
            rows.append((kind, number, shard, data, more))
            if len(rows) == 64:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def work(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for b in batches:
            lengths = pa.compute.fill_null(pa.compute.binary_length(b.column("text")), 0).to_pylist()
            for a, z in chunks(lengths, block):
                if held and size + sum(lengths[a:z]) > block:
                    yield from emit(number, held)
                    number, held, size = number + 1, [], 0
                held.append(b.slice(a, z - a))
                size += sum(lengths[a:z])
        if held:
            yield from emit(number, held)

    names, types = ["kind", "block", "shard", "data", "more"], [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    rows = docs.mapInArrow(lean(work), "kind int, block long, shard int, data binary, more binary")
    rows.write.partitionBy("kind").option("compression", "none").parquet(path)


def kind(docs: DataFrame, path: str, which: int) -> DataFrame:
    """Rows (block, shard, data, more) of one kind."""
    rows = docs.sparkSession.read.schema("block long, shard int, data binary, more binary, kind int").parquet(path)
    return rows.where(f"kind = {which}").drop("kind")


def form(docs: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
