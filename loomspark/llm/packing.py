"""Best-fit packing of documents into sequences, improved by swap-based local search.

Pieces (documents, cut only where longer than a sequence) are dealt at random into groups of bounded size, and each
group is packed on its own: best fit over falling lengths, then local search between underfull sequences. It moves a
piece, exchanges one for one, one for two or two for one, always raising the sum of squared fills, so that full
sequences get fuller until others are empty. A group leaves at most a part of one sequence more than one packing of
everything would; groups hold tens of thousands of pieces.

Nulls: a null text is empty (its end id only). Repeated rows are packed each. An empty table gives none.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.common import lean, materialize, stage
from loomspark.llm.tokens import encoder

CAPACITY = 4096
#: Pieces packed together.
GROUP = 40_000


def pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids], row): the pieces of each document's ids and end id."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches):
        encode, row = encoder(tokenizer), TaskContext.get().partitionId() << 36
        for b in batches:
            out = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py() or "") + last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    out.append((doc_id, i, at // 4, len(part) // 4, zlib.crc32(part), row, *([part] if keep_ids else [])))
                    row += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row", *(["ids"] if keep_ids else [])]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return docs.select("doc_id", "text").mapInArrow(lean(cut), "doc_id long, piece int, start long, length long, ids_crc32 long, row long" + (", ids binary" if keep_ids else ""))


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Longest first, each into the fullest sequence that has room."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # the rooms that some sequence has, rising
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            bins.append([i])
            room, b = capacity - size, len(bins) - 1
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            bins[b].append(i)
            room -= size
        if room:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append(b)
    return bins


class _Rooms:
    """Of the sequences that may take a piece: by room, and by what one or two of their pieces add up to."""

    def __init__(self, bins: list[list[int]], fill: list[int], lengths: np.ndarray, capacity: int) -> None:
        self.bins, self.fill, self.lengths, self.capacity = bins, fill, lengths, capacity
        self.of_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.some = np.zeros(capacity + 1, bool)
        #: By sum, sequences as (-room, sequence, version), and the largest piece that can take the sum's place (below it if none can).
        self.heaps: list[list[list[tuple[int, int, int]]]] = [[[] for _ in range(capacity + 1)] for _ in range(2)]
        self.reach = [np.arange(capacity + 1) - 1 for _ in range(2)]
        self.version = [0] * len(bins)
        self.sums: dict[int, tuple[list[int], list[int]]] = {}

    def add(self, b: int) -> None:
        room, version = self.capacity - self.fill[b], self.version[b]
        if not room or b in self.sums:
            return
        size = self.lengths[self.bins[b]]
        x, y = np.triu_indices(len(size), 1)
        two = size[x] + size[y]
        self.sums[b] = np.unique(size).tolist(), np.unique(two).tolist()
        for sums, heaps, reach in zip(self.sums[b], self.heaps, self.reach, strict=True):
            for n in sums:
                heappush(heaps[n], (-room, b, version))
                reach[n] = max(reach[n], n + room)
        self.of_room[room].add(b)
        self.some[room] = True

    def remove(self, b: int) -> None:
        """To be called before the sequence changes."""
        if b not in self.sums:
            return
        self.version[b] += 1
        for sums, heaps, reach in zip(self.sums.pop(b), self.heaps, self.reach, strict=True):
            for n in sums:
                heap = heaps[n]
                while heap and self.version[heap[0][1]] != heap[0][2]:
                    heappop(heap)
                reach[n] = n - heap[0][0] if heap else n - 1
        room = self.capacity - self.fill[b]
        self.of_room[room].discard(b)
        self.some[room] = bool(self.of_room[room])

    def roomy(self, n: int) -> int | None:
        """The fullest sequence with room for a piece."""
        at = int(np.argmax(self.some[n:])) + n
        return next(iter(self.of_room[at])) if self.some[at] else None

    def instead(self, n: int, many: int) -> tuple[int, list[int]] | None:
        """A sequence and one or two of its pieces whose place n tokens can take with most gain."""
        ok = self.reach[many - 1][:n] >= n
        at = int(np.argmax(ok)) if n else 0
        if not n or not ok[at]:
            return None
        b = self.heaps[many - 1][at][0][1]
        own = self.bins[b]
        if many == 1:
            return b, [next(i for i in own if self.lengths[i] == at)]
        seen: dict[int, int] = {}
        for i in own:
            size = int(self.lengths[i])
            if at - size in seen:
                return b, [seen[at - size], i]
            seen[size] = i
        return None


def improve(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Local search: empty the emptiest sequences into the rooms of the others; every step raises the squared fill.

    Each round tries every underfull sequence, against all those at least as full. It ends with a round that empties
    none, or at the lower bound.
    """
    fill = [int(lengths[b].sum()) for b in map(np.array, bins)]
    least, left = -(-sum(fill) // capacity), len(bins)
    if left <= least:
        return [b for b in bins if b]
    rooms = _Rooms(bins, fill, lengths, capacity)
    before = left + 1
    while least < left < before:
        before = left
        todo = [(f, b) for b, f in enumerate(fill) if bins[b] and f < capacity]
        for _, b in todo:
            rooms.add(b)
        heapify(todo)
        aside: list[tuple[int, int]] = []  # tried, and emptier than the source
        tried: set[int] = set()  # tried, and not emptier than the source
        while todo and left > least:
            f, source = heappop(todo)
            if f != fill[source]:  # has become fuller
                if fill[source] < capacity:
                    heappush(todo, (fill[source], source))
                continue
            for b in [b for b in tried if fill[b] < f]:
                tried.remove(b)
                rooms.remove(b)
                heappush(aside, (-fill[b], b))
            rooms.remove(source)
            while bins[source]:
                while aside and -aside[0][0] >= fill[source]:
                    b = heappop(aside)[1]
                    tried.add(b)
                    rooms.add(b)
                step = _step(rooms, bins[source], lengths)
                if step is None:
                    break
                out, target, back = step
                rooms.remove(target)
                _exchange(bins, fill, lengths, source, out, target, back)
                rooms.add(target)
            if bins[source]:
                heappush(aside, (-fill[source], source))
            else:
                left -= 1
    return [b for b in bins if b]


def _step(rooms: _Rooms, own: list[int], lengths: np.ndarray) -> tuple[list[int], int, list[int]] | None:
    """Pieces of a sequence, another sequence, and the pieces of it that they replace."""
    one = {int(lengths[i]): i for i in own}
    for n in sorted(one, reverse=True):
        target = rooms.roomy(n)
        if target is not None:
            return [one[n]], target, []
        step = rooms.instead(n, 1) or rooms.instead(n, 2)
        if step:
            return [one[n]], *step
    if len(own) > 1:  # two for one
        size, best = lengths[own], np.maximum.accumulate(rooms.reach[0])
        x, y = np.triu_indices(len(own), 1)
        n = size[x] + size[y]
        ok = np.flatnonzero(best[n - 1] >= n)
        if len(ok):
            at = ok[np.argmax(n[ok])]
            target, back = rooms.instead(int(n[at]), 1)
            return [own[x[at]], own[y[at]]], target, back
    return None


def _exchange(bins, fill, lengths, source, out, target, back) -> None:
    for i in out:
        bins[source].remove(i)
        bins[target].append(i)
    for i in back:
        bins[target].remove(i)
        bins[source].append(i)
    gain = int(lengths[out].sum()) - (int(lengths[back].sum()) if back else 0)
    fill[source] -= gain
    fill[target] += gain


def pack(parts: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """The input's columns but row, with sequence_id and offset. ``parts`` needs length (at most capacity) and row (unique)."""
    groups = max(1, -(-parts.count() // group))
    keep = [f for f in parts.schema if f.name not in ("row", "sequence_id", "offset")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep) + ", sequence_id long, offset long"

    def solve(key, table):
        table = table.sort_by("row")
        lengths = table.column("length").to_numpy()
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, b in enumerate(improve(best_fit(lengths, capacity), lengths, capacity)):
            sequence[b] = (key[0].as_py() << 32) + i
            offset[b] = np.concatenate([[0], np.cumsum(lengths[b])[:-1]])
        return table.select([f.name for f in keep]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    dealt = parts.withColumn("_llm_group", F.pmod(F.xxhash64("row"), F.lit(groups)))
    return dealt.groupBy("_llm_group").applyInArrow(lean(solve), schema)


def packed(docs: DataFrame) -> DataFrame:
    return pack(materialize(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), 1), "pieces"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))


@stage
def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents with their places in sequences."""
    return packed(docs)
