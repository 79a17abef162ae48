"""Substring deduplication by content-defined chunking.

A gear hash rolls over the bytes; a chunk may end at the end of a word whose hash has given bits, at least ``LEAST``
words after the last end. As the bits see the last sixteen bytes only, chunks fall into step again soon after an
insertion or deletion. Chunks are deduplicated by a 64-bit digest of their words: the first occurrence (smallest
doc_id) stays. Only runs of repeated chunks of at least ``RUN`` words are cut, so that a passage of over 50 words is
caught although its ends share chunks with what surrounds it, and short turns of phrase are left alone.

Each block asks the shards about each of its digests once, however often it has it, so a passage that a third of all
documents share costs a row a block; a shard's lists are merged, and blocks are answered, a bounded number at a time. Rows are first by doc_id (null last), then by place in the table.

Nulls: a null text stays null. A text of which nothing is left becomes empty. Repeated rows are documents like any
others: the second is a copy of the first. An empty table gives none. White space beside a cut goes with it. Input
columns named like the output's are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.blocks import documents, encoded, form, kind, loosen, small, split, squeeze, unsmall, write_blocks
from loomspark.llm.common import delete, lean, materialize, mix64, scratch_path, stage, tidy, word_hashes, word_spans

#: A chunk has at least so many words, and at most MOST.
LEAST, MOST = 4, 64
#: A word may end a chunk if the three hash bits from 13 up are below this.
ENDS = 3
#: Words in a run of repeated chunks that is cut.
RUN = 25
BLOCK = 6 << 20
#: Digests that a shard is made for.
SHARD = 1 << 19
#: Blocks whose lists meet in one task.
FAN = 256
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def gear(buf: np.ndarray) -> np.ndarray:
    """The rolling hash h = 2h + G[byte] modulo 2**32 at every byte: 32 steps by doubling."""
    h = _GEAR[buf]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunk(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(digest, first byte, words) of the chunks of a text; they end where the next begins."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends = word_spans(buf)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    last = np.empty(len(ends), np.uint32)
    for a in range(0, len(buf), 1 << 21):
        lead = max(0, a - 32)
        lo, hi = np.searchsorted(ends, [a + 1, a + (1 << 21) + 1])
        if hi > lo:
            last[lo:hi] = gear(buf[lead : a + (1 << 21)])[ends[lo:hi] - 1 - lead]
    at, cuts = 0, [0]
    for c in (np.flatnonzero(((last >> np.uint32(13)) & np.uint32(7)) < ENDS) + 1).tolist():
        while c - at > MOST:
            at += MOST
            cuts.append(at)
        if c - at >= LEAST and c < len(starts):
            at = c
            cuts.append(at)
    while len(starts) - at > MOST:
        at += MOST
        cuts.append(at)
    first = np.array(cuts)
    words = np.diff(np.append(first, len(starts)))
    place = np.arange(len(starts)) - np.repeat(first, words)
    mixed = mix64(word_hashes(text) + mix64(place.astype(np.uint64) + np.uint64(77)))
    return mix64(np.add.reduceat(mixed, first) + words.astype(np.uint64)), starts[first], words


def _rank(ids: list[int | None]) -> np.ndarray:
    """doc_ids as unsigned numbers in their order, null last."""
    return np.array([(1 << 64) - 1 if d is None else d + (1 << 63) for d in ids], np.uint64)


def asks(shards: int):
    def ask(table, number):
        parts = [chunk(t)[0] for t in encoded(table)]
        digest = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        doc = np.repeat(_rank(table.column("doc_id").to_pylist()), [len(p) for p in parts])
        order = np.lexsort((doc, digest))
        digest, doc = digest[order], doc[order]
        first = np.flatnonzero(np.diff(digest, prepend=~digest[:1]))
        count = np.minimum(np.diff(np.append(first, len(digest))), 2)
        digest, doc = digest[first], doc[first]
        for s, at in split((digest % np.uint64(shards)).astype(np.int64)):
            yield 1, s, squeeze(digest[at]), small(np.stack([doc[at] - doc.min(), count[at].astype(np.uint64)]).ravel(), "<u8") + small(doc.min()[None], "<u8")

    return ask


_TAIL = len(small(np.zeros(1, np.uint64), "<u8"))


def _lists(table: pa.Table):
    """(digest, block, doc, count) of requests."""
    out = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
    for b, d, m in zip(table.column("block").to_pylist(), table.column("data"), table.column("more"), strict=True):
        more = m.as_py()
        cells, base = unsmall(more[:-_TAIL], "<u8").reshape(2, -1), unsmall(more[-_TAIL:], "<u8")[0]
        digest = loosen(d.as_py())
        out.append((digest, np.full(len(digest), b), cells[0] + base, cells[1]))
    return map(np.concatenate, zip(*out, strict=True))


def _first(digest, block, doc, count):
    """Of each digest its first document, that one's block and whether it occurs twice."""
    order = np.lexsort((block, doc, digest))
    digest, block, doc, count = digest[order], block[order], doc[order], count[order]
    first = np.flatnonzero(np.diff(digest, prepend=~digest[:1]))
    return digest[first], block[first], doc[first], np.minimum(np.add.reduceat(count, first) if len(first) else count, 2)


def owners(asked: DataFrame, blocks: int) -> DataFrame:
    """Rows (shard, digest, home, doc): of a shard's digests that occur twice the first document and its block.

    Lists are merged ``FAN`` at a time, in rounds, so that a digest of every block is in no task more than so often.
    """

    def merge(final: bool):
        def work(table):
            parts = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))]
            raw = table.filter(pa.compute.is_valid(table.column("data")))
            for at in range(0, raw.num_rows, 32):
                parts = [_first(*map(np.concatenate, zip(*parts, tuple(_lists(raw.slice(at, 32))), strict=True)))]
            for row in table.filter(pa.compute.is_null(table.column("data"))).select(["digest", "home", "doc", "count"]).to_pylist():
                one = (loosen(row["digest"]), *(unsmall(row[c], t) for c, t in (("home", "<i8"), ("doc", "<u8"), ("count", "<u8"))))
                parts = [_first(*map(np.concatenate, zip(*parts, one, strict=True)))]
            got = [x[parts[0][3] > 1] for x in parts[0]] if final else parts[0]
            row = [squeeze(got[0]), *(small(x, t) for x, t in zip(got[1:], ("<i8", "<u8", "<u8"), strict=True))]
            return pa.Table.from_arrays([table.column("shard")[:1], table.column("salt")[:1], pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), *[pa.array([x], pa.binary()) for x in row]], names=names)

        return work

    names = ["shard", "salt", "data", "more", "block", "digest", "home", "doc", "count"]
    form_ = "shard int, salt int, data binary, more binary, block long, digest binary, home binary, doc binary, count binary"
    rows = asked.withColumn("salt", salted(blocks)).withColumns({c: F.lit(None).cast("binary") for c in names[5:]}).select(*names)
    many = -(-blocks // FAN)
    while many > 1:
        rows = rows.groupBy("shard", "salt").applyInArrow(lean(merge(False)), form_)
        many = -(-many // FAN)
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("salt"), F.lit(many)).cast("int"))
    rows = rows.withColumn("salt", F.lit(0)).groupBy("shard").applyInArrow(lean(merge(True)), form_)
    return materialize(rows.select("shard", "digest", "home", "doc"), "owners")


def salted(blocks: int):
    return F.pmod(F.xxhash64("block"), F.lit(-(-blocks // FAN) or 1)).cast("int")


def answers(asked: DataFrame, owned: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, data, owner, here): of each block the digests that occur elsewhere too, or twice, their first
    document and whether it is in this block. ``FAN`` blocks at a time."""

    def answer(own, requests):
        out = []
        one, home, owner = map(np.concatenate, zip(*((loosen(r["digest"]), unsmall(r["home"], "<i8"), unsmall(r["doc"], "<u8")) for r in own.to_pylist()), strict=True))
        if len(one):
            for b, d in zip(requests.column("block").to_pylist(), requests.column("data"), strict=True):
                digest = loosen(d.as_py())
                at = np.minimum(np.searchsorted(one, digest), len(one) - 1)
                digest, at = digest[one[at] == digest], at[one[at] == digest]
                if len(digest):
                    out.append((b, small(digest, "<u8"), small(owner[at], "<u8"), small(home[at] == b, "u1")))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("block", "data", "owner", "here"), cols, (pa.int64(), *[pa.binary()] * 3), strict=True)})

    owned = owned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(max(0, -(-blocks // FAN) - 1)))))
    asked = asked.select("block", "shard", "data").withColumn("salt", salted(blocks))
    return owned.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(lean(answer), "block long, data binary, owner binary, here binary")


def repeats(docs: DataFrame, block: int = BLOCK, run: int = RUN) -> DataFrame:
    """The input's columns, text without its repeats, with removed_words, spans (first byte and end in the input's
    text, of what was cut) and kept_in (doc_ids that hold the first occurrences, distinct)."""
    docs = docs.drop("removed_words", "spans", "kept_in")
    spark = docs.sparkSession
    path = scratch_path(spark, "chunks")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(8, total // 40 // SHARD)
    write_blocks(docs, path, block, asks(shards))
    packed = kind(docs, path, 0).select("block", "data")
    blocks = packed.count()
    with tidy(spark):
        owned = owners(kind(docs, path, 1), blocks)
        replies = materialize(answers(kind(docs, path, 1), owned, blocks), "replies", keep=True)
        delete(spark, [f"{path}/kind=1"])

    def cut(held, answers):
        got = [(unsmall(r["data"], "<u8"), unsmall(r["owner"], "<u8"), unsmall(r["here"], "u1")) for r in answers.to_pylist()]
        known, owner, here = map(np.concatenate, zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.uint8))
        order = np.argsort(known)
        known, owner, here = known[order], owner[order], here[order].astype(bool)
        out = []
        for data in held.column("data"):
            table = documents(data.as_py())
            texts, ids = encoded(table), _rank(table.column("doc_id").to_pylist())
            parts = [chunk(t) for t in texts]
            sizes = [len(p[0]) for p in parts]
            digest = np.concatenate([p[0] for p in parts]) if parts else known[:0]
            at = np.minimum(np.searchsorted(known, digest), max(0, len(known) - 1))
            twice = known[at] == digest if len(known) else np.zeros(len(digest), bool)
            doc = np.repeat(np.arange(len(texts)), sizes)
            mine = np.flatnonzero(twice & here[at]) if len(known) else np.zeros(0, int)
            order = mine[np.lexsort((mine, ids[doc[mine]], digest[mine]))]
            twice[order[np.diff(digest[order], prepend=~digest[order][:1]) != 0]] = False  # the first occurrence stays
            new, words, spans, kept, begin = [], [], [], [], 0
            for t, (_, first, n) in zip(texts, parts, strict=True):
                dup, own = twice[begin : begin + len(n)], at[begin : begin + len(n)]
                begin += len(n)
                edge = np.flatnonzero(np.diff(np.concatenate([[0], dup, [0]])))
                sums, stop = np.concatenate([[0], np.cumsum(n)]), np.append(first, len(t))
                runs = [(a, z) for a, z in edge.reshape(-1, 2).tolist() if sums[z] - sums[a] >= run]
                new.append(_without(t, stop, runs))
                words.append(int(sum(sums[z] - sums[a] for a, z in runs)))
                spans.append([{"first": int(stop[a]), "end": int(stop[z])} for a, z in runs])
                owners = np.unique(owner[np.concatenate([own[a:z] for a, z in runs])]) if runs else []
                kept.append([int(o) - (1 << 63) for o in owners if int(o) != (1 << 64) - 1])
            texts_out = [None if old is None else n.decode("utf-8", "surrogatepass") for old, n in zip(table.column("text").to_pylist(), new, strict=True)]
            table = table.set_column(table.schema.get_field_index("text"), table.schema.field("text"), pa.array(texts_out, table.schema.field("text").type))
            extra = pa.table({"removed_words": pa.array(words, pa.int64()), "spans": pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))), "kept_in": pa.array(kept, pa.list_(pa.int64()))})
            for name in extra.column_names:
                table = table.append_column(name, extra.column(name))
            out.append(table)
        return pa.concat_tables(out)

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean(cut), form(docs) + ", removed_words long, spans array<struct<first:long,end:long>>, kept_in array<long>")


def _without(text: bytes, stop: np.ndarray, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, z in runs:
        out.append(text[at : stop[a]])
        at = int(stop[z])
    return b"".join([*out, text[at:]]).rstrip() if runs else text


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold repeated passages, as they are without them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return repeats(docs).where("removed_words > 0")


@stage
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without repeated passages; a document of which nothing is left goes."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    out = repeats(docs.select(*cols)).where("removed_words = 0 or text <> ''")
    return out.withColumn("n_chars", F.when(F.col("removed_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*cols)
