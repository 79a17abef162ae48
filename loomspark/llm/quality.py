"""Quality classifier: interpolated modified Kneser-Ney over byte n-grams, trained on trusted text.

Order 5, over the bytes of UTF-8, so nothing is out of vocabulary. Training and scoring are joins of counts by shard:

1. Documents are packed into blocks of some megabytes. A block lists its distinct n-grams once, by shard, and the
   counts of the n-grams of its trusted training documents. All of the trusted text is counted, no sample.
2. A shard is a set of (w3, w4) pairs, the two bytes before the predicted one. Whatever an n-gram of order 3 to 5
   needs (its count, its left extensions, what follows its context) has the same pair and so the same shard. Counts
   of a shard are merged in rounds of bounded fan-in. Orders 2 and 1 have at most 65,536 and 256 entries and are
   summed over the shards; they and the discounts are all that the driver gets.
3. A shard's counts are joined with the blocks' requests, a bounded number of blocks at a time, and answer with
   log probabilities.
4. Each block meets its answers and sums them by document.

So an n-gram travels once for each block and not once for each occurrence, and no text or model is collected.
A fifth of the trusted documents, by hash, is kept out of training; the quantiles of their perplexities, by language,
give the thresholds, so that training text doesn't flatter them. They are taken at their upper 95 % confidence limit, which matters where a
language has few such rows and tends to the quantile where it has many.
Words repeated over and over look fluent to five bytes. A text's repetition, the share of its words that occur among
the ``NEAR`` words before (one such word isn't counted), is therefore held against a threshold made the same way, the
language's or that over all languages, whichever is larger; above it a text isn't kept, whatever its perplexity.

Nulls: a null or empty text has null perplexity and isn't kept; a null lang is a language of its own; a language
without held-out trusted rows takes the threshold over all languages, and if there is none everything with text is
kept. Labels with a null in quality or toxic don't make a row trusted. Repeated rows are scored each. An empty table
gives none. Input columns named like the output's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import sqrt
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.blocks import documents, encoded, form, kind, loosen, small, split, squeeze, unsmall, write_blocks
from loomspark.llm.common import chunks, lean, materialize, mix64, scratch_path, stage, tidy, word_hashes

ORDER = 5
#: Bytes of text in a block.
BLOCK = 6 << 20
#: Blocks that a shard answers in one task, and lists of counts merged in one.
FAN = 256
#: The threshold is this quantile of the held-out trusted perplexities of the language (its upper 95 % confidence limit).
QUANTILE = 0.995
#: Labels up to this many are sent to every executor (16 bytes each); more are joined by shuffle.
SENT = 2_000_000
#: Words back within which a word counts as repeated.
NEAR = 4
_BITS = 10  # fixed point of the answers: 1/1024 bit


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram of each byte of the texts, bytes of each text); the last byte is lowest, zeros stand before a text."""
    pad = b"\0" * (ORDER - 1)
    buf = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    g = np.zeros(max(0, len(buf) - ORDER + 1), np.uint64)
    for i in range(ORDER):
        g = (g << np.uint64(8)) | buf[i : i + len(g)]
    real = np.ones(len(g) + ORDER - 1, bool)
    starts = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    real[(starts[:, None] + np.arange(ORDER - 1)).ravel()] = False
    return g[real[ORDER - 1 :]], sizes


def by_shard(g: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places) of n-grams."""
    return split((mix64((g >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64))


def distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate([np.unique(p) for p in parts])) if parts else np.zeros(0, np.uint64)


def repetition(text: bytes) -> float:
    """Share of the words that occur among the ``NEAR`` words before, one of them forgiven."""
    w = word_hashes(text)
    again = np.zeros(len(w), bool)
    for k in range(1, NEAR + 1):
        again[k:] |= w[k:] == w[:-k]
    return max(0, int(again.sum()) - 1) / max(1, len(w))


def asks(shards: int, block: int):
    """What a block asks: 1 its distinct n-grams, 2 counts of those of its training documents."""

    def ask(table, number):
        texts = encoded(table)
        train = np.array(table.column("_llm_train").to_pylist(), bool)
        seen: list[np.ndarray] = []
        for a, z in chunks([len(t) for t in texts], 4 * block):
            g, sizes = grams(texts[a:z])
            picked = g[np.repeat(train[a:z], sizes)]
            if len(picked):
                one, n = np.unique(picked, return_counts=True)
                for s, at in by_shard(one, shards):
                    yield 2, s, squeeze(one[at]), small(n[at], "<u8")
            seen.append(g)
        every = distinct(seen)
        for s, at in by_shard(every, shards):
            yield 1, s, squeeze(every[at]), None

    return ask


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and counts of several lists of counts, merged a few at a time."""
    g, n = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    lists = list(zip(table.column("data"), table.column("more"), strict=True))
    for at in range(0, len(lists), 32):
        parts = [(g, n), *((loosen(d.as_py()), unsmall(m.as_py(), "<u8")) for d, m in lists[at : at + 32])]
        all_, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(all_, kind="stable")
        all_, c = all_[order], c[order]
        first = np.flatnonzero(np.diff(all_, prepend=~all_[:1]))
        g, n = all_[first], np.add.reduceat(c, first) if len(first) else c
    return g, n


def orders(g: np.ndarray, n: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Order -> (n-grams, counts): counts of the highest order, left extensions below it; orders 5 to 3 of one shard."""
    out = {ORDER: (g, n)}
    for k in range(ORDER - 1, 2, -1):
        out[k] = np.unique(out[k + 1][0] & np.uint64((1 << 8 * k) - 1), return_counts=True)
    return out


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts of 0, 1, 2 and 3 or more, from how many n-grams have counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) * 0.5 for i in range(3)]
    return [0.0, *(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))]


class Model:
    """The bounded part of the model: discounts, and all probabilities of orders 1 and 2."""

    def __init__(self, tallies: dict[int, list[int]], pairs: dict[int, int]) -> None:
        self.discounts = {k: np.array(discounts(t)) for k, t in tallies.items()}
        two = np.zeros((256, 256))
        for p, c in pairs.items():
            two[p >> 8, p & 255] = c
        one = (two > 0).sum(0).astype(float)
        p1 = self.smooth(one[None, :], np.full((1, 256), 1 / 256))[0]
        self.two = self.smooth(two, np.tile(p1, (256, 1)))

    @staticmethod
    def smooth(c: np.ndarray, lower: np.ndarray) -> np.ndarray:
        d = np.array(discounts([int((c == i).sum()) for i in (1, 2, 3, 4)]))[np.minimum(c, 3).astype(int)]
        total = c.sum(1, keepdims=True)
        rest = np.where(total > 0, d.sum(1, keepdims=True) / np.maximum(total, 1), 1.0)
        return np.where(total > 0, np.maximum(c - d, 0) / np.maximum(total, 1), 0) + rest * lower

    def bits(self, asked: np.ndarray, g: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log2 of the probability of each asked n-gram's last byte after the others, from one shard's counts."""
        pair = asked & np.uint64(0xFFFF)
        p = self.two[(pair >> np.uint64(8)).astype(int), (pair & np.uint64(255)).astype(int)]
        for k, (keys, counts) in sorted(orders(g, n).items()):
            if not len(keys):
                continue
            d = self.discounts[k][np.minimum(counts, 3).astype(int)]
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.diff(context, prepend=~context[:1]))
            context, total, rest = context[first], np.add.reduceat(counts.astype(float), first), np.add.reduceat(d, first)
            want = asked & np.uint64((1 << 8 * k) - 1)
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = np.where(keys[at] == want, counts[at] - d[at], 0.0)
            of = np.minimum(np.searchsorted(context, want >> np.uint64(8)), len(context) - 1)
            known = context[of] == want >> np.uint64(8)
            p = np.where(known, (hit + rest[of] * p) / total[of], p)
        return -np.log2(np.maximum(p, 2.0**-60))


def train(spark: SparkSession, lists: DataFrame, blocks: int) -> tuple[DataFrame, Model]:
    """(rows (shard, data, more) of merged counts, bounded part of the model)."""
    schema = "shard int, salt long, data binary, more binary"
    rows = lists.withColumn("salt", F.col("block"))

    def merge(table):
        g, n = merged(table)
        return pa.table({"shard": table.column("shard")[:1], "salt": table.column("salt")[:1], "data": [squeeze(g)], "more": [small(n, "<u8")]}, schema=fields)

    fields = pa.schema([("shard", pa.int32()), ("salt", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
    many = blocks
    while many > FAN:
        many = -(-many // FAN)
        rows = rows.select("shard", F.pmod(F.xxhash64("salt"), F.lit(many)).alias("salt"), "data", "more").groupBy("shard", "salt").applyInArrow(lean(merge), schema)

    def last(table):
        g, n = merged(table)
        levels = orders(g, n)
        pairs, c = np.unique(levels[3][0] & np.uint64(0xFFFF), return_counts=True)
        tally = [int((levels[k][1] == i).sum()) for k in range(3, ORDER + 1) for i in (1, 2, 3, 4)]
        return pa.table({"shard": table.column("shard")[:1], "data": [squeeze(g)], "more": [small(n, "<u8")], "tally": [tally], "pairs": [pairs.astype(np.int64)], "n": [c]}, schema=done)

    done = pa.schema([("shard", pa.int32()), ("data", pa.binary()), ("more", pa.binary()), ("tally", pa.list_(pa.int64())), ("pairs", pa.list_(pa.int64())), ("n", pa.list_(pa.int64()))])
    model = rows.groupBy("shard").applyInArrow(lean(last), "shard int, data binary, more binary, tally array<long>, pairs array<long>, n array<long>")
    kept = scratch_path(spark, "model")
    model.write.option("compression", "none").parquet(kept)
    model = spark.read.schema(model.schema).parquet(kept)
    tallies = model.agg(*[F.sum(F.col("tally")[i]) for i in range(4 * (ORDER - 2))]).first()
    pairs = model.select(F.explode(F.arrays_zip("pairs", "n")).alias("x")).groupBy("x.pairs").agg(F.sum("x.n")).collect()
    kept = {k: [tallies[4 * (k - 3) + i] or 0 for i in range(4)] for k in range(3, ORDER + 1)}
    return model.select("shard", "data", "more"), Model(kept, {r[0]: r[1] for r in pairs})


def answer(requests: DataFrame, blocks: int, counts: DataFrame, model: Model) -> DataFrame:
    """Rows (block, shard, more): answers in the order of the requests, shard by shard, ``FAN`` blocks at a time."""
    salts = max(1, -(-blocks // FAN))
    shared = requests.sparkSession.sparkContext.broadcast(model)
    asked = requests.select("block", "shard", "data").withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(salts)).cast("int"))
    counts = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def reply(own, requests):
        g, n = merged(own) if own.num_rows else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        out = []
        for a in range(0, requests.num_rows, 16):
            parts = [loosen(d.as_py()) for d in requests.column("data")[a : a + 16]]
            got = np.rint(shared.value.bits(np.concatenate(parts), g, n) * (1 << _BITS)).astype(np.uint16)
            out += [small(x, "<u2") for x in np.split(got, np.cumsum([len(p) for p in parts])[:-1])]
        return requests.select(["block", "shard"]).append_column("more", pa.array(out, pa.binary()))

    return counts.groupBy("shard", "salt").cogroup(asked.groupBy("shard", "salt")).applyInArrow(lean(reply), "block long, shard int, more binary")


def score(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``docs`` (text, _llm_train and any other columns) with _llm_bits: mean -log2 probability a byte, null if none, and _llm_repeat."""
    spark = docs.sparkSession
    path = scratch_path(spark, "quality")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = 64
    while shards < min(1 << 14, total // block // 8):
        shards *= 2
    write_blocks(docs, path, block, asks(shards, block))
    blocks = kind(docs, path, 0).count()
    if not blocks:
        return docs.withColumn("_llm_bits", F.lit(None).cast("double")).withColumn("_llm_repeat", F.lit(None).cast("double"))
    if not kind(docs, path, 2).limit(1).count():
        return docs.withColumn("_llm_bits", F.when(F.octet_length("text") > 0, F.lit(0.0))).withColumn("_llm_repeat", F.lit(None).cast("double"))
    counts, model = train(spark, kind(docs, path, 2), blocks)
    replies = answer(kind(docs, path, 1), blocks, counts, model)
    packed = kind(docs, path, 0).select("block", "data")

    def judge(held, answers):
        table = documents(held.column("data")[0].as_py())  # a block is one row
        texts = encoded(table)
        got = dict(zip(answers.column("shard").to_pylist(), answers.column("more"), strict=True))
        runs = list(chunks([len(t) for t in texts], 1 << 20))
        keys = distinct([grams(texts[a:z])[0] for a, z in runs])
        bits = np.zeros(len(keys))
        for s, at in by_shard(keys, shards):
            bits[at] = unsmall(got[s].as_py(), "<u2") / (1 << _BITS)
        mean = np.full(len(texts), np.nan)
        for a, z in runs:
            g, sizes = grams(texts[a:z])
            some = np.flatnonzero(sizes)
            if len(some):
                starts = (np.cumsum(sizes) - sizes)[some]
                mean[a + some] = np.add.reduceat(bits[np.searchsorted(keys, g)], starts) / sizes[some]
        return table.append_column("_llm_bits", pa.array(mean, mask=np.isnan(mean))).append_column("_llm_repeat", pa.array([repetition(t) for t in texts], pa.float64()))

    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(lean(judge), form(docs) + ", _llm_bits double, _llm_repeat double")


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of labelled documents of good quality and not toxic, each once."""
    good = (F.min("quality") == 1) & (F.max("toxic") == 0) & (F.count("quality") == F.count(F.lit(1))) & (F.count("toxic") == F.count(F.lit(1)))
    ids = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(good.alias("_llm_good")).where("_llm_good").select(F.col("doc_id").alias("_llm_id"))
    return F.broadcast(ids) if ids.count() <= SENT else ids


def upper_quantile(x: str, q: float):
    """The upper 95 % confidence limit of a column's quantile, its error as of a normal law: few rows don't show their upper end."""
    law = NormalDist()
    width = law.inv_cdf(0.95) * sqrt(q * (1 - q)) / law.pdf(law.inv_cdf(q))
    return F.percentile_approx(x, q, 10_000) + F.stddev_pop(x) * width / F.sqrt(F.count(x))


def classify(docs: DataFrame, labels: DataFrame, carry: list[str], quantile: float = QUANTILE) -> DataFrame:
    """Columns ``carry`` of ``docs`` with perplexity (a byte), threshold (of the language) and keep."""
    spark = docs.sparkSession
    with tidy(spark):
        cols = [c for c in dict.fromkeys(["doc_id", "text", "lang", *carry]) if c not in ("perplexity", "threshold", "keep")]
        known = docs.select(*cols).join(trusted(labels), F.col("doc_id") == F.col("_llm_id"), "left")
        known = known.withColumn("_llm_trusted", F.col("_llm_id").isNotNull()).withColumn("_llm_fold", F.pmod(F.xxhash64("doc_id"), F.lit(5)))
        known = known.withColumn("_llm_train", F.col("_llm_trusted") & (F.col("_llm_fold") != 0)).drop("_llm_id", "_llm_fold")
        keep = [c for c in dict.fromkeys(["lang", *carry]) if c not in ("perplexity", "threshold", "keep")]
        scored = score(known).select(*keep, "_llm_trusted", "_llm_train", "_llm_bits", "_llm_repeat")
        scored = materialize(scored, "scored", keep=True)
        held = scored.where("_llm_trusted and not _llm_train and _llm_bits is not null")
        cut = lambda x: upper_quantile(x, quantile)
        limits = held.groupBy(F.col("lang").alias("_llm_lang")).agg(cut("_llm_bits").alias("_llm_cut"), cut("_llm_repeat").alias("_llm_most"))
        limits = materialize(limits, "limits", keep=True)
        every, again = held.agg(cut("_llm_bits"), cut("_llm_repeat")).first()
        if limits.count() <= 10_000:
            limits = F.broadcast(limits)
    out = scored.join(limits, F.col("lang").eqNullSafe(F.col("_llm_lang")), "left")
    limit = F.coalesce("_llm_cut", F.lit(float("inf") if every is None else every))
    out = out.withColumn("perplexity", F.pow(F.lit(2.0), F.col("_llm_bits"))).withColumn("threshold", F.pow(F.lit(2.0), limit))
    out = out.withColumn("keep", F.coalesce(F.col("_llm_bits") <= limit, F.lit(False)) & F.coalesce(F.col("_llm_repeat") <= F.greatest("_llm_most", F.lit(again).cast("double")), F.lit(True)))
    return out.select(*[c for c in carry if c in keep], "perplexity", "threshold", "keep")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id", "lang"])


@stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier keeps."""
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), cols).where("keep").select(*cols)
