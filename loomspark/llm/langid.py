"""Language identification by error-correcting output codes.

Each language has a codeword of bits. For each bit a binary n-gram classifier (the log odds of hashed letter bigrams
and trigrams between the languages with and without the bit) gives a margin; loss-weighted decoding takes the
codeword with the least weighted logistic loss, each bit weighted by how well its classifier separates that
language in training. Close runners-up are flagged as ambiguous.

Training counts n-grams over a bounded sample: about ``rows_per_language`` rows of each language, chosen by a hash
threshold on doc_id; every other statistic and every prediction takes whole texts. Predictions read the text only.

Nulls: a row with a null lang isn't trained on; a null doc_id is never held out nor trained on. A null text and one
without letters is ``und`` with score 0, as is everything if no language was learned. Repeated rows get the same
answer. An empty table gives none.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: N-gram buckets: 2**BITS.
BITS = 15
#: About so many training rows of each language.
ROWS = 3000
#: Characters scored at a time.
STEP = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of bigrams, of trigrams, text of each place) of lower-cased texts; other characters count as one blank.

    The arrays are parallel, with -1 where a place ends no n-gram of its text, and a place for each text's start.
    """
    raw = [t.lower().encode("utf-32-le", "surrogatepass") for t in texts]
    code = np.frombuffer(b"".join(b"\0\0\0\0" + r for r in raw), "<u4")
    sizes = np.array([len(r) // 4 + 1 for r in raw])
    starts = np.cumsum(sizes) - sizes
    letter = _letters()[code]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[starts] = True
    text = np.repeat(np.arange(len(texts)), sizes)[keep]
    code = np.where(letter, code, 0)[keep].astype(np.uint64)
    two, three = np.full(len(code), -1, np.int64), np.full(len(code), -1, np.int64)
    shift = np.uint64(64 - BITS)
    pair = (code[:-1] << np.uint64(21)) | code[1:]
    two[1:] = ((pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> shift
    three[2:] = (((code[:-2] << np.uint64(42)) | pair[1:]) * np.uint64(0xD1B54A32D192ED03)) >> shift
    two[1:][text[1:] != text[:-1]] = -1
    three[2:][text[2:] != text[:-2]] = -1
    two[0] = three[:2] = -1
    return two, three, text


def slices(texts: list[str | None]):
    """Runs of (row, part of its text) of about ``STEP`` characters; a part takes the two before it too, so no n-gram is lost (a pair counts twice there)."""
    out, total = [], 0
    for row, t in enumerate(texts):
        for at in range(0, len(t or ""), STEP):
            part = t[max(0, at - 2) : at + STEP]
            out.append((row, part))
            total += len(part)
            if total >= STEP:
                yield out
                out, total = [], 0
    if out:
        yield out


def codebook(k: int) -> np.ndarray:
    """Codewords of +1 and -1, a row a language: all splits up to six languages, else far-apart random ones."""
    if k <= 6:
        width = max(1, 2 ** (k - 1) - 1)
        rows = [[1] * width] + [[1 if (j >> (i - 1)) & 1 else -1 for j in range(width)] for i in range(1, k)]
        return np.array(rows[:k]).reshape(k, -1)
    rng, best, far = np.random.default_rng(11), None, -1
    width = int(np.ceil(10 * np.log2(k)))
    for _ in range(50):
        code = np.where(rng.random((k, width)) < 0.5, -1, 1)
        code = code[:, np.abs(code.sum(0)) < k]
        apart = (code[:, None, :] != code[None, :, :]).sum(2) + np.eye(k, dtype=int) * width
        if apart.min() > far:
            best, far = code, apart.min()
    return best


class Model:
    """Codewords, a weight for each bucket and bit, and the decoding weights."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        self.langs, self.code = langs, codebook(len(langs))
        p = (counts + 0.2) / (counts + 0.2).sum(1, keepdims=True)
        w = np.zeros((1 << BITS, self.code.shape[1]))
        for b in range(w.shape[1]):
            on, off = self.code[:, b] > 0, self.code[:, b] < 0
            if on.any() and off.any():
                w[:, b] = np.log(p[on].mean(0)) - np.log(p[off].mean(0))
        usual = p @ w  # the mean margin of each language
        scale = np.abs(usual).mean(0)
        self.weights = (w / np.where(scale > 0, scale, 1)).astype(np.float32)
        apart = np.maximum(self.code * usual / np.where(scale > 0, scale, 1), 0.05)
        self.trust = apart / apart.sum(1, keepdims=True)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, whether ambiguous) of rows of margins."""
        loss = np.logaddexp(0, -3 * margins[:, None, :] * self.code[None]) * self.trust[None]
        far = loss.sum(2) * self.code.shape[1]
        near = np.exp(far.min(1, keepdims=True) - far)
        p = np.sort(near / near.sum(1, keepdims=True), 1)
        return far.argmin(1), p[:, -1], (p[:, -1] - p[:, -2] < 0.2) if p.shape[1] > 1 else np.zeros(len(p), bool)


def fit(train: DataFrame, rows_per_language: int = ROWS) -> Model | None:
    """Learn from rows (doc_id, text, lang) without nulls in lang."""
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    rate = F.create_map(*[x for c in langs for x in (F.lit(c), F.lit(min(1.0, rows_per_language / sizes[c])))])
    sample = train.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.element_at(rate, F.col("lang")) * float(1 << 40))

    def count(batches):
        total = np.zeros((len(langs), 1 << BITS), np.int64)
        place = {c: i for i, c in enumerate(langs)}
        for b in batches:
            lang = b.column("lang").to_pylist()
            for run in slices(b.column("text").to_pylist()):
                two, three, text = ngrams([t for _, t in run])
                of = np.array([place[lang[row]] for row, _ in run])[text]
                for g in (two, three):
                    total += np.bincount((of << BITS)[g >= 0] + g[g >= 0], minlength=total.size).reshape(total.shape)
        which, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[which, bucket])], names=["l", "g", "n"])

    counts = np.zeros((len(langs), 1 << BITS))
    for r in sample.select("text", "lang").mapInArrow(count, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n")).collect():
        counts[r[0], r[1]] = r[2]
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The input's columns with lang_pred, score and ambiguous, from the text alone."""
    docs = docs.drop("lang_pred", "score", "ambiguous")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches):
        model = shared.value
        for b in batches:
            n = b.num_rows
            lang, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if model and n:
                sums, seen = np.zeros((n, model.weights.shape[1])), np.zeros(n)
                lettered = np.zeros(n, bool)
                for run in slices(b.column("text").to_pylist()):
                    two, three, text = ngrams([t for _, t in run])
                    rows = np.array([row for row, _ in run])
                    starts = np.searchsorted(text, np.arange(len(run)))
                    for g in (two, three):
                        w = model.weights[g]
                        w[g < 0] = 0
                        np.add.at(sums, rows, np.add.reduceat(w, starts, axis=0))
                        np.add.at(seen, rows, np.add.reduceat((g >= 0).astype(np.int64), starts))
                    np.logical_or.at(lettered, rows, np.diff(np.append(starts, len(text))) > 1)
                on = np.flatnonzero(lettered)
                if len(on):
                    which, score[on], unsure[on] = model.decode(sums[on] / np.maximum(seen[on], 1)[:, None])
                    lang[on] = np.array(model.langs, object)[which]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(unsure)], names=[*b.schema.names, "lang_pred", "score", "ambiguous"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(label, schema + ", lang_pred string, score double, ambiguous boolean")


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where((fold != 0) & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model).drop("text")
