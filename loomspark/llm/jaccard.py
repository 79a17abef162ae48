"""N-gram Jaccard join by universe partition and pigeonhole, with exact verification.

Sets of distinct word shingles; two link if 100 |A and B| >= percent |A or B|. Sizes fall into bands, and two linked
sets lie in the same band or neighbouring ones. For a band, linked sets differ in at most D shingles. The shingles are
hashed into D + 1 segments, so some segment of a linked pair has no difference; ``spare`` of them also index their
one-deletion neighbourhoods (a segment without one of its shingles) and so tolerate one difference, which adds
``spare`` to the budget. Each set spends that budget on its costliest segments, the empty ones, whose signature
unrelated sets share: it leaves them out. The allocation (how many are spare) minimises expected signatures and chance
meetings for the band. A set with more empty segments than its budget leaves none out. So for a linked pair, with the
side that has left segments out as the asking one, there is a segment that it kept and whose difference is within
that segment's tolerance, and the other side has posted the matching signature.

Signatures travel packed by bucket. Sets that are equal are one class from the start, and a task posts a class once.
In a bucket, the classes of a signature are linked to the smallest one as candidates, a star and not all pairs;
candidates are verified on whole sets. What the verified links do not connect is taken in rounds: of each signature,
every class names its nearest few classes of other components that sizes and counts by part of the universe don't rule
out, those are verified, components are contracted, and classes that have more to name go to the next round, which
takes twice as many each. A class remembers how far down its list it has come, so the rounds end when every pair of a
signature is linked, in one component, or ruled out. What moves is in proportion to the postings, not to their pairs,
and a group of a thousand near copies costs a few thousand comparisons of sets. A signature of more than ``CELL``
classes is compared in cells of that size, by several tasks.

Nulls: a null or blank text has an empty set, no links and is its own component; a null doc_id takes part, and its
component is the smallest non-null id reachable, null if there is none. Repeated rows are equal sets. An empty table
gives none. Other columns of the input are ignored.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.blocks import small, split, unsmall
from loomspark.llm.common import chunks, components, delete, doc_key, lean, materialize, mix64, scratch_path, shingle_hashes, stage, tidy, word_hashes

#: Signatures that a bucket is made for.
BUCKET = 1 << 19
#: Bytes of text whose signatures are packed together.
PACK = 24 << 20
#: Parts of the universe whose counts bound a pair's difference before whole sets are compared.
COUNTS = 512
#: Postings compared across components in one task, while each names few others.
ACROSS = 8_000
#: Classes of a signature compared with each other in one task.
CELL = 2048
#: Other classes that a posting names in the first round.
NAMED = 2
#: Pairs of postings whose counts a task compares at a time, and compared pairs that it holds.
PAIRS = 1 << 13
HELD = 1 << 17
#: Ids of candidate documents sent to every executor (8 bytes each), beyond which they are joined by shuffle.
SENT = 2_000_000


def shingle_set(text: bytes, n: int) -> np.ndarray:
    """Rising hashes of the distinct ``n``-word shingles of a text with A-Z in lower case."""
    return np.unique(shingle_hashes(word_hashes(text.lower()), n))  # bytes.lower() changes A-Z only


def class_of(s: np.ndarray) -> int:
    """A 63-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(mix64(mix64(s ^ np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(s)))) & ((1 << 63) - 1) if len(s) else -1


def counts_of(s: np.ndarray) -> bytes:
    """How many of a set's shingles fall into each of ``COUNTS`` parts (255 for more)."""
    return np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % COUNTS, minlength=COUNTS), 255).astype(np.uint8).tobytes()


class Bands:
    """Size bands and, for each, how many segments there are and how many of them are spare."""

    def __init__(self, percent: int) -> None:
        self.percent = percent

    @cache  # noqa: B019  one object a worker
    def first(self, band: int) -> int:
        """Smallest size in a band: each spans the sizes that its first one can link with, twice over."""
        if band == 0:
            return 1
        once = self.first(band - 1) * 100 // self.percent
        return max(once * 100 // self.percent, self.first(band - 1)) + 1

    def of(self, size: int) -> int:
        band = 0
        while self.first(band + 1) <= size:
            band += 1
        return band

    def keys(self, size: int) -> list[int]:
        """Bands that a set is posted in: its own, and the lower one if it can link with sets there."""
        band = self.of(size)
        least = -(-self.percent * size // 100)
        return [band, band - 1] if band and least < self.first(band) else [band]

    @cache  # noqa: B019
    def shape(self, band: int) -> tuple[int, int]:
        """(segments, spare ones) of pairs whose smaller set is in the band."""
        small_ = self.first(band + 1) - 1
        large = small_ * 100 // self.percent
        most = (100 - self.percent) * (small_ + large) // (100 + self.percent)
        if not most:
            return 1, 0
        size = (self.first(band) + small_) / 2

        def cost(spare: int) -> float:
            weight = size / (most + 1 + spare)  # shingles of a plain segment; spare ones get twice as many
            empty = (most + 1 - spare) * np.exp(-weight)
            over = 1.0 - sum(np.exp(-empty) * empty**i / np.prod(np.arange(1, i + 1, dtype=float)) for i in range(spare + 1))
            return most + 1 + spare * 2 * weight + 1000 * max(0.0, over)

        return most + 1, min(range(min(most, 24) + 1), key=cost)


def signatures(s: np.ndarray, band: int, shape: tuple[int, int]) -> np.ndarray:
    """What a set posts in a band."""
    segments, spare = shape
    seed = np.uint64((band * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    mixed = mix64(s ^ seed)
    if segments == 1:
        of = np.zeros(len(s), np.int64)
    else:
        of = ((mixed >> np.uint64(40)).astype(np.int64) * (segments + spare)) >> 24  # the last ``spare`` places double the spare segments
        of[of >= segments] -= segments
    low = np.bincount(of, (mixed & np.uint64(0xFFFFFFFF)).astype(np.float64), segments).astype(np.uint64)
    value = mix64(s + seed)
    high = np.bincount(of, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), segments).astype(np.uint64)
    count = np.bincount(of, minlength=segments)
    place = mix64(np.arange(segments, dtype=np.uint64) + seed)

    def sign(at, lo, hi, n):
        return mix64(mix64(lo + place[at]) ^ (hi + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))

    empty = np.flatnonzero(count[spare:] == 0) + spare
    kept = np.arange(segments)
    if len(empty) <= spare:
        kept = np.delete(kept, empty)
    out = [sign(kept, low[kept], high[kept], count[kept])]
    if spare:
        t = np.flatnonzero(of < spare)
        at = of[t]
        out.append(sign(at, low[at] - (mixed[t] & np.uint64(0xFFFFFFFF)), high[at] - (value[t] & np.uint64(0xFFFFFFFF)), count[at] - 1))
    return np.concatenate(out)


def post(docs: DataFrame, path: str, n: int, percent: int, buckets: int) -> None:
    """Write kind 0: (doc_id, key, size, class, counts) of all rows; kind 1: packed signatures and classes by bucket."""
    bands = Bands(percent)

    def work(batches):
        sent: set[int] = set()
        number = TaskContext.get().partitionId()
        for b in batches:
            texts = b.column("text")
            ids, keys = b.column("doc_id"), b.column("key")
            lengths = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist()
            for a, z in chunks(lengths, PACK):
                size, of, counts, sigs, owner = np.zeros(z - a, np.int64), np.full(z - a, -1, np.int64), [], [], []
                for i, t in enumerate(texts[a:z].to_pylist()):
                    s = shingle_set(t.encode("utf-8", "surrogatepass"), n) if t else np.zeros(0, np.uint64)
                    size[i], of[i] = len(s), class_of(s)
                    counts.append(counts_of(s))
                    if len(s) and of[i] not in sent:
                        if len(sent) < 1 << 20:
                            sent.add(of[i])
                        for band in bands.keys(len(s)):
                            if bands.shape(band)[0] > 1:  # else only equal sets link
                                got = signatures(s, band, bands.shape(band))
                                sigs.append(got)
                                owner.append((len(got), i))
                yield pa.RecordBatch.from_arrays([pa.array([0] * (z - a), pa.int32()), ids[a:z], keys[a:z], pa.array(size), pa.array(of), pa.array(counts, pa.binary()), pa.nulls(z - a, pa.int32()), *[pa.nulls(z - a, pa.binary())] * 3], names=names)
                if not sigs:
                    continue
                sig, who = np.concatenate(sigs), np.repeat([i for _, i in owner], [k for k, _ in owner])
                for bucket, at in split((sig % np.uint64(buckets)).astype(np.int64)):
                    local, place = np.unique(who[at], return_inverse=True)
                    row = [1, None, None, len(at), number, None, bucket, sig[at].astype("<u8").tobytes(), small(np.diff(place, prepend=0), "<u2") if len(local) < 1 << 16 else small(np.diff(place, prepend=0), "<u4"), of[local].astype("<i8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

    names = ["kind", "doc_id", "key", "size", "class", "counts", "bucket", "sigs", "places", "classes"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    rows = docs.mapInArrow(lean(work), "kind int, doc_id long, key long, size long, class long, counts binary, bucket int, sigs binary, places binary, classes binary")
    rows.write.partitionBy("kind").option("compression", "none").parquet(path)


def _posted(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Signatures and classes of a bucket, by signature, each pair once and only where a signature has several classes."""
    sigs, classes = [], []
    for s, p, c in zip(table.column("sigs"), table.column("places"), table.column("classes"), strict=True):
        sig, cls = np.frombuffer(s.as_py(), "<u8"), np.frombuffer(c.as_py(), "<i8")
        place = np.cumsum(unsmall(p.as_py(), "<u2" if len(cls) < 1 << 16 else "<u4").astype(np.int64))
        sigs.append(sig)
        classes.append(cls[place])
    sig, cls = np.concatenate(sigs), np.concatenate(classes)
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    once = np.concatenate([[True], (sig[1:] != sig[:-1]) | (cls[1:] != cls[:-1])])
    sig, cls = sig[once], cls[once]
    first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
    many = np.repeat(np.diff(np.append(first, len(sig))) > 1, np.diff(np.append(first, len(sig))))
    return sig[many], cls[many]


def groups(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Rows (bucket, sigs, classes): of each bucket the signatures that several classes share. Written once."""

    def find(table):
        sig, cls = _posted(table)
        if not len(sig):
            return empty
        return pa.table({"bucket": table.column("bucket")[:1], "sigs": [sig.tobytes()], "classes": [cls.tobytes()]}, schema=schema)

    schema = pa.schema([("bucket", pa.int32()), ("sigs", pa.binary()), ("classes", pa.binary())])
    empty = schema.empty_table()
    form = "bucket int, sigs binary, places binary, classes binary, kind int"
    posted = spark.read.schema(form).parquet(path).where("kind = 1").select("bucket", "sigs", "places", "classes")
    found = posted.groupBy("bucket").applyInArrow(lean(find), "bucket int, sigs binary, classes binary")
    found.write.option("compression", "zstd").parquet(out)
    return spark.read.schema(found.schema).parquet(out)


def stars(found: DataFrame) -> DataFrame:
    """Candidate pairs (a, b), a < b: each signature's classes with its smallest."""

    def pairs(batches):
        for batch in batches:
            for s, c in zip(batch.column("sigs"), batch.column("classes"), strict=True):
                sig, cls = np.frombuffer(s.as_py(), "<u8"), np.frombuffer(c.as_py(), "<i8")
                first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
                hub = np.repeat(cls[first], np.diff(np.append(first, len(sig))))
                got = np.unique(np.stack([hub, cls], 1)[hub != cls], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

    return found.mapInArrow(lean(pairs), "a long, b long").distinct()


def postings(found: DataFrame) -> DataFrame:
    """Rows (sig, class)."""

    def rows(batches):
        for batch in batches:
            for s, c in zip(batch.column("sigs"), batch.column("classes"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(s.as_py(), "<i8")), pa.array(np.frombuffer(c.as_py(), "<i8"))], names=["sig", "class"])

    return found.mapInArrow(lean(rows), "sig long, class long")


def dealt(found: DataFrame, comp: DataFrame) -> DataFrame:
    """Rows (sig, cell, part, class, at, to): postings of signatures that several components share, in cells.

    The classes of a large signature fall into parts, and each two parts make a cell; (at, to) see ``candidates``.
    """
    live = postings(found).join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    shared = live.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("parts"))
    live = live.join(shared.where("lo < hi").select("sig", "parts"), "sig").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")).cast("long"))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    cell = F.shiftleft(F.least("part", "other"), 32) + F.greatest("part", "other")
    return live.select("sig", cell.alias("cell"), "part", "class", F.lit(-1).cast("long").alias("at"), F.lit(0).cast("long").alias("to"))


def _pairs(first: np.ndarray, end: np.ndarray):
    """(i, j) of the pairs i < j within runs of rows, at most ``PAIRS`` at a time unless a single i has more."""
    many = end - first
    row = np.arange(many.sum()) + np.repeat(first - np.cumsum(many) + many, many)
    rest = np.repeat(end, many) - 1 - row
    upto = np.concatenate([[0], np.cumsum(rest)])
    a = 0
    while a < len(row):
        z = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        i = np.repeat(row[a:z], rest[a:z])
        if len(i):
            yield i, i + 1 + np.arange(len(i)) - np.repeat(upto[a:z] - upto[a], rest[a:z])
        a = z


def _near(first, end, size, of, cell, part, counts, percent):
    """(i, j, score) of the pairs of a cell that may link: other component, sizes and counts allow it. Some at a time.

    Counts of 16 parts together are looked at first. Where a cell holds two parts, pairs within one are another cell's.
    """
    coarse = counts.reshape(len(counts), -1, 16).sum(2, dtype=np.uint16)
    two = (cell >> 32) != (cell & 0xFFFFFFFF)
    for i, j in _pairs(first, end):
        ok = (of[i] != of[j]) & (np.minimum(size[i], size[j]) * 100 >= np.maximum(size[i], size[j]) * percent) & (~two[i] | (part[i] != part[j]))
        i, j = i[ok], j[ok]
        far = np.zeros(len(i), np.int64)
        for c in (coarse, counts):
            x, y = c[i], c[j]
            more = np.maximum(x, y)
            more -= np.minimum(x, y, out=x)
            far = more.sum(1, dtype=np.int64)
            ok = far * (100 + percent) <= (100 - percent) * (size[i] + size[j])
            i, j, far = i[ok], j[ok], far[ok]
        yield i, j, (far << 20) // (size[i] + size[j])


def _nearest(near, cls, at, to, most: int):
    """(i, j, score, rank) of the first ``most`` pairs of each i that are not done, by score and class, of pairs both ways.

    While the pairs come, what can't be among the first is dropped: no more than those and ``HELD`` are held, or twice those.
    """

    def best(held):
        i, j, score = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((cls[j], score, i))
        i, j, score = i[order], j[order], score[order]
        begin = np.flatnonzero(np.diff(i, prepend=-1))
        rank = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
        first = rank < most
        return i[first], j[first], score[first], rank[first]

    held, many, full = [(np.zeros(0, np.int64),) * 3], 0, HELD
    for i, j, score in near:
        i, j, score = np.concatenate([i, j]), np.concatenate([j, i]), np.tile(score, 2)
        new = ((score > at[i]) | (score == at[i]) & (cls[j] > to[i])) & ((score > at[j]) | (score == at[j]) & (cls[i] > to[j]))
        held.append((i[new], j[new], score[new]))
        many += len(held[-1][0])
        if many > full:
            held = [best(held)[:3]]
            many = len(held[0][0])
            full = max(HELD, 2 * many)
    return best(held)


def candidates(live: DataFrame, comp: DataFrame, known: DataFrame, percent: int, named: int) -> tuple[DataFrame, DataFrame]:
    """Of live postings (see ``dealt``): (candidate pairs (a, b), the postings that have more to name).

    Each names up to ``named`` classes of its cell, by score and class. (at, to) are those of the one named last; what
    stands up to there in the list of either of a pair is done.
    """
    live = live.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    mixed = live.groupBy("sig", "cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("sig", "cell")
    live = live.join(mixed, ["sig", "cell"]).join(known.select("class", "size", "counts"), "class")
    live = materialize(live.select("sig", "cell", "part", "class", "comp", "size", "counts", "at", "to"), "across")
    buckets = max(8, live.count() * max(1, named // 16) // ACROSS)

    def name(table):
        table = table.sort_by([("sig", "ascending"), ("cell", "ascending"), ("class", "ascending")])
        sig, cell, part, cls, of, size, at, to = (table.column(x).to_numpy() for x in ("sig", "cell", "part", "class", "comp", "size", "at", "to"))
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).reshape(-1, COUNTS)
        first = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])]))
        near = _near(first, np.append(first[1:], len(sig)), size, of, cell, part, counts, percent)
        i, j, score, rank = _nearest(near, cls, at, to, named + 1)
        now = rank < named
        got = np.unique(np.stack([np.minimum(cls[i[now]], cls[j[now]]), np.maximum(cls[i[now]], cls[j[now]])], 1), axis=0)
        last = (rank == named - 1) & np.isin(i, i[rank == named])
        left = np.stack([sig[i], cell[i], part[i], cls[i], score, cls[j]], 1)[last]
        full = np.concatenate([np.pad(got, ((0, 0), (0, 4))), left])
        kinds = np.repeat([0, 1], [len(got), len(left)]).astype(np.int32)
        return pa.Table.from_arrays([pa.array(kinds), *[pa.array(np.ascontiguousarray(full[:, k])) for k in range(6)]], names=["kind", *(f"x{k}" for k in range(6))])

    live = live.withColumn("bucket", F.pmod(F.xxhash64("sig", "cell"), F.lit(buckets)))
    out = materialize(live.groupBy("bucket").applyInArrow(lean(name), "kind int, x0 long, x1 long, x2 long, x3 long, x4 long, x5 long"), "named")
    pairs = out.where("kind = 0").select(F.col("x0").alias("a"), F.col("x1").alias("b")).distinct()
    return pairs, out.where("kind = 1").select(*[F.col(f"x{k}").alias(x) for k, x in enumerate(("sig", "cell", "part", "class", "at", "to"))])


def close(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs that sizes and counts by part of the universe allow: the counts' difference is at most the sets'."""
    side = lambda x: known.select(F.col("class").alias(x), F.col("size").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def check(batches):
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(x).to_pylist()), np.uint8).reshape(-1, COUNTS).astype(np.int16) for x in ("ca", "cb"))
            size = b.column("na").to_numpy() + b.column("nb").to_numpy()
            ok = pa.array(np.abs(one - two).sum(1, dtype=np.int64) * (100 + percent) <= (100 - percent) * size)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok)], names=["a", "b"])

    return materialize(near.select("a", "b", "na", "nb", "ca", "cb").mapInArrow(lean(check), "a long, b long"), "pairs")


def sets_of(docs: DataFrame, known: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Rows (class, set) of the ``asked`` classes, from one reading of the texts."""
    wanted = known.join(asked.distinct(), "class").select(F.col("doc_id").alias("_llm_id"), F.col("class").alias("_llm_class"))
    wanted = materialize(wanted, "wanted")
    hint = F.broadcast if wanted.count() <= SENT else (lambda x: x)

    def sets(batches):
        for b in batches:
            out = []
            for c, t in zip(b.column("_llm_class").to_pylist(), b.column("text").to_pylist(), strict=True):
                s = shingle_set(t.encode("utf-8", "surrogatepass"), n) if t else np.zeros(0, np.uint64)
                if class_of(s) == c:  # a repeated doc_id may have other texts too
                    out.append((c, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out], pa.binary())], names=["class", "set"])

    held = docs.select("doc_id", "text").join(hint(wanted), F.col("doc_id").eqNullSafe(F.col("_llm_id"))).select("_llm_class", "text").mapInArrow(lean(sets), "class long, set binary")
    return materialize(held.dropDuplicates(["class"]), "sets")


def linked(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets link, on whole sets."""
    both = pairs.join(held.select(F.col("class").alias("b"), F.col("set").alias("sb")), "b").join(held.select(F.col("class").alias("a"), F.col("set").alias("sa")), "a")

    def check(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                one, two = np.frombuffer(x.as_py(), "<u8"), np.frombuffer(y.as_py(), "<u8")
                common = len(np.intersect1d(one, two, assume_unique=True))
                ok.append(100 * common >= percent * (len(one) + len(two) - common))
            ok = np.array(ok, bool)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], names=["a", "b"])

    return materialize(both.select("a", "b", "sa", "sb").mapInArrow(lean(check), "a long, b long"), "links")


def sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class")))


def connected(docs: DataFrame, found: DataFrame, known: DataFrame, n: int, percent: int) -> DataFrame:
    """Rows (node, comp): the components of the classes that link with others."""
    pairs = close(stars(found), known, percent)
    links = linked(pairs, sets_of(docs, known, sides(pairs), n), percent)
    comp = materialize(components(links, "a", "b"), "components")
    live, held, done, named = dealt(found, comp), None, pairs, NAMED
    while True:
        pairs, live = candidates(live, comp, known, percent, named)
        pairs = materialize(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            if held is None:  # later rounds name none but these
                held = sets_of(docs, known, sides(pairs).union(live.select("class")), n)
            done = done.union(pairs)
            comp = merged(comp, linked(pairs, held, percent))
        if not live.limit(1).count():
            return comp
        named *= 2


def merged(comp: DataFrame, links: DataFrame) -> DataFrame:
    """``comp`` after further links between classes; only links between its components are looked at, as links of those."""
    side = lambda x: comp.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    over = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    over = over.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    over = materialize(over, "over")
    if not over.limit(1).count():
        return comp
    more = materialize(components(over, "a", "b"), "components")
    now = comp.join(more.select(F.col("node").alias("old"), F.col("comp").alias("new")), F.col("comp") == F.col("old"), "left")
    return materialize(now.select("node", F.coalesce("new", "comp").alias("comp")).union(more).distinct(), "components")


def join(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Rows (doc_id, key, n_shingles, class, component, component_id) of all ``docs`` (doc_id, text).

    key: ``doc_key`` of the text; class: digest of the set (-1 if empty); component: smallest class reachable; component_id: smallest doc_id.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    with tidy(spark):
        path = scratch_path(spark, "shingles")
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        post(docs.withColumn("key", doc_key()), path, n, percent, max(8, total // 16 // BUCKET))
        form = "doc_id long, key long, size long, class long, counts binary, kind int"
        rows = spark.read.schema(form).parquet(path).where("kind = 0").drop("kind")
        known = rows.where("class >= 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("counts").alias("counts"))
        known = materialize(known, "classes")
        comp = spark.createDataFrame([], "node long, comp long")
        if spark.read.schema("bucket int, kind int").parquet(path).where("kind = 1").limit(1).count():
            found = groups(spark, path, scratch_path(spark, "groups"))
            delete(spark, [f"{path}/kind=1"])
            comp = connected(docs, found, known, n, percent)
        classes = known.join(comp.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("comp", "class")).select("class", "doc_id", "component")
        least = classes.groupBy("component").agg(F.min("doc_id").alias("component_id"))
        by_class = classes.join(least, "component").select("class", "component", "component_id")
        out = rows.join(by_class, "class", "left")
        out = out.select("doc_id", "key", F.col("size").alias("n_shingles"), "class", "component", F.when(F.col("class") < 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        return materialize(out, "joined", keep=True)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


@stage
def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies (five words, 0.8) one row stays.

    It is the row of the smallest doc_id, null last, and among rows that repeat this doc_id that of the smallest digest
    of the text; of rows equal in both any one. Other texts under the doc_id of a copy stay. Rows without a set all stay.
    """
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    hint = lambda df: F.broadcast(df) if df.count() <= SENT else df
    rows = join(docs, 5, 80).where("class >= 0").groupBy("component", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    rows = materialize(rows.withColumn("rank", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")), "copies")
    first = rows.groupBy("component").agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1")
    first = materialize(first.select(F.col("component").alias("_llm_component"), "first"), "first")
    marked = rows.join(hint(first), F.col("component") == F.col("_llm_component"), "left")
    marked = marked.withColumn("copy", F.col("first").isNotNull() & (F.col("rank") != F.col("first"))).where("copy or n > 1")
    marked = materialize(marked.select(F.col("doc_id").alias("_llm_id"), F.col("key").alias("_llm_text"), "copy"), "marked")
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_key") == F.col("_llm_text"))
    kept = docs.select(*cols).withColumn("_llm_key", doc_key())
    every = kept.join(hint(marked.drop("copy")), same, "left_anti")
    twice = marked.where("not copy").drop("copy")
    if twice.limit(1).count():
        every = every.union(kept.join(hint(twice), same, "left_semi").dropDuplicates(["doc_id", "_llm_key"]))
    return every.select(*cols)


ORACLE = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(words) >= 4 THEN list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')))
                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END AS shingles
  FROM w
), flat AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
    AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 85
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT s.doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, c.component_id
FROM s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON s.doc_id = c.a
"""
