from __future__ import annotations

import tracemalloc

import numpy as np

from loomspark.llm import jaccard


def postings(n: int, run: int):
    """Rising runs of classes, each of its own component, whose counts differ in a few places."""
    rng = np.random.default_rng(3)
    counts = np.tile(rng.poisson(0.6, jaccard.COUNTS).astype(np.uint8), (n, 1))
    for _ in range(12):
        counts[np.arange(n), rng.integers(0, jaccard.COUNTS, n)] += 1
    size = counts.sum(1).astype(np.int64)
    first = np.arange(0, n, run)
    cls = rng.permutation(n) * 3 - n
    return first, np.append(first[1:], n), size, cls, counts


def nearest(rows, done, named, percent=80):
    first, end, size, cls, counts = rows
    none = np.zeros(len(cls), np.int64)
    return jaccard._nearest(jaccard._near(first, end, size, cls, none, none, counts, percent), cls, *done, named)


def test_nearest_equals_all_pairs(monkeypatch):
    """However few pairs are held, each posting's nearest ones are those of a sort of all pairs."""
    rows = first, end, size, cls, counts = postings(90, 45)
    done = np.full(90, -1), np.zeros(90, np.int64)
    done[0][10:20], done[1][10:20] = 30_000, 0
    want = []
    for s, e in zip(first, end):
        for i in range(s, e):
            to = []
            for j in range(s, e):
                far = int(np.abs(counts[i].astype(int) - counts[j]).sum())
                score = (far << 20) // int(size[i] + size[j])
                if i != j and far * 180 <= 20 * (size[i] + size[j]) and min(size[i], size[j]) * 100 >= max(size[i], size[j]) * 80 and all((score, cls[y]) > (done[0][x], done[1][x]) for x, y in ((i, j), (j, i))):
                    to.append((score, int(cls[j]), j))
            want += [(i, j, score, rank) for rank, (score, _, j) in enumerate(sorted(to)[:4])]
    assert len({i for i, *_ in want}) > 45
    for pairs, held in ((1 << 14, 1 << 19), (7, 5), (1, 1), (100, 0)):
        monkeypatch.setattr(jaccard, "PAIRS", pairs)
        monkeypatch.setattr(jaccard, "HELD", held)
        assert list(zip(*(x.tolist() for x in nearest(rows, done, 4)))) == want


def test_a_hot_signature_is_compared_in_bounded_memory():
    """Two thousand near copies under one signature: two million pairs, whose counts alone are a gigabyte on each side."""
    rows = postings(2000, 2000)
    done = np.full(2000, -1), np.zeros(2000, np.int64)
    tracemalloc.start()
    try:
        got = nearest(rows, done, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got[0]) == 6000
    assert most < 100 << 20


def test_a_task_holds_few_pairs():
    """The same pairs fit a third of that."""
    rows = postings(2000, 2000)
    done = np.full(2000, -1), np.zeros(2000, np.int64)
    tracemalloc.start()
    try:
        got = nearest(rows, done, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got[0]) == 6000
    assert most < 33 << 20, most >> 20


def test_workers_give_free_memory_back(spark):
    """What a partition or a group took is not kept by the worker when it ends."""
    import pyarrow as pa

    from loomspark.llm import common

    def resident() -> int:
        with open("/proc/self/smaps_rollup") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("Anonymous:"))

    def take():
        many = [bytes(1000) for _ in range(200_000)]
        return many[::50_000]  # what lives on lies above what goes

    kept = []

    def work(batches):
        for b in batches:
            kept.append(take())
            yield b

    def group(table):
        kept.append(take())
        return table

    def pair(left, right):
        kept.append(take())
        return left

    common.release()
    before = resident()
    table = pa.table({"a": [1]})
    list(common.lean(work)(iter(table.to_batches())))
    assert common.lean(group)(table) is table and common.lean(pair)(table, table) is table
    assert resident() - before < 60_000
    got = spark.range(10).mapInArrow(common.lean(lambda batches: (b for b in batches)), "id long")
    assert got.count() == 10
    assert got.groupBy("id").applyInArrow(common.lean(group), "id long").count() == 10
