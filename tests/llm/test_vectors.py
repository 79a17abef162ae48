from __future__ import annotations

import numpy as np
import pytest

from loomspark.llm.ann import neighbours
from loomspark.llm.topk import topk


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 24))
    v = centres[rng.integers(0, 6, 900)] + 0.6 * rng.normal(size=(900, 24))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)]
    rows[50] = (50, rows[0][1])
    for i in range(300, 340):  # ties: equal vectors
        rows[i] = (i, rows[300][1])
    rows += [(None, rows[1][1]), (2001, None), (2002, [float("nan")] * 24), (2003, [1.0] * 23 + [None]), (2004, [float("inf")] + [0.0] * 23), (2005, [0.0] * 24), (2006, [1.0, 2.0]), (2050, [])]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, score int, rank string"), {r[0]: r[1] for r in rows if r[0] is not None}


def usable(vectors, size=24):
    return {i: np.array(v) for i, v in vectors.items() if v is not None and len(v) == size and None not in v and np.isfinite(v).all()}


def test_topk_is_exact(spark, table):
    df, vectors = table
    got = topk(df, df.where("vec_id % 50 = 0"), block=7).collect()
    e = {i: np.floor(256 * v) for i, v in usable(vectors).items()}
    want = set()
    for q in [i for i in e if i % 50 == 0]:
        best = sorted(((-int(e[q] @ v), i) for i, v in e.items() if i != q))[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(best)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id != 2050} == want
    assert len([r for r in got if r.query_id != 2050]) == len(want)


def test_topk_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert topk(make([]), make([])).collect() == []
    few = make([(0, [1.0]), (1, [2.0]), (2, [-3.0])])
    assert [(r.vec_id, r.score) for r in topk(few, few.where("vec_id = 0")).orderBy("rank").collect()] == [(1, 131072), (2, -196608)]
    same = make([(i, [0.5]) for i in range(100)])
    assert [r.vec_id for r in topk(same, same.where("vec_id = 1")).orderBy("rank").collect()] == [0, 2, 3, 4, 5]
    big = make([(i, [3e6 + i, -2e6]) for i in range(9)])
    assert [r.vec_id for r in topk(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [8, 7, 6, 5, 4]


def test_scores_beyond_a_long_are_refused(spark):
    wide = spark.createDataFrame([(0, [1e8, 1.0]), (1, [1e8, 0.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    with pytest.raises(OverflowError):
        topk(wide, wide.where("vec_id = 0"))
    got = topk(wide, wide.where("vec_id = 0"), scale=1).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 10**16), (2, 0)]


def test_recall_of_the_settings_in_use(spark):
    """Vectors without any structure, the hardest case; under a tenth of the rows are reranked."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(16_000, 64)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = np.arange(0, len(v), 400)
    found = {}
    for r in neighbours(df, df.where("vec_id % 400 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    score = v[queries].astype(float) @ v.T.astype(float)
    score[np.arange(len(queries)), queries] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    assert np.mean([len(found[q] & set(w)) / 20 for q, w in zip(queries, want.tolist(), strict=True)]) >= 0.9


def test_neighbours_recall(spark, table):
    df, vectors = table
    got = neighbours(df, df.where("vec_id % 20 = 0"), pivots=64, prefix=24, candidates=200).collect()
    v = {i: x for i, x in usable(vectors).items() if x.any()}
    found = {}
    for r in got:
        assert abs(r.score - float(v[r.query_id] @ v[r.vec_id])) < 1e-9 and r.query_id != r.vec_id
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    queries = [q for q in v if q % 20 == 0]
    assert sorted(found) == sorted(queries)
    hits = 0
    for q in queries:
        want = sorted(((-float(v[q] @ x), i) for i, x in v.items() if i != q))[:20]
        hits += len({i for _, i in want} & {i for _, i, _ in found[q]})
        listed = sorted(found[q])
        assert [x[0] for x in listed] == list(range(1, 21))
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(listed, listed[1:], strict=False))
    assert hits / (20 * len(queries)) >= 0.9


def test_neighbours_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert neighbours(make([]), make([])).collect() == []
    few = make([(0, [1.0, 0.0]), (20, [0.5, 3.0]), (3, [0.9, 0.1])])
    got = neighbours(few, few.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 3), (0, 20), (20, 3), (20, 0)] or [(r.query_id, r.vec_id) for r in got] == [(0, 3), (0, 20), (20, 0), (20, 3)]
