"""PageRank reads its edges once, and deals them by their number."""

from __future__ import annotations

import math
import re

import pyarrow as pa
import pytest

from loomspark import registry
from loomspark.plans import programs
from loomspark.tables import table

EDGES = [(1, 2), (1, 3), (2, 3), (3, 1), (3, 1), (4, 1), (4, 4), (5, 2)]


@pytest.mark.parametrize("weighted", [False, True])
def test_edges_are_made_once(spark, weighted):
    out = {a: sum(x == a for x, _ in EDGES) for a, _ in EDGES}
    made = spark.sparkContext.accumulator(0)

    def work(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(a, b, 1 / out[a]) for a, b in EDGES], "src long, dst long, weight double").coalesce(1)
    edges = rows.mapInArrow(work, "src long, dst long, weight double")
    ranks = spark.createDataFrame([(a, 1.0) for a in out], "id long, rank double")
    got = programs.pagerank(edges, ranks, 5) if weighted else programs.pagerank(edges.drop("weight"), iterations=5)
    want = dict.fromkeys(out, 1.0)
    for _ in range(5):
        new = {}
        for a, b in EDGES:
            new[b] = new.get(b, 0.15) + 0.85 * want.get(a, 0) / out[a]
        want = new
    got = {r.id: r.rank for r in got.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-12) for i in want)
    assert made.value == len(EDGES)


def test_edges_are_dealt_by_their_number(spark, sf_dir, monkeypatch):
    lines = table(spark, sf_dir, "lineitem").count()
    monkeypatch.setattr(programs, "LINKS", 500, raising=False)
    plan = registry.QUERIES["pagerank_step"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    for key in ("src", "o_orderkey", "l_orderkey"):
        assert max(map(int, re.findall(rf"hashpartitioning\({key}#\d+L, (\d+)\)", plan)), default=0) * 500 >= 2 * lines
