from __future__ import annotations

import random

from loomspark.llm.common import clear, components, materialize
from loomspark.llm.jaccard import merged


def brute(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def graph():
    """A path in mixed order, a hub, a clique, repeated and self links, and random ones; ids of both signs."""
    rng = random.Random(11)
    path = list(range(-40, 0))
    rng.shuffle(path)
    links = list(zip(path, path[1:])) + [(500, x) for x in range(100, 160)]
    links += [(a, b) for a in range(200, 212) for b in range(200, 212) if a != b]
    links += [(rng.randint(600, 800), rng.randint(600, 800)) for _ in range(90)]
    return [(a, b) for a, b in links if a != b] + links[:5]


def test_components(spark):
    links = graph()
    frame = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.comp for r in components(frame, "a", "b").collect()} == brute(links)
    assert not components(frame.where("a = b"), "a", "b").collect()
    clear(spark)


def test_merged(spark):
    """Links that come later give the components of all links, whether or not they join any."""
    links = graph()
    random.Random(12).shuffle(links)
    comp, seen = spark.createDataFrame([], "node long, comp long"), []
    for at in range(0, len(links), 130):
        seen += links[at : at + 130]
        comp = merged(comp, spark.createDataFrame(links[at : at + 130], "a long, b long"))
        assert sorted((r.node, r.comp) for r in comp.collect()) == sorted(brute(seen).items())
    comp = materialize(comp, "components")
    again = merged(comp, spark.createDataFrame(links[:9], "a long, b long"))
    assert sorted(again.collect()) == sorted(comp.collect())
    clear(spark)
