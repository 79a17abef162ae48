from __future__ import annotations

import hashlib
import math
import random
import re

from helpers import SCHEMA, documents, words

from loomspark.llm.mixing import mix, with_size
from loomspark.llm.sharding import Tree, place, shard


def share(sizes: dict, most: int = 3) -> dict:
    """Brute-force targets: fill by weight, stop the full ones, go on with the rest."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    goal, left, open_ = {}, float(sum(sizes.values())), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * unit > most * sizes[s]}
        if not over:
            return goal | {s: weight[s] * unit for s in open_}
        for s in over:
            goal[s] = most * sizes[s]
            left -= goal[s]
        open_ -= over
    return goal


def mixed(spark, rows):
    return mix(with_size(documents(spark, rows))).collect()


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, rng.randint(1, 60))), "en", rng.choice(["b", "a", None, "é", "tiny"] + ["hot"] * 5)) for i in range(600)]
    rows += [(1000 + i, None, "en", "a") for i in range(3)] + [(1003, " \t ", None, "b")]
    rows = [r for r in rows if r[3] != "tiny"] + [(2000, "one two", "en", "tiny")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    size = {}
    for r in rows:
        size[r[3]] = size.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    goal, taken = share(size), {}
    for r in got:
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9) and r.source_size == size[r.source]
        assert 0 <= r.copies <= 3
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size
    for s, t in taken.items():
        assert abs(t - goal[s]) <= max(r.size for r in got if r.source == s)
    again = sorted((r.doc_id, r.copies) for r in mixed(spark, rows))
    assert again == sorted((r.doc_id, r.copies) for r in got)


def test_one_source_empty_and_blank(spark):
    assert mixed(spark, []) == []
    got = mixed(spark, [(1, "a b", None, "s"), (2, "a b", None, "s"), (2, "a b", None, "s")])
    assert sum(r.copies * r.size for r in got) == 6
    assert [r.copies * r.size for r in mixed(spark, [(1, None), (2, "")])] == [0, 0]


def least(key, nodes):
    """The child of the smallest draw, by Python's own digest."""

    def draw(node, weight):
        bits = int(hashlib.md5(f"{key}/{node}".encode()).hexdigest()[:13], 16)
        return -math.log((bits + 0.5) / 2**52) / weight

    return min(range(len(nodes)), key=lambda i: draw(*nodes[i]))


def descend(key, tree: Tree) -> int:
    i = least(key, [(f"r{i}", sum(map(sum, racks))) for i, racks in enumerate(tree.regions)])
    j = least(key, [(f"r{i}k{j}", sum(ws)) for j, ws in enumerate(tree.regions[i])])
    k = least(key, [(f"r{i}k{j}s{k}", w) for k, w in enumerate(tree.regions[i][j])])
    return sum(len(rack) for region in tree.regions[:i] for rack in region) + sum(map(len, tree.regions[i][:j])) + k


def test_shards_follow_the_tree(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(7, "text 7"), (7, "other"), (None, None)]
    tree = Tree.balanced()
    got = shard(documents(spark, rows), tree).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        assert r.shard == descend("null" if r.doc_id is None else r.doc_id, tree)
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert any(r.grown_shard == 24 for r in got)
    assert shard(documents(spark, []), tree).collect() == []


def test_weights_share_and_confine(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    light = Tree((((1.0, 1.0), (1.0, 1.0)), ((2.0, 2.0),)))
    heavy = Tree((((1.0, 1.0), (1.0, 1.0)), ((2.0, 4.0),)))
    both = place(place(df, "doc_id", light, "a"), "doc_id", heavy, "b").collect()
    share_ = [sum(r.a == s for r in both) / len(both) for s in range(6)]
    assert all(abs(x - w / 8) < 0.02 for x, w in zip(share_, [1, 1, 1, 1, 2, 2], strict=True))
    moved = [(r.a, r.b) for r in both if r.a != r.b]
    assert moved and all(b in (4, 5) for _, b in moved)  # only into the region whose weight has grown
    assert SCHEMA
