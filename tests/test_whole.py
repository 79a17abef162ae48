"""The queries that stand for whole tables read every row of them."""

from __future__ import annotations

import math
from collections import Counter

import pytest

from loomspark import registry
from loomspark.tables import table

JOINS = ["inner", "left", "right", "full", "semi", "anti"]
SETS = ["union_all", "intersect", "except", "intersect_all", "except_all", "union_all_three", "union_distinct"]


def count(spark, sf_dir, name):
    return registry.QUERIES[name](spark, sf_dir).count()


@pytest.mark.parametrize("name", [f"join_{x}" for x in JOINS] + SETS)
def test_no_filter_on_ids(name):
    assert "%" not in registry.ORACLE[name]


def test_joins_and_sets_take_all_rows(spark, sf_dir):
    customers, orders, suppliers = (table(spark, sf_dir, x).count() for x in ("customer", "orders", "supplier"))
    got = {x: count(spark, sf_dir, f"join_{x}") for x in JOINS}
    assert got["semi"] + got["anti"] == customers and got["right"] == orders and got["semi"] and got["anti"]
    assert got["left"] == got["inner"] + got["anti"] and got["full"] == got["right"] + got["anti"]
    assert got["inner"] < orders
    assert count(spark, sf_dir, "union_all") == customers + suppliers
    assert count(spark, sf_dir, "intersect_all") + count(spark, sf_dir, "except_all") == customers


def test_all_timestamps_are_sealed(spark, sf_dir):
    assert count(spark, sf_dir, "sealed_timestamps") == table(spark, sf_dir, "events").count()


def test_pagerank_over_all_customers_and_suppliers(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").collect()
    buyer = {r.o_orderkey: r.o_custkey for r in table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").collect()}
    links = [(buyer[r.l_orderkey] * 2, r.l_suppkey * 2 + 1) for r in lines if r.l_orderkey in buyer]
    links += [(b, a) for a, b in links]
    out = Counter(a for a, _ in links)
    rank = dict.fromkeys(out, 1.0)
    for _ in range(5):
        new = dict.fromkeys(out, 0.15)
        for a, b in links:
            new[b] += 0.85 * rank[a] / out[a]
        rank = new
    got = {r.id: r.rank for r in registry.QUERIES["pagerank_five"](spark, sf_dir).collect()}
    assert len(got) == len(rank) > 97 and all(math.isclose(got[i], rank[i], rel_tol=1e-9) for i in rank)
