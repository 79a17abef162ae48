from __future__ import annotations

import random
from collections import Counter

import pytest
from corpus_pipeline import STAGES, run
from helpers import documents, words

from loomspark.llm import registry
from loomspark.llm.common import clear, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_every_operator_is_registered():
    names = {n.split("_")[0] for n in registry.QUERIES}
    assert names >= {f"op{i}" for i in range(1, 11)} and "pipeline" in names


def test_stages_in_turn(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count = docs.count()
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "stage")
        assert docs.columns == COLUMNS, name
        assert docs.count() > 0
        if name != "mixture":
            assert docs.count() <= count
            count = docs.count()


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rng = random.Random(8)
    good = [" ".join(words(rng, 70)) for _ in range(6)]
    long = " ".join(words(rng, 60_000))
    return [(1, good[0], "en", "a"), (1, good[1], None, None), (1, good[1], None, None), (None, good[2], "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, " \n", None, "b"), (None, None, None, None), (5, long, "en", "b"), (6, good[3], "fr", "b"), (6, good[3], "fr", "b"), (7, good[4], "en", "a")]


@pytest.mark.parametrize("name, stage", STAGES[:-1])
def test_odd_rows(name, stage, spark, sf_dir):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.text) for r in stage(spark, docs, sf_dir).select(*COLUMNS).collect())
    given = Counter((r[0], r[1]) for r in rows)
    if name == "quality":  # no labels for these: all with text stay
        assert set(got) <= set(given) and not any(not t for _, t in got)
    elif name == "near_copies":
        assert set(got) == set(given) and got[(1, rows[1][1])] == 1 and got[(6, rows[9][1])] == 1
    elif name == "substrings":  # the second of equal rows loses its text
        assert {k for k in got if k[1]} == {k for k in given if k[1] and k[1].strip()} | {(4, " \n")}
    else:
        assert set(got) <= set(given) and max(got.values()) <= 6


@pytest.mark.parametrize("name, stage", STAGES)
def test_nothing(name, stage, spark, sf_dir):
    assert stage(spark, documents(spark, []), sf_dir).count() == 0


def test_run(spark, sf_dir):
    got = run(spark, sf_dir).collect()
    assert got and max(r.offset + r.length for r in got) <= 4096
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert not any(labels.get(r.doc_id) == 0 for r in got)
    clear(spark)
