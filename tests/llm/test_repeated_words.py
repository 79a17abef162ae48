from __future__ import annotations

import random

from helpers import documents, words

from loomspark.llm import quality


def test_repeated_words_are_not_kept(spark):
    rng = random.Random(12)
    rows = [(i, " ".join(words(rng, 60)), "en") for i in range(200)]
    once = words(rng, 40)
    junk = [" ".join(w for w in once[i : i + 6] for _ in range(12)) for i in range(20)] + [" ".join(once[i : i + 2] * 30) for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(150)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows + [(1000 + i, t, "en") for i, t in enumerate(junk)]), labels, ["doc_id"]).collect()
    assert len(got) == 230 and not any(r.keep for r in got if r.doc_id >= 1000)
    assert sum(r.keep for r in got if r.doc_id < 1000) >= 190


def test_repetition_forgives_one_word():
    assert quality.repetition(b"") == quality.repetition(b"one") == quality.repetition(b"one one") == 0
    assert quality.repetition(b"a a a a") == 0.5 and quality.repetition(b"a b c d e a b") == 0
