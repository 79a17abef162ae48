from __future__ import annotations

import random

from helpers import documents, words

from loomspark.llm.jaccard import jaccard_stage


def kept(spark, sf_dir, rows):
    return sorted(((r.doc_id, r.text) for r in jaccard_stage(spark, documents(spark, rows), sf_dir).collect()), key=str)


def test_one_row_of_each_group_stays(spark, sf_dir):
    rng = random.Random(4)
    a, b, c, d, e = (" ".join(words(rng, 60)) for _ in range(5))
    near = lambda t: f"{t} tail"
    rows = [(1, a), (2, near(a)), (2, b)]  # b is unique, though its doc_id has a copy
    rows += [(3, c), (3, c), (3, c)]  # the same row three times
    rows += [(None, d), (None, near(d)), (None, d), (None, e), (4, near(e))]
    rows += [(5, None), (5, None), (None, ""), (6, " ")]
    got = kept(spark, sf_dir, rows)
    assert [x for x in got if x[0] is not None and x[1] and x[1] != " "] == sorted([(1, a), (2, b), (3, c), (4, near(e))], key=str)
    assert len([x for x in got if x[0] is None and x[1]]) == 1
    assert len([x for x in got if not (x[1] or "").strip()]) == 4


def test_a_doc_id_of_a_third_of_the_rows(spark, sf_dir):
    rng = random.Random(5)
    rows = [(i, " ".join(words(rng, 40))) for i in range(40)] + [(7, " ".join(words(rng, 40))) for _ in range(20)]
    rows.append((7, rows[3][1]))  # copies document 3
    assert kept(spark, sf_dir, rows) == sorted(rows[:-1], key=str)
