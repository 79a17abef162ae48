from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the an er in on re ti ed st sh wh ou or ha be ly nt at es en".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with columns whose names clash with the operators' own."""
    full = [(r + (None,) * 4)[:4] for r in map(tuple, rows)]
    data = [(*r, len(r[1]) if r[1] else None, 1, "x", 2, 3) for r in full]
    return spark.createDataFrame(data, SCHEMA + ", shard int, slot string, copies int, class int")
