from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm import common, jaccard, quality, substring
from loomspark.llm.common import word_hashes
from loomspark.llm.jaccard import Bands, class_of, join, signatures
from loomspark.llm.langid import codebook, fit, op2_langid, predict
from loomspark.llm.substring import chunk, gear, repeats

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
BLANK = " \t\n\x0b\x0c\r"


def split(text):
    out, word = [], ""
    for ch in (text or "").translate(LOWER) + " ":
        if ch in BLANK:
            out += [word] if word else []
            word = ""
        else:
            word += ch
    return out


def brute_components(rows, n, percent):
    sets = []
    for _, t in rows:
        w = split(t)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted((str(d), len(sets[i]), low.get(find(i))) for i, (d, _) in enumerate(rows))


def edit(rng, w, k):
    w = list(w)
    for _ in range(k):
        i = rng.randrange(len(w))
        w[i : i + 1] = rng.choice([[], words(rng, 1), [w[i], *words(rng, 1)]])
    return w


@pytest.mark.parametrize("n, percent", [(4, 85), (5, 80)])
def test_jaccard_join_equals_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows, number = [], 0
    for _ in range(40):
        base = words(rng, rng.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 90, 300]))
        for _ in range(rng.randint(1, 7)):
            text = " ".join(edit(rng, base, rng.randint(0, max(1, len(base) // 40))))
            rows.append((number * 7 % 1009, rng.choice([text, text.upper(), text.replace(" ", "\n\t ")])))
            number += 1
    base = words(rng, 150)
    for _ in range(40):  # a chain of near copies: far ends aren't linked directly
        base = edit(rng, base, 1)
        rows.append((2000 + number, " ".join(base)))
        number += 1
    rows += [(3000, None), (3001, ""), (3002, " \n"), (3003, "one"), (3004, "ONE"), (None, "one"), (None, None), (3005, "one two"), rows[0], rows[0]]
    got = join(documents(spark, rows), n, percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows, n, percent)


def test_rounds_and_cells_equal_brute_force(spark, monkeypatch):
    """One large group whose members are far from its smallest, named one at a time, in cells of a few classes."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "NAMED", 1)
    rng = random.Random(9)
    base, rows = words(rng, 120), []
    for i in range(120):
        rows.append((i, " ".join(edit(rng, base, rng.randint(1, 4)))))
    passage = words(rng, 60)  # shares signatures, but nothing links
    rows += [(500 + i, " ".join(passage + words(rng, 30))) for i in range(40)]
    got = join(documents(spark, rows)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in got) == brute_components(rows, 4, 85)


def test_words_that_meet_under_sums_of_powers(spark):
    """Thue-Morse words and their complements have the same polynomial hash modulo 2**64 for every odd base."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    two = one.translate(str.maketrans("ab", "ba"))
    assert word_hashes(one.encode()) != word_hashes(two.encode())
    got = {r.doc_id: r.component_id for r in join(documents(spark, [(1, f"{one} x y z"), (2, f"{two} x y z"), (3, f"{one} x y z")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}
    tail = " ".join(words(random.Random(1), 40))
    long = {r.doc_id: r.removed_words for r in repeats(documents(spark, [(1, f"{one} " * 40), (2, f"{two} " * 40), (3, tail)])).collect()}
    assert long[2] == long[1] and long[3] == 0


def test_word_hashes_block_by_block(monkeypatch):
    text = " \t".join(words(random.Random(2), 500)).encode() + b" " + b"x" * 300 + b"\n\x0b"
    whole = word_hashes(text)
    assert len(whole) == len(text.split()) and len(word_hashes(b"")) == 0 and len(word_hashes(b" \n")) == 0
    monkeypatch.setattr(common, "BLOCK", 37)
    assert (word_hashes(text) == whole).all()


def test_jaccard_join_of_nothing(spark):
    assert join(documents(spark, [])).collect() == []


@settings(max_examples=150, deadline=None)
@given(seed=st.integers(0, 10**6), size=st.integers(1, 400), percent=st.sampled_from([80, 85]))
def test_linked_sets_share_a_signature(seed, size, percent):
    rng, bands = np.random.default_rng(seed), Bands(percent)
    a = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64, endpoint=False))
    most = (100 - percent) * len(a) // 100
    b = np.unique(np.concatenate([a[rng.permutation(len(a))][: len(a) - rng.integers(0, most + 1)], rng.integers(0, 2**64, rng.integers(0, most + 1), dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both >= percent * (len(a) + len(b) - both) and class_of(a) != class_of(b):
        shared = set(bands.keys(len(a))) & set(bands.keys(len(b)))
        assert any(len(np.intersect1d(signatures(a, k, bands.shape(k)), signatures(b, k, bands.shape(k)))) for k in shared)


# ---------------------------------------------------------------- language


def test_held_out_accuracy(spark, sf_dir):
    got = op2_langid(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rng = random.Random(1)
    swap = str.maketrans("thrn", "zqxk")
    rows = [(i, " ".join(words(rng, 30)).translate(swap if i % 2 else {}), "bb" if i % 2 else "aa") for i in range(60)]
    model = fit(documents(spark, rows).where("lang is not null"), 1000)
    odd = [(1, None), (2, ""), (3, "123 !?"), (4, "THE an er in on"), (5, "zqe" * 3), (6, "a"), (None, "the " * 400_000)]
    got = {r.doc_id: r for r in predict(documents(spark, odd), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "aa", "bb"] and got[6].lang_pred in ("aa", "bb") and got[None].lang_pred == "aa"
    assert got[1].score == 0
    none = fit(documents(spark, []), 10)
    assert none is None and {r.lang_pred for r in predict(documents(spark, odd), none).collect()} == {"und"}
    assert predict(documents(spark, []), model).collect() == []


@pytest.mark.parametrize("k", [1, 2, 3, 4, 6, 7, 12])
def test_codewords_are_apart(k):
    code = codebook(k)
    apart = [(code[i] != code[j]).sum() for i in range(k) for j in range(i)]
    assert code.shape[0] == k and all(a >= max(1, code.shape[1] // 4) for a in apart)


# ---------------------------------------------------------------- quality


def kneser_ney(train: list[bytes], order: int):
    """Interpolated modified Kneser-Ney by dictionaries."""
    pad = b"\0" * (order - 1)
    counts = {order: Counter((pad + t)[i : i + order] for t in train for i in range(len(t)))}
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def cuts(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else (i + 1) * 0.5 for i in range(3)]
        return [0.0] + [min(max(x, 0.05), i + 0.95) for i, x in enumerate(d)]

    d = {k: cuts(c) for k, c in counts.items()}
    after = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, v in c.items():
            after[k][g[:-1]].append(v)

    def p(g):
        if not g:
            return 1 / 256
        k, lower = len(g), p(g[1:])
        seen = after[k].get(g[:-1])
        if not seen:
            return lower
        v = counts[k].get(g, 0)
        return (max(v - d[k][min(v, 3)], 0) + sum(d[k][min(x, 3)] for x in seen) * lower) / sum(seen)

    return lambda t: sum(-math.log2(p((pad + t)[i : i + order])) for i in range(len(t))) / len(t)


def test_perplexity_equals_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(words(rng, rng.randint(1, 40))) + ("é!" if i % 5 == 0 else "")) for i in range(50)] + [(90, None), (91, ""), (92, "QQQ ### zzz"), (3, "again")]
    df = documents(spark, rows).selectExpr("*", "doc_id < 30 as _llm_train")
    got = {(r.doc_id, r.text): r._llm_bits for r in quality.score(df, block=1500).collect()}
    model = kneser_ney([t.encode() for d, t in rows if d < 30 and t], quality.ORDER)
    assert len(got) == len(rows) and got[90, None] is None and got[91, ""] is None
    for d, t in rows:
        if t:
            assert abs(got[d, t] - model(t.encode())) < 0.002


def test_classifier_keeps_clean_text(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(words(rng, 60)), "en" if i % 3 else None) for i in range(150)]
    junk = [(1000 + i, "".join(rng.choice("#$%&*!@QXZJ") for _ in range(200)), "en") for i in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(110)] + [(1000, 0, 0), (5, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(spark, rows + junk + [(2000, None, "en"), (2001, "", None)]), labels, ["doc_id", "text", "shard"]).collect()
    assert len(got) == 182
    assert not any(r.keep for r in got if r.doc_id >= 1000)
    assert sum(r.keep for r in got if r.doc_id < 1000) >= 147
    nobody = labels.where("false")
    assert {r.keep for r in quality.classify(documents(spark, rows[:5]), nobody, ["doc_id"]).collect()} == {True}
    assert quality.classify(documents(spark, []), labels, ["doc_id"]).collect() == []


# ---------------------------------------------------------------- substrings


def test_gear_is_the_rolling_hash():
    from loomspark.llm.substring import _GEAR

    buf = np.frombuffer(random.Random(1).randbytes(500), np.uint8)
    h, out = 0, []
    for b in buf.tolist():
        h = (2 * h + int(_GEAR[b])) % 2**32
        out.append(h)
    assert gear(buf).tolist() == out


def test_chunks_resist_shifts():
    rng = random.Random(3)
    w = words(rng, 600)
    a, b = chunk(" ".join(w).encode())[0], chunk(" ".join([*w[:200], "inserted", *w[200:]]).encode())[0]
    assert len(set(a.tolist()) - set(b.tolist())) <= 4 and len(a) > 60


def test_planted_passages_are_cut_once(spark):
    rng = random.Random(5)
    passage, copy = " ".join(words(rng, 60)), " ".join(words(rng, 100))
    rows = [(i, " ".join(words(rng, 120))) for i in range(40)]
    with_it = {3, 11, 17, 29}
    rows = [(i, " ".join([t[:200], passage, t[200:]]) if i in with_it else t) for i, t in rows]
    rows += [(50, copy), (51, copy), (51, copy), (52, None), (53, ""), (None, copy), (54, "short text"), (55, "short text")]
    got = repeats(documents(spark, rows), block=3000).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.removed_words > 0): r for r in got}
    middle = " ".join(passage.split()[15:45])
    assert [r.doc_id for r in got if r.text and middle in r.text] == [3]
    assert {r.doc_id for r in got if r.removed_words} == {11, 17, 29, 51, None}
    assert sorted((r.text or "") == "" for r in got if r.doc_id in (50, 51, None)) == [False, True, True, True]
    assert by[11, True].kept_in == [3] and by[17, True].spans[0]["end"] > by[17, True].spans[0]["first"]
    clean = dict(rows)
    assert all(r.text == clean[r.doc_id] for r in got if not r.removed_words and r.doc_id is not None)
    assert repeats(documents(spark, [])).collect() == []


def brute_repeats(rows):
    """The first occurrence of a chunk stays; runs of others of RUN words or more go."""
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (t or "").encode()
        digest, first, n = chunk(raw)
        again = []
        for x in digest.tolist():
            again.append(x in seen)
            seen.add(x)
        stop, kept, at, i, gone = [*first.tolist(), len(raw)], [], 0, 0, 0
        while i < len(again):
            j = i
            while j < len(again) and again[j]:
                j += 1
            if j > i and n[i:j].sum() >= substring.RUN:
                kept.append(raw[at : stop[i]])
                at, gone = stop[j], gone + int(n[i:j].sum())
            i = max(j, i + 1)
        out[d] = (None if t is None else (b"".join([*kept, raw[at:]]).rstrip() if gone else raw).decode(), gone)
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    """Blocks of a few documents, merged and answered two at a time; one passage stands in every document."""
    monkeypatch.setattr(substring, "FAN", 2)
    rng = random.Random(6)
    passages = [words(rng, rng.randint(30, 90)) for _ in range(6)]
    rows = []
    for i in range(90):
        body = words(rng, rng.randint(0, 80))
        for p in rng.sample(passages, rng.randint(0, 3)):
            at = rng.randint(0, len(body))
            body[at:at] = p
        rows.append((i * 7 % 97, " ".join(body + passages[0])))
    rows += [(200, None), (201, ""), (202, " \n "), (203, rows[0][1]), (None, rows[1][1]), (204, "é " * 3 + " ".join(passages[1]) * 2)]
    got = {r.doc_id: (r.text, r.removed_words) for r in repeats(documents(spark, rows), block=3000).collect()}
    assert got == brute_repeats(rows)
