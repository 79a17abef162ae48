from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from helpers import documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspark.llm.common import scratch_path
from loomspark.llm.dac import Segment, pack, read_tokens, segments, with_start, write_tokens
from loomspark.llm.packing import best_fit, improve, pieces
from loomspark.llm.packing import pack as pack_rows
from loomspark.llm.tokens import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PARTS = [" ", "  ", "\n", "\t", "\x1c", "\xa0", "a", "The", "É", "ß", "İ", "'", "'s", "don't", "1", "23", "!", ".", "...", "<|endoftext|>", "日本", "́", "😀", "Σας"]


@pytest.mark.parametrize("file", FILES)
@settings(max_examples=300, deadline=None)
@given(parts=st.lists(st.sampled_from(PARTS), max_size=14))
def test_ids_equal_the_library(file, parts):
    e, text = encoder(public_tokenizers.path(file)), "".join(parts)
    assert np.frombuffer(e(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("file", FILES)
def test_ids_of_long_text(file):
    rng = random.Random(2)
    text = "\n".join(" ".join(words(rng, 30)).capitalize() + "." for _ in range(200))
    e = encoder(public_tokenizers.path(file))
    assert np.frombuffer(e(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(ids=st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=1500))
def test_segment_round_trip_and_random_access(ids):
    data = pack(5, [3, None], np.array([len(ids) // 2, len(ids)]), np.array(ids, np.uint32))
    s = Segment(memoryview(data))
    assert s.ids().tolist() == ids and s.number == 5 and s.null.tolist() == [0, 1]
    assert all(s.token(i) == ids[i] for i in range(0, len(ids), 7))
    assert [x.size for x in segments(data + b"\n" + data + b"\n")] == [s.size] * 2


def test_files_round_trip(spark):
    rng = random.Random(4)
    rows = [(i * 3 % 101, " ".join(words(rng, rng.randint(0, 90)))) for i in range(101)]
    rows += [(200, None), (201, ""), (None, "null id"), (5, "again"), (5, "again")]
    path = scratch_path(spark, "test")
    write_tokens(documents(spark, rows), path, public_tokenizers.path(FILES[0]), 0)
    got = with_start(read_tokens(spark, path)).collect()
    e = encoder(public_tokenizers.path(FILES[0])).whole
    want = {(d, zlib.crc32(np.array([*e.encode(t or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for d, t in rows}
    assert {(r.doc_id, r.ids_crc32) for r in got} == want and len(got) == len(rows)
    got.sort(key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)


def test_no_documents(spark):
    path = scratch_path(spark, "test")
    write_tokens(documents(spark, []), path, public_tokenizers.path(FILES[0]), 0)
    assert with_start(read_tokens(spark, path)).collect() == []


@settings(max_examples=60, deadline=None)
@given(lengths=st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_packing_is_valid_and_no_worse_than_best_fit(lengths):
    sizes = np.array(lengths, np.int64)
    first = best_fit(sizes, 100)
    last = improve([list(b) for b in first], sizes, 100)
    for bins in (first, last):
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sizes[b].sum() <= 100 for b in bins)
    squares = lambda bins: sum(int(sizes[b].sum()) ** 2 for b in bins)
    assert len(last) <= len(first) and squares(last) >= squares(first)


def test_local_search_empties_a_sequence():
    sizes = np.array([60, 40, 50, 40, 30, 30, 20, 20, 10])
    start = [[0], [1, 2], [3, 4], [5, 6, 7], [8]]
    assert len(improve(start, sizes, 100)) == 3


def test_packed_documents(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(words(rng, rng.randint(0, 400)))) for i in range(60)] + [(90, " ".join(words(rng, 9000))), (91, None), (91, ""), (None, "x")]
    got = pack_rows(pieces(documents(spark, rows), public_tokenizers.path(FILES[1]), 1, keep_ids=True)).collect()
    e = encoder(public_tokenizers.path(FILES[1])).whole
    want = []
    for d, t in rows:
        ids = [*e.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(-1 if d is None else d, i, a, np.array(ids[a : a + 4096], "<u4").tobytes()) for i, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == sorted(want)
    total, at = sum(r.length for r in got), {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        at[r.sequence_id] = r.offset + r.length
    assert max(at.values()) <= 4096 and len(at) == -(-total // 4096)
    assert pack_rows(pieces(documents(spark, []), public_tokenizers.path(FILES[1]), 1)).collect() == []
