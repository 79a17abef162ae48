"""Exact, fast encoding of whole texts with a public tokenizer file.

The library's own path through a text costs about two microseconds a byte. Here a text is first cut where the
tokenizer's rules cut it anyway (at white space); a piece that was seen before is looked up, a plain word with
trailing punctuation goes straight to the library's BPE model, and any other piece through the library's whole
encode. The ids equal those of ``Tokenizer.encode(text, add_special_tokens=False)``; the tests compare them.
"""

from __future__ import annotations

import json
import re
from array import array
from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

#: Pieces that a Python worker remembers, the first it meets: frequent ones come early.
REMEMBERED = 400_000
#: ASCII marks other than the apostrophe (and than white space, letters and digits).
_MARKS = r"""!"#$%&()*+,-./:;<=>?@[\]^_`{|}~"""
#: Latin letters of two bytes at most, dotted capital I left out.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")
#: One space before a run of other characters belongs to it; of white space before text the last character stands alone.
_SPACED = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: White space other than blanks and line feeds; separators that Python's \s knows and the tokenizers' doesn't.
_OTHER, _ODD = re.compile(r"[^\S \n]"), re.compile(r"[\x1c-\x1f]")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class Encoder:
    """Texts to the bytes of their ids (little-endian, unsigned, 32 bits)."""

    def __init__(self, path: str) -> None:
        self.whole = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text())
        steps = spec.get("pre_tokenizer") or {}
        kinds = [s["type"] for s in steps.get("pretokenizers", [steps])] if steps else []
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        bpe = spec["model"]["type"] == "BPE" and not spec["model"].get("dropout")
        self.spaced = bpe and kinds == ["ByteLevel"] and not spec.get("normalizer") and steps["use_regex"] and not steps["add_prefix_space"]
        self.worded = bpe and kinds == ["Split", "ByteLevel"] and norms == ["NFC", "Replace", "Lowercase"]
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.known: dict[str, bytes] = {}  # pieces as they stand, or words after a blank
        self.first: dict[str, bytes] = {}  # words without a blank before them

    def _all(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _bpe(self, letters: str) -> bytes:
        if not letters.isascii() or letters[0] == " ":
            letters = "".join(map(_LETTERS.__getitem__, letters.encode()))
        return array("I", [t.id for t in self.whole.model.tokenize(letters)]).tobytes()

    def _word(self, word: str, known: dict[str, bytes], space: str) -> bytes:
        """Ids of a word, with a blank before it or not: letters and marks by the BPE model, anything else in whole."""
        letters = word.rstrip(_MARKS)
        if not letters or not (letters.isalpha() if letters.isascii() else _LATIN.fullmatch(letters)):
            return self._all(space + word)
        if len(letters) == len(word):
            return self._bpe(space + letters if self.spaced else letters.lower())
        marks = word[len(letters) :]
        return self._look(letters, known, space) + (self._look(marks, self.first, "") if self.spaced else self._bpe(marks))

    def _look(self, word: str, known: dict[str, bytes], space: str) -> bytes:
        got = known.get(word)
        if got is None:
            got = self._word(word, known, space)
            if len(known) < REMEMBERED and len(word) <= 64:
                known[word] = got
        return got

    def _words(self, words: list[str], known: dict[str, bytes], space: str) -> list[bytes]:
        got = list(map(known.get, words))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = self._look(words[i], known, space)
        return got

    def __call__(self, text: str) -> bytes:
        if any(map(text.__contains__, self.added)):
            return self._all(text)
        if self.worded and not _ODD.search(text):
            return b"".join(self._words(text.split(), self.known, ""))
        if not self.spaced or _ODD.search(text):
            return self._all(text)
        lines = [line.split(" ") for line in text.split("\n")]
        if _OTHER.search(text) or any("" in line for line in lines):
            return b"".join([self._look(p[1:], self.known, " ") if p[0] == " " and p.strip() else self._look(p, self.first, "") for p in _SPACED.findall(text)])
        out = []
        for i, line in enumerate(lines):
            if i:
                out.append(self._look("\n", self.first, ""))
            out.append(self._look(line[0], self.first, ""))
            out += self._words(line[1:], self.known, " ")
        return b"".join(out)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a Python worker and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
