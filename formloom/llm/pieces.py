"""Ids of texts by the ``tokenizers`` library, with its encodings of single pieces kept.

A pre-tokenizer cuts a text into pieces that are encoded one by one, so a text's
ids are its pieces' ids in order. Words repeat, so a worker has the library encode
a piece once and looks it up after that (the library alone takes three to five times
as long). Pieces are cut in numpy over a whole slice of texts. Texts with characters
outside :data:`PLAIN`, where Unicode tables of two engines might differ, and
texts that hold a special token go to the library whole.
"""

from __future__ import annotations

import sys
import unicodedata
from itertools import chain

import numpy as np

from .common import mix, ragged

LETTER, NUMBER, SPACE, OTHER, BREAK, UNKNOWN = range(6)
#: Characters of one fixed class in every Unicode version: ASCII, Latin letters and common punctuation.
PLAIN = [*map(ord, "\t\n\r–—‘’“”…"), *range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x130), *range(0x132, 0x250)]
#: For the files whose pre-tokenizer is known: lower case first, a space opens the next piece, digits stand alone.
KINDS = {"byte_bpe_50k.json": (False, True, False), "word_bpe_49k.json": (True, False, True)}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of the code points below 0x2030 (0 is the break between texts)."""
    kind, low = np.full(0x2030, UNKNOWN, np.uint8), np.arange(0x2030, dtype=np.uint32)
    for c in PLAIN:
        group = unicodedata.category(chr(c))[0]
        kind[c] = SPACE if chr(c).isspace() else {"L": LETTER, "N": NUMBER}.get(group, OTHER)
        low[c] = ord(chr(c).lower())
    kind[0] = BREAK
    return kind, low


def _byte_names() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes name themselves, the others get the code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Coder:
    """``encode(texts) -> (ids, lengths)``: all ids in one array, and how many each text has."""

    def __init__(self, path: str, keep: int = 2_000_000):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.kind = KINDS.get(path.replace("\\", "/").rpartition("/")[2])
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.keep, self.names = keep, _byte_names()
        self.classes, self.low = _tables()
        self.salt = mix(np.arange(1, 0x2031, dtype=np.uint64))
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._clear()

    def _clear(self):
        self.keys, self.start, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _starts(self, code: np.ndarray, spaced: bool, digits: bool) -> np.ndarray:
        """Where pieces begin. Runs of one class are pieces; the rules for white space and for 's 't 'm 'd 're 've 'll follow."""
        kind = self.classes[code]
        solid = kind <= OTHER
        solid &= kind != SPACE
        begin = np.ones(len(code), bool)
        begin[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == BREAK)
        if digits:
            begin |= kind == NUMBER
        if spaced:  # the last of the white space before a word is a piece of its own, or opens the word if it is a space
            i = np.nonzero(solid[1:] & (kind[:-1] == SPACE))[0] + 1
            begin[i - 1] = True
            begin[i] = code[i - 1] != 32
        i = np.nonzero((code == 39) & begin)[0]
        i = i[kind[i + 1] == LETTER]  # a break ends the slice, so i + 2 exists here
        a, b = code[i + 1], code[i + 2]
        one = np.isin(a, [ord(x) for x in "stmd"])
        two = np.isin(a, [ord(x) for x in "rv"]) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        begin[i[one] + 1] = begin[i[two] + 1] = False
        begin[i[one] + 2] = True
        begin[i[two] + 3] = True  # likewise
        return begin

    def _hashes(self, code: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(self.powers) < len(code):
            base = np.uint64(0x9E3779B97F4A7C15)
            n = 2 * len(code)
            for name, by in (("powers", base), ("inverse", np.uint64(pow(int(base), -1, 1 << 64)))):
                run = np.full(n, by, np.uint64)
                run[0] = 1
                setattr(self, name, np.multiply.accumulate(run))
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(self.salt[code] * self.powers[:len(code)], out=total[1:])
        return mix((total[e] - total[s]) * self.inverse[s] + (e - s).astype(np.uint64))

    def _learn(self, keys: np.ndarray, new: list[str]):
        one = self.lib.model.tokenize
        table = {i: c for i, c in self.names.items()}
        got = [[t.id for t in one(w.encode().decode("latin-1").translate(table))] for w in new]
        length = np.fromiter(map(len, got), np.int32, len(got))
        ids = np.fromiter(chain.from_iterable(got), np.uint32, int(length.sum()))
        start = len(self.flat) + np.cumsum(length) - length
        at = np.searchsorted(self.keys, keys)  # both sorted
        self.keys, self.start = np.insert(self.keys, at, keys), np.insert(self.start, at, start)
        self.length, self.flat = np.insert(self.length, at, length), np.append(self.flat, ids)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        texts = [t or "" for t in texts]
        if len(self.keys) > self.keep:
            self._clear()
        if self.kind is None:
            return self._library(texts)
        whole = ["\0" in t or any(x in t for x in self.special) for t in texts]
        joined, code = self._join(texts, whole)
        odd = code >= len(self.classes)
        odd |= self.classes[np.where(odd, 0, code)] == UNKNOWN
        if odd.any():
            for i in np.unique(np.searchsorted(np.nonzero(code == 0)[0], np.nonzero(odd)[0])):
                whole[i] = True
            joined, code = self._join(texts, whole)
        return self._plain(texts, whole, code, joined)

    @staticmethod
    def _join(texts, whole):
        joined = "\0".join("" if w else t for w, t in zip(whole, texts)) + "\0" * bool(texts)
        return joined, np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)

    def _library(self, texts):
        got = [np.asarray(e.ids, np.uint32) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]
        return (np.concatenate(got) if got else np.zeros(0, np.uint32)), np.array([len(x) for x in got], np.int64)

    def _plain(self, texts, whole, code, joined):
        lower, spaced, digits = self.kind
        if lower:
            code = self.low[code]
        begin = self._starts(code, spaced, digits)
        s = np.nonzero(begin)[0]
        e = np.append(s[1:], len(code))
        kind = self.classes[code[s]]
        keep = kind != BREAK if spaced else (kind != BREAK) & (kind != SPACE)
        text = np.cumsum(kind == BREAK)[keep]
        s, e = s[keep], e[keep]
        if len(s):
            h, first, back = np.unique(self._hashes(code, s, e), return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
            miss = np.nonzero(self.keys[at] != h)[0] if len(self.keys) else np.arange(len(h))
            if len(miss):
                a, b = s[first[miss]].tolist(), e[first[miss]].tolist()
                new = [joined[i:j] for i, j in zip(a, b)]
                self._learn(h[miss], [w.lower() for w in new] if lower else new)
                at = np.searchsorted(self.keys, h)
            per = self.length[at][back].astype(np.int64)
            ids = self.flat[ragged(self.start[at][back], per)]
            lengths = np.bincount(text, per, len(texts)).astype(np.int64)
        else:
            ids, lengths = np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if not any(whole):
            return ids, lengths
        rest = iter(self.lib.encode_batch_fast([t for t, w in zip(texts, whole) if w], add_special_tokens=False))
        out, pos = [], 0
        for i, w in enumerate(whole):
            if w:
                own = np.asarray(next(rest).ids, np.uint32)
                lengths[i] = len(own)
            else:
                own = ids[pos:pos + int(lengths[i])]
                pos += len(own)
            out.append(own)
        return np.concatenate(out), lengths


def coder(path: str) -> Coder:
    """One coder per Python worker and file; it lives in ``sys``, as this module itself travels by value with each task."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    kept = sys.__dict__.setdefault("_formloom_coders", {})
    if path not in kept:
        kept[path] = Coder(path)
    return kept[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Every text followed by the id ``end``."""
    out = np.full(len(ids) + len(lengths), end, np.uint32)
    keep = np.ones(len(out), bool)
    keep[np.cumsum(lengths + 1) - 1] = False
    out[keep] = ids
    return out, lengths + 1
