"""Benchmark decontamination by the q-gram lemma.

Texts are compared in lower case with runs of white space as one space. A document leaks an item if ``window``
consecutive characters of the item (all of it, if it is shorter) are within ``rate`` * length edits of some passage. By the q-gram
lemma such a pair shares at least ``n + 1 - q * (edits + 1)`` q-grams whose places lie in one of the overlapping bands of
diagonals, within a bounded stretch of the document. Stretches with too few shared q-grams of any item are
left at once; in the others hits are counted by item, band and stretch; what meets the bound is verified by a
banded alignment, so the result is exact.

The benchmark is a stated query set: it is taken in blocks of at most about ``block_chars`` characters, each of which is sent to all
tasks. Items of fewer than ``least`` characters leak where they stand without an edit and not inside a longer word (Aho-Corasick over all of them).
Null and blank items are not searched.
A null or empty text leaks nothing. Ids may be null or repeat: a row for each leaking row and item. Equal items are
separate items. An empty table on either side gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_schema, mix, record, slices

LEAKS = "doc_id long, item_id long, start long, end long, edits int, whole boolean"
_B = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def _lower() -> np.ndarray:
    """Lower case of the basic plane, character by character; white space becomes a space."""
    out = np.arange(1 << 16, dtype=np.uint32)
    for c in range(1 << 16):
        if len(x := chr(c).lower()) == 1:
            out[c] = ord(x)
    out[[ord(x) for x in SPACES]] = 32
    return out


def normal(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normal form of code points and where each came from."""
    table = _lower()
    codes = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    at = np.nonzero(keep)[0]
    return codes[at], at


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the ``q`` characters from each place on."""
    n = len(codes) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for k in range(q):
        h *= _B
        h += c[k:k + n]
    return mix(h)


class Items:
    """One block of the benchmark: q-grams with their places, and the bounds of each item."""

    def __init__(self, rows: list[tuple[int, str]], q: int, window: int, rate: float, least: int):
        self.q, self.rate = q, rate
        every = [(i, normal(codes_of(t.strip(SPACES)))[0]) for i, t in rows if t is not None]
        kept = [(i, c) for i, c in every if len(c) >= max(least, q)]
        short = [(i, "".join(map(chr, c))) for i, c in every if 0 < len(c) < max(least, q)]
        self.short: dict[str, list[int]] = {}
        for at, (_, t) in enumerate(short, len(kept)):
            self.short.setdefault(t, []).append(at)
        self.ids = [i for i, _ in kept] + [i for i, _ in short]
        self.text = ["".join(map(chr, c)) for _, c in kept]
        n0 = np.array([min(window, len(c)) for _, c in kept], np.int64)
        # fewer edits where the lemma would ask for no shared q-gram
        self.edits = np.minimum((rate * n0 + 1e-9).astype(np.int64), np.maximum((n0 + 1 - 1) // q - 1, 0))
        self.n0, self.need = n0, n0 + 1 - q * (self.edits + 1)
        h = [gram_hashes(c, q) for _, c in kept]
        flat = np.concatenate(h) if h else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(h)), [len(x) for x in h])
        place = np.concatenate([np.arange(len(x)) for x in h]) if h else np.zeros(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places whose q-gram the block has, and its number."""
        at = np.nonzero(self.filter[(h >> np.uint64(42)).astype(np.int64)])[0]
        if not len(at):
            return at, at
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        good = self.keys[k] == h[at]
        return at[good], k[good]


def alignment(pattern: str, text: str, limit: int) -> tuple[int, int, int] | None:
    """Fewest edits (at most ``limit``) of the whole pattern against a passage of the text: (edits, start, end).

    Row by row; only diagonals on which the pattern can still end in the text are filled.
    Ties: the earliest end, then the longest passage.
    """
    far = limit + 1
    wide = len(text) - len(pattern) + limit
    row = [(0, j) for j in range(len(text) + 1)]
    for i, a in enumerate(pattern, 1):
        new = [(far, 0)] * (len(text) + 1)
        best = far
        for j in range(max(0, i - limit), min(len(text), i + wide) + 1):
            v = (row[j][0] + 1, row[j][1])
            if j:
                d = row[j - 1]
                v = min(v, d if text[j - 1] == a else (d[0] + 1, d[1]), (new[j - 1][0] + 1, new[j - 1][1]))
            if v[0] <= limit:
                new[j] = v
                best = min(best, v[0])
        if best > limit:
            return None
        row = new
    edits, _, end = min((v[0], j, j) for j, v in enumerate(row))
    return (edits, row[end][1], end) if edits <= limit else None


def find_leaks(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int, bool]]:
    """(text, item, start, end, edits, whole) for every text and item that it leaks; the first passage of each pair."""
    q = items.q
    joined = "\0".join(t or "" for t in texts) + "\0"
    raw = codes_of(joined)
    codes, source = normal(raw)
    lens = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
    begin = np.searchsorted(source, np.cumsum(lens) - lens)  # a break is never dropped, so texts start at kept places
    x, gram = items.hits(gram_hashes(codes, q))
    if not len(x):
        return []
    # a passage holds ``need`` hits within the window and its edits: leave hits that have no such stretch around them
    reach = int((items.n0 + items.edits).max())
    need = int(items.need.min())
    far = np.searchsorted(x, x + reach, "right")
    dense = far - np.arange(len(x)) >= need
    ends = np.bincount(far[dense], minlength=len(x) + 1)
    near = np.cumsum(dense - ends[:-1]) > 0
    x, gram = x[near], gram[near]
    if not len(x):
        return []
    count = items.count[gram]
    spot = np.repeat(items.first[gram] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    x, item, place = np.repeat(x, count), items.item[spot], items.place[spot]
    text = np.searchsorted(begin, x, "right") - 1
    # overlapping bands: a diagonal is in its own band and, within the edits, in the one before
    step = int(items.edits.max()) + 1
    diagonal = x - place + (1 << 20)
    band, inside = np.divmod(diagonal, step)
    both = inside < items.edits[item]
    band = np.concatenate([band, band[both] - 1])
    pick = np.concatenate([np.arange(len(x)), np.nonzero(both)[0]])
    key = (text[pick] * len(items.ids) + item[pick])
    order = np.lexsort((x[pick], band, key))
    pick, band, key = pick[order], band[order], key[order]
    # an alignment uses a place of the document once: hits of one place count once
    new = np.append(True, (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (x[pick[1:]] != x[pick[:-1]]))
    every, nth = pick, np.nonzero(new)[0]
    pick, band, key = pick[nth], band[nth], key[nth]
    upto = np.append(nth[1:], len(every))
    k = items.need[item[pick]]
    last = np.arange(len(pick)) + k - 1
    ok = last < len(pick)
    end = np.minimum(last, len(pick) - 1)
    ok &= (key[end] == key) & (band[end] == band)
    ok &= x[pick[end]] - x[pick] <= (items.n0 + items.edits - q)[item[pick]]
    # stretches of one pair and band that meet the bound, joined where they share hits
    first = np.nonzero(ok)[0]
    end = end[first]
    new = np.append(True, (first[1:] > np.maximum.accumulate(end)[:-1]) | (key[first[1:]] != key[first[:-1]])) if len(first) else first
    regions = np.nonzero(new)[0]
    stop_at = np.maximum.reduceat(end, regions) if len(regions) else end
    out = {}
    for j, last in zip(first[regions].tolist(), stop_at.tolist()):
        t, i = int(text[pick[j]]), int(item[pick[j]])
        if out.get((t, i)) is None:
            stop = int(begin[t + 1]) - 1 if t + 1 < len(texts) else len(codes) - 1
            own = every[nth[j]:upto[last]]
            out[t, i] = _verify(items, i, codes, int(begin[t]), stop, x[own], place[own])
    base = np.cumsum(lens) - lens
    return [(t, i, int(source[a] - base[t]), int(source[b - 1] - base[t]) + 1, e, w)
            for (t, i), got in out.items() if got for a, b, e, w in [got]]


def automaton(items: Items):
    """The short items of a block, or None."""
    if not items.short:
        return None
    import ahocorasick
    made = ahocorasick.Automaton()
    for t, own in items.short.items():
        made.add_word(t, (t, own))
    made.make_automaton()
    return made


def short_leaks(short, texts: list[str | None]) -> list[tuple[int, int, int, int, int, bool]]:
    """As ``find_leaks``, for the items of ``automaton``: the first place of each that is not inside a longer word."""
    out = []
    for t, text in enumerate(texts if short else ()):
        codes, source = normal(codes_of(text or ""))
        plain = codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
        seen = set()
        for last, (x, own) in short.iter(plain):
            a, b = last + 1 - len(x), last + 1
            inside = a and plain[a - 1].isalnum() and x[0].isalnum() or b < len(plain) and plain[b].isalnum() and x[-1].isalnum()
            if x not in seen and not inside:
                seen.add(x)
                out += [(t, i, int(source[a]), int(source[b - 1]) + 1, 0, True) for i in own]
    return out


def within(pattern: str, text: str, limit: int) -> bool:
    """Whether a passage of the text is within ``limit`` edits: columns of the alignment as bits of one integer."""
    n = len(pattern)
    ones, top = (1 << n) - 1, 1 << n - 1
    places: dict[str, int] = {}
    for k, c in enumerate(pattern):
        places[c] = places.get(c, 0) | 1 << k
    up, down, edits = ones, 0, n
    for c in text:
        eq = places.get(c, 0)
        side = eq | down
        eq |= ((eq & up) + up) ^ up
        plus, minus = down | ~(eq | up) & ones, up & eq
        edits += bool(plus & top) - bool(minus & top)
        if edits <= limit:
            return True
        plus, minus = plus << 1 & ones, minus << 1 & ones
        up, down = (minus | ~(side | plus)) & ones, plus & side
    return False


def _verify(items: Items, i: int, codes, begin: int, stop: int, x: np.ndarray, place: np.ndarray):
    """(start, end, edits, whole) of a window of the item around the hits (x, place) of a band, or None."""
    item, n0, e = items.text[i], int(items.n0[i]), int(items.edits[i])
    low, high = int((x - place).min()), int((x - place).max())

    def passage(p, n, limit):
        """Item characters p .. p + n - 1 against the document's on these diagonals."""
        a, b = max(begin, low + p - limit), min(stop, high + p + n + limit)
        text = "".join(map(chr, codes[a:max(a, b)]))
        if (at := text.find(item[p:p + n])) >= 0:
            return a + at, a + at + n, 0
        got = alignment(item[p:p + n], text, limit) if within(item[p:p + n], text, limit) else None
        return got and (a + got[1], a + got[2], got[0])
    starts = np.arange(max(0, int(place.min()) + items.q - n0), min(int(place.max()), len(item) - n0) + 1)
    ordered = np.unique(place)  # nor does it use a place of the item twice
    held = np.searchsorted(ordered, starts + n0 - items.q, "right") - np.searchsorted(ordered, starts)
    for p in starts[held >= int(items.need[i])].tolist():
        got = passage(p, n0, e)
        if got:
            all_of = passage(0, len(item), int(items.rate * len(item))) if n0 < len(item) else got
            return (*all_of, True) if all_of else (*got, False)
    return None


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
                  item_text: str = "text", q: int = 8, window: int = 100, rate: float = 0.08, least: int = 30,
                  block_chars: int = 8_000_000) -> DataFrame:
    """doc_id, item_id, start, end (code points), edits and whole for every document and item that it leaks."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_chars))
    out = arrow_schema(spark, LEAKS)
    found = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()  # about ``block_chars`` characters
        held = spark.sparkContext.broadcast(Items(sorted(((r[0], r[1]) for r in own), key=lambda r: (r[0] is None, r[0] or 0, r[1])), q, window, rate, least).__dict__)

        def run(batches, held=held):
            made = Items.__new__(Items)
            made.__dict__.update(held.value)
            short = automaton(made)
            for b in slices(batches, "text"):
                got = b.to_pydict()
                leaks = find_leaks(made, got["text"]) + short_leaks(short, got["text"]) if made.ids else []
                cols = list(zip(*[(got["doc_id"][t], made.ids[i], a, e, d, w) for t, i, a, e, d, w in leaks])) or [[]] * 6
                yield record(out, dict(zip(out.names, cols)))
        one = rows.mapInArrow(run, LEAKS)
        found = one if found is None else found.unionByName(one)
    return found
