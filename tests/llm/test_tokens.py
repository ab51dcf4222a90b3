import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models

from formloom.llm import packing, token_files
from formloom.llm.pieces import Coder
from formloom.llm.token_counts import Counter, marked, sentencepiece_vocabulary, token_counts
from formloom.session import scratch

from .cases import frame, key, rows

ODD = ["", "  ", "a  b   ", "x\n\n y's Don't İstanbul ﬁ ́e", "<|endoftext|> hi", "日本語 テスト 12３", "\x85a\xa0b", "'s 's'll", "'s", "a'", "a\0b", "we'VE we've 12 345"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_librarys_ids(name):
    lib, mine = Tokenizer.from_file(public_tokenizers.path(name)), Coder(public_tokenizers.path(name), keep=50)
    texts = ODD + [t or "" for _, t, _ in rows()] + ODD
    for _ in range(2):  # the second time from what is kept
        ids, n = mine.encode(texts)
        want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
        assert list(n) == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
    assert mine.encode([]) [1].tolist() == []


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_page_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
    ids[::17] = 2**32 - 1
    p = token_files.Page(token_files.encode_page([4, None], np.array([n // 2, n - n // 2]), ids))
    assert (p.ids() == ids).all() and p.doc_ids == [4, None]
    for k in range(-(-n // 128)):
        assert (p.block(k) == ids[k * 128:(k + 1) * 128]).all()


def test_token_files(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    data = rows()
    path = scratch(spark, "t")
    token_files.write_tokens(frame(spark, data), path, public_tokenizers.path("byte_bpe_50k.json"), 2, page_ids=4000)
    got = [tuple(r) for r in token_files.read_tokens(spark, path, ids=True).collect()]
    want, at = [], 0
    for d, t in sorted(((d, t) for d, t, _ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = lib.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want


def test_token_counts_follow_the_library(spark):
    vocabulary = sentencepiece_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    lib = Tokenizer(models.Unigram(vocabulary, 0, True))
    data = rows()
    got = [tuple(r) for r in token_counts(frame(spark, data), public_tokenizers.path("piece_bpe_32k.model")).collect()]
    assert sorted((r[:2] for r in got), key=key) == sorted(
        ((d, len(lib.encode(marked(t), add_special_tokens=False).ids)) for d, t, _ in data), key=key)


def test_ties_and_unknowns():
    import random
    rng = random.Random(2)
    for _ in range(100):
        entries = dict([("<unk>", 0.0)] + [("".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))), -rng.choice([1, 2, 3, 1.5, .1, .2, .3]))
                                           for _ in range(12)])
        lib, mine = Tokenizer(models.Unigram(list(entries.items()), 0, False)), Counter(list(entries.items()), False)
        for _ in range(20):
            s = "".join(rng.choice("abcd▁") for _ in range(rng.randint(0, 14)))
            assert mine.count(s)[0] == len(lib.encode(s, add_special_tokens=False).ids)


def test_packing(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    data, capacity = rows(), 64
    pieces = packing.token_pieces(frame(spark, data), public_tokenizers.path("word_bpe_49k.json"), 1, capacity, ids=True)
    packed = packing.pack(pieces, capacity).cache()
    got = packed.collect()
    want = []
    for d, t, _ in data:
        ids = lib.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(d, k // capacity, k, len(p := ids[k:k + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for k in range(0, len(ids), capacity)]
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(bins) <= 1.05 * sum(r.length for r in got) / capacity + 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    assert {k: len(v) for k, v in whole.items()} == {k: sum(n for _, n in v) for k, v in bins.items()}


def test_empty_tables(spark):
    none = frame(spark, [])
    path = scratch(spark, "t")
    token_files.write_tokens(none, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_files.read_tokens(spark, path).count() == 0
    assert token_counts(none, public_tokenizers.path("piece_bpe_32k.model")).count() == 0
    assert packing.pack(packing.token_pieces(none, public_tokenizers.path("word_bpe_49k.json"), 1)).count() == 0
