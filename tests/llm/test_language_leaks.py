import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from formloom.llm import maxent
from formloom.llm.decontaminate import decontaminate
from formloom.llm.maxent import train_and_score

from .cases import frame, key, rows


def items(rng):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([8, 14, 40]))) + ".") for i in range(12)]


def test_leaks(spark):
    rng = random.Random(5)
    bench = items(rng)
    data, want = rows(n=20), set()
    for k in range(60):
        i, x = rng.choice(bench)
        y = list(x)
        if len(x) > 100 and k % 2:
            p = rng.randrange(len(x) - 100)
            y = list(x[p:p + 100])
        for _ in range(rng.randint(0, int(.08 * min(100, len(x))))):
            p = rng.randrange(len(y))
            o = rng.randrange(3)
            if o == 0:
                y[p] = rng.choice("abcdxyz")
            elif o == 1:
                del y[p]
            else:
                y.insert(p, rng.choice("qwxz"))
        data.append((1000 + k, f"zz yy {k} " * 9 + "".join(y).upper().replace(" ", " \n ") + " end", "en"))
        want.add((1000 + k, i))
    docs = frame(spark, data)
    table = spark.createDataFrame([*bench, (50, None), (51, ""), (52, "short"), (None, bench[0][1])], "item_id long, text string")
    got = decontaminate(docs, table).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.item_id is not None} == want
    text = {d: t for d, t, _ in data}
    for r in got:
        if r.edits == 0 and r.whole and r.item_id is not None:
            assert " ".join(text[r.doc_id][r.start:r.end].lower().split()) == dict(bench)[r.item_id]
    blocks = decontaminate(docs, table, block_chars=500).collect()
    assert sorted((tuple(r) for r in blocks), key=key) == sorted((tuple(r) for r in got), key=key)


def test_maximum_entropy(spark):
    rng = random.Random(6)
    follow = {w: [f"{w}{i}" for i in range(3)] for w in "abcdef"}
    data = rows(n=20)
    for i in range(300):
        out = []
        for _ in range(30):
            w = rng.choice("abcdef")
            out += [w, rng.choice(follow[w])]
        data.append((2000 + i, " ".join(out), "en"))
    got = train_and_score(frame(spark, data)).collect()

    def tokens(t):
        return (t or "").encode().lower().split() + [None]
    counts = Counter()
    for d, t, _ in data:
        if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t, _ in data:
        w = tokens(t)
        want.append((d, zlib.crc32(str("" if d is None else d).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n,
                     round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 3)))
    assert sorted(((*tuple(r)[:5], round(r.base_score, 3)) for r in got), key=key) == sorted(want, key=key)
    held = [r for r in got if r.held_out and r.doc_id >= 2000]
    assert sum(r.score for r in held) > .8 * sum(r.base_score for r in held)  # the words before tell what follows
    assert all(r.score < 0 for r in got)


def test_empty(spark):
    none = frame(spark, [])
    assert train_and_score(none).count() == 0
    assert decontaminate(none, spark.createDataFrame([(1, "a benchmark item that is long enough to be searched")], "item_id long, text string")).count() == 0
    assert decontaminate(frame(spark, rows(n=8)), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_block_features_in_small_arrays():
    rng = np.random.default_rng(2)
    n = np.append(rng.integers(1, 6, 60_000), 400_000)
    tokens, words = rng.integers(0, 5000, n.sum()), rng.integers(1, 1 << 63, 5000).astype(np.uint64)
    classes = rng.integers(0, 64, 5000).astype(np.uint8)
    raw = n, tokens.astype("<u4").tobytes(), words.astype("<u8").tobytes(), classes.tobytes()
    tracemalloc.start()
    x = maxent.Batches(*raw, 8192)
    first = np.cumsum(n) - n
    for at in (np.arange(3000), np.arange(int(n.sum()) - 3000, int(n.sum()))):
        cls, features = x.of(at)
        assert (cls == classes[tokens[at]]).all()
        for i, t in enumerate(at):
            start = first[np.searchsorted(first, t, "right") - 1]
            one, two = (words[tokens[t - k]] if t - k >= start else maxent.START for k in (1, 2))
            one, two = np.array([one]), np.array([two])
            keys = maxent.mix(one + np.uint64(11)), maxent.mix(one * np.uint64(3) + maxent.mix(two)), maxent.mix(two + np.uint64(13))
            assert [int(k[0] % np.uint64(8192)) for k in keys] == features[:, i].tolist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 * n.sum()


@pytest.mark.parametrize("size", [200, 1 << 18])
def test_blocks_do_not_depend_on_the_hashed_parts(monkeypatch, size):
    texts = [" ".join(f"w{i * k % 37}" for k in range(30)) for i in range(40)] + ["", "\n"]
    raw = [maxent.ascii_lower(t) for t in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    parts = [[t.encode() for t in b.column(0).to_pylist()] for b in maxent.slices([batch], "text", size=size)]
    assert len(parts) > 1 or size > 200
    for f in (lambda x: maxent.word_hashes(x)[0], lambda x: maxent.word_hashes(x)[1], lambda x: maxent.tails(x, 24)):
        assert np.array_equal(np.concatenate([f(p) for p in parts]), f(raw))


def test_sums_of_runs_to_the_last_bit():
    rng = np.random.default_rng(4)
    size = np.concatenate([rng.integers(1, 12, 3000), [1, 8, 9, 10, 130, 1000]])
    x = rng.normal(size=(size.sum(), 64)).astype(np.float32)
    first = np.cumsum(size) - size
    want = np.add.reduceat(x, first, axis=0)
    assert (maxent.run_sums(x, first) == want).all()
    assert (maxent.run_sums(x[:1], first[:1]) == x[:1]).all()


def test_probabilities():
    rng = np.random.default_rng(6)
    for classes in (64, 30, 7):
        w, b, f = rng.normal(size=(50, classes)), rng.normal(size=classes), rng.integers(0, 50, (3, 90))
        x = np.exp(w[f].sum(axis=0) + b)
        assert np.allclose(maxent.probabilities(f, w.astype(np.float32), b.astype(np.float32)), x / x.sum(axis=1, keepdims=True), atol=1e-5)
