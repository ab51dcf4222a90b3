import random
from itertools import product

import numpy as np
import pytest
import xxhash

from formloom.llm import simhash as S

from .cases import frame, key, rows
from .test_duplicates import roots


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", low) if w]
    grams = [" ".join(words[i:i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    votes = [0] * 64
    for g in grams:
        h = xxhash.xxh64(g.encode(), seed=42).intdigest()
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked(fs, bits):
    fs = np.array(fs, np.uint64)
    edges = []
    for i in range(len(fs)):
        near = np.unpackbits((fs[:i] ^ fs[i]).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= bits
        edges += [(i, int(j)) for j in np.nonzero(near)[0]]
    return roots(len(fs), edges)


def test_hash_is_sparks(spark):
    words = ["", "a", "some words of a text", "日本語", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").selectExpr("xxhash64(w)").collect()
    assert [r[0] for r in got] == [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]


def near_texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(900)]
    out = []
    for g in range(25):
        start = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 40, 150, 300]))]
        for k in range(rng.choice([1, 2, 12])):
            x = list(start)
            for _ in range(rng.choice([0, 1, 2, 6])):
                x[rng.randrange(len(x))] = rng.choice(words)
            out.append((1000 + len(out) * 7 % 997, rng.choice([" ", "\n", " \t"]).join(x).title(), "en"))
    return out


def test_near_duplicates(spark):
    data = rows(2, 80) + near_texts()
    got = S.near_duplicates(frame(spark, data)).collect()
    fs = [brute_fingerprint(t) for _, t, _ in data]
    root, name = linked(fs, 4), {}
    for i, (d, _, _) in enumerate(data):
        if d is not None:
            name[root[i]] = min(name.get(root[i], 1 << 60), d)
    want = [(d, f"{fs[i]:016x}", name.get(root[i])) for i, (d, _, _) in enumerate(data)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert got[0].__fields__ == ["doc_id", "fingerprint", "component_id"]
    assert S.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("seed,bits", [(1, 4), (3, 2)])
def test_components_of_fingerprints(spark, seed, bits):
    """Random fingerprints, chains of single flips, dense groups around a centre and groups just beyond the bound."""
    rng = random.Random(seed)
    fs = {0, (1 << 64) - 1, *(rng.getrandbits(64) for _ in range(300))}
    skewed = rng.getrandbits(64)
    fs |= {skewed ^ (rng.getrandbits(64) & rng.getrandbits(64) & rng.getrandbits(64)) for _ in range(300)}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(40):
            fs.add(f)
            for b in rng.sample(range(64), rng.choice([1, bits, bits, bits + 1])):
                f ^= 1 << b
    centre = rng.getrandbits(64)
    for _ in range(250):
        f = centre
        for b in rng.sample(range(64), rng.randint(0, bits)):
            f ^= 1 << b
        fs.add(f)
    fs = sorted(fs)
    root = linked(fs, bits)
    got = {r.f: r.root for r in S.fingerprint_components(spark.createDataFrame([(signed(f),) for f in fs], "f long"), bits).collect()}
    groups, theirs = {}, {}
    for f, r in zip(fs, root):
        groups.setdefault(r, set()).add(signed(f))
    for f, r in got.items():
        theirs.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, theirs.values()))
    assert all(r in g for r, g in theirs.items())


def test_thresholds_cost_least():
    rng = np.random.default_rng(5)
    for m, bits in product((1, 2, 3, 5), (2, 4)):
        if m <= bits + 1:
            costs = [np.cumsum(rng.random((bits + 1, 30)), axis=0) for _ in range(m)]
            t, least = S.allocate(costs, bits - m + 1)
            assert (t.sum(axis=0) == bits - m + 1).all() and t.min() >= -1
            for i in range(30):
                every = [sum(c[x, i] for c, x in zip(costs, p) if x >= 0) for p in product(range(-1, bits + 1), repeat=m) if sum(p) == bits - m + 1]
                assert abs(min(every) - least[i]) < 1e-9
                assert abs(sum(c[x, i] for c, x in zip(costs, t[:, i]) if x >= 0) - least[i]) < 1e-9


def test_parts_and_shells(spark):
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, (500, 64))
    base[:, 40] = base[:, 3]
    base[:, 17] = 1 - base[:, 3]
    f = np.packbits(base.astype(np.uint8), axis=1, bitorder="little").view("<i8").ravel()
    nodes = spark.createDataFrame([(int(x),) for x in f], "f long")
    both = S.together(nodes)
    assert (both == base.T @ base).all()
    for m in (2, 3, 4, 5):
        parts = S.grouped_bits(both, 500, m)
        assert sorted(b for p in parts for b in p) == list(range(64)) and max(map(len, parts)) - min(map(len, parts)) <= 1
        assert any({3, 17, 40} <= set(p) for p in parts)
        for p in parts:
            assert [int("".join(str(base[i, b]) for b in reversed(p)), 2) for i in range(20)] == S.value_of(f[:20], p).tolist()
    h = rng.integers(0, 5, 32)
    near = S.shells(h, 3)
    assert all(near[d, v] == sum(h[x] for x in range(32) if (x ^ v).bit_count() == d) for d in range(4) for v in range(32))
    exact = S.histograms(nodes, [[1, 2, 3], [40, 17]])
    assert exact[0].sum() == exact[1].sum() == 500
