import random

import numpy as np
import regex

from formloom.llm import jaccard, lines, repeats
from formloom.llm.graph import components

from .cases import frame, key, rows


def roots(n, edges):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    rng.shuffle(edges)
    want = roots(300, edges)
    got = {r.id: r.root for r in components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "a long, b long")).collect()}
    assert got == {x: want[x] for e in edges for x in e if e[0] != e[1]}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard_brute(data):
    sets = [shingles(t) for _, t, _ in data]
    edges = [(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i]) if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    root, name = roots(len(data), edges), {}
    for i, (d, _, _) in enumerate(data):
        if d is not None:
            name[root[i]] = min(name.get(root[i], 1 << 60), d)
    return [(d, len(sets[i]), name.get(root[i]) if sets[i] else d) for i, (d, _, _) in enumerate(data)]


def near_rows():
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(50):
        start = [rng.choice(words) for _ in range(rng.choice([1, 3, 4, 5, 8, 9, 10, 12, 15, 18, 22, 25, 40, 120]))]
        for _ in range(rng.choice([1, 2, 3, 8])):
            x = list(start)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                x[rng.randrange(len(x)) if rng.random() < .5 else -1] = rng.choice(words)
            out.append((len(out) * 3 % 997, " ".join(x + [rng.choice(words) for _ in range(rng.choice([0, 0, 1, 3]))]), "en"))
    family = [rng.choice(words) for _ in range(150)]
    for k in range(80):
        x = list(family)
        for _ in range(rng.randint(1, 4)):
            x[rng.randrange(150)] = rng.choice(words)
        out.append((2000 + k, " ".join(x).upper() if k % 7 == 0 else " ".join(x), "en"))
    return out + rows()


def test_jaccard(spark):
    data = near_rows()
    got = [tuple(r) for r in jaccard.jaccard_components(frame(spark, data)).collect()]
    assert sorted(got, key=key) == sorted(jaccard_brute(data), key=key)


def test_boundary_follows_cost():
    assert jaccard.boundary({}) == 0
    few, many = jaccard.boundary({n: 5 for n in range(1, 21)}, list_cost=1), jaccard.boundary({n: 5 for n in range(1, 21)}, list_cost=100)
    assert few < many
    for n in range(1, 40):
        for m in range(1, 40):
            o = jaccard.enough(n, m)
            assert 100 * o >= 80 * (n + m - o) and 100 * (o - 1) < 80 * (n + m - o + 1)


def repeats_brute(data, length):
    raws = [(t or "").encode() for _, t, _ in data]
    seen: dict = {}
    for r in raws:
        for i in range(len(r) - length + 1):
            seen[r[i:i + length]] = seen.get(r[i:i + length], 0) + 1
    out = []
    for (d, _, _), r in zip(data, raws):
        gone = np.zeros(len(r) + 2, np.int8)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i + 1:i + 1 + length] = 1
        edge = np.diff(gone)
        out.append((d, len(r), tuple(zip(np.nonzero(edge == 1)[0].tolist(), np.nonzero(edge == -1)[0].tolist())),
                    bytes(r[i] for i in range(len(r)) if not gone[i + 1])))
    return out


def test_repeats(spark):
    rng = random.Random(3)
    start = "".join(rng.choice("abé") for _ in range(400))
    data = [r for r in rows(n=10) if r[0] != 106]
    for k in range(60):
        t = "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(350)
            t += start[i:i + rng.randint(5, 60)] + rng.choice(["", "x", "yy", "z" * 30, "pq" * 20])
        data.append((500 + k, t, "en"))
    for length, gram, most in ((12, 4, 50_000), (20, 5, 2)):
        got = [(r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept))
               for r in repeats.remove_repeats(frame(spark, data), length=length, gram=gram, most=most).collect()]
        assert sorted(got, key=lambda r: key(r[:2]) + [r[3]]) == sorted(repeats_brute(data, length), key=lambda r: key(r[:2]) + [r[3]])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def normal(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def some_lines():
    """Documents of 25 stock lines, most of them with copies that differ in a word."""
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    stock = []
    for _ in range(25):
        start = [rng.choice(words) for _ in range(rng.choice([2, 3, 8, 30, 60]))]
        for k in range(rng.choice([1, 3, 6])):
            x = list(start)
            if k and rng.random() < .7:
                x[rng.randrange(len(x))] = rng.choice(words)
            stock.append(" ".join(x).capitalize() + rng.choice(["", "!", " ."]))
    data = [(i % 37 if i % 8 else None, "\n".join(rng.choice(stock) for _ in range(rng.randint(0, 7))), "en") for i in range(45)]
    return data + [r for r in rows(n=8) if r[0] != 106] + [(93, f"{stock[3]}\n{stock[3]}\n  {stock[3].upper()}..", "en")]


def test_lines_by_edit_distance_alone(spark):
    """The default against groups over all pairs within 10 %: nothing else goes, and nine tenths or more of what should go."""
    data = some_lines()
    docs = frame(spark, data)
    got = {(r.doc_id, r.text) for r in lines.dedup_lines(docs).collect()}
    own = {(r.doc_id, r.text): r.k for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) k").collect()}
    places: dict = {}
    for d, t in own:
        for i, line in enumerate((t or "").split("\n")):
            if x := normal(line):
                places.setdefault(x, []).append((d is None, d or 0, own[d, t], i))
    names = sorted(places)
    edges = [(i, j) for i in range(len(names)) for j in range(i) if distance(names[i], names[j]) <= int(.1 * max(len(names[i]), len(names[j])) + 1e-9)]
    groups: dict = {}
    for name, root in zip(names, roots(len(names), edges)):
        groups.setdefault(root, []).extend(places[name])
    first = {(k, i) for g in groups.values() for _, _, k, i in sorted(g)[:1]}
    gone = {(k, i) for g in groups.values() for _, _, k, i in sorted(g)[1:]}
    n = {(d, t): len((t or "").split("\n")) for d, t in own}
    kept = {r.row: set(range(n[r.doc_id, r.old])) - set(r.gone or []) for r in
            docs.selectExpr("doc_id", "text old", "xxhash64(doc_id, text) row").distinct().join(lines.removals(docs), "row", "left").collect()}
    removed = {(k, i) for (d, t), k in own.items() for i in range(n[d, t]) if i not in kept[k]}
    assert not removed & first and removed <= gone and len(removed) >= .9 * len(gone)
    assert got


def test_lines(spark):
    data = some_lines()
    docs = frame(spark, data)
    got = lines.dedup_lines(docs, whole=False).collect()
    own = {(r.doc_id, r.text): r.k for r in docs.selectExpr("doc_id", "text", "xxhash64(doc_id, text) k").collect()}
    places: dict = {}
    for d, t in own:
        for i, line in enumerate((t or "").split("\n")):
            if len((x := normal(line)).split(" ")) >= 3:
                places.setdefault(x, []).append((d is None, d or 0, own[d, t], i))
    names = sorted(places)
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in {w for n in names for w in n.split(" ")}], "w string")
              .selectExpr("w", "xxhash64(w) h").collect()}

    def simhash(name):
        w = [hashes[x] & (1 << 64) - 1 for x in name.split(" ")]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in w) > len(w))
    sims = [simhash(n) for n in names]
    edges = [(i, j) for i in range(len(names)) for j in range(i) if (sims[i] ^ sims[j]).bit_count() <= 3
             and distance(names[i], names[j]) <= int(.1 * max(len(names[i]), len(names[j])) + 1e-9)]
    groups: dict = {}
    for name, root in zip(names, roots(len(names), edges)):
        groups.setdefault(root, []).extend(places[name])
    gone = {(k, i) for g in groups.values() for _, _, k, i in sorted(g)[1:]}
    want = [(d, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (own[d, t], i) not in gone)) for d, t, _ in data]
    assert edges and sorted(((r.doc_id, r.text) for r in got), key=key) == sorted(want, key=key)


def test_blocks_cover_every_pair_within_the_bits():
    rng = random.Random(1)
    for n in (10, 10**6, 10**9):
        masks = lines.block_masks(n, 3)
        for _ in range(200):
            flipped = sum(1 << b for b in rng.sample(range(64), 3))
            assert any(not flipped & m for m in masks)


def test_empty(spark):
    none = frame(spark, [])
    assert jaccard.jaccard_components(none).count() == 0
    assert repeats.remove_repeats(none).count() == 0
    assert lines.dedup_lines(none).count() == 0


def test_simhash_of_a_very_long_line(spark):
    rng = random.Random(3)
    words = [f"w{rng.randrange(50)}" if i < 70_000 else f"v{rng.randrange(20)}" for i in range(140_000)]
    data = [(1, " ".join(words), "en"), (2, "three short words", "en")]
    docs = frame(spark, data).selectExpr("doc_id", "text", "doc_id AS row")
    got = {r.row: r.sim & (1 << 64) - 1 for r in lines.line_hashes(docs, 3).collect()}
    hashes = {r.w: r.h & (1 << 64) - 1 for r in spark.createDataFrame([(w,) for w in {w for _, t, _ in data for w in t.split()}], "w string")
              .selectExpr("w", "xxhash64(w) h").collect()}
    for d, t, _ in data:
        w = [hashes[x] for x in t.split()]
        assert got[d] == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in w) > len(w))


def test_parities_never_rule_out_a_link(spark):
    rng = np.random.default_rng(3)
    pairs = []
    for n in (3, 20, 150, 900):
        for shared in np.linspace(.6, 1, 15):
            k = int(shared * n)
            pool = rng.integers(0, 1 << 62, 2 * n - k).astype(np.uint64)
            pairs.append((pool[:n], np.concatenate([pool[:k], pool[n:]])))
    rows = []
    for a, b in pairs:
        bits = jaccard.parities(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2)
        both = len(np.intersect1d(a, b))
        rows.append((bits[0].tolist(), bits[1].tolist(), len(a), len(b), 100 * both >= 80 * (len(a) + len(b) - both)))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n long, m long, link boolean")
    got = df.select("link", "n", jaccard.alike("a", "b", df.n, df.m, 80).alias("may")).collect()
    assert all(r.may for r in got if r.link) and sum(not r.may for r in got if r.n < 200) > 10
