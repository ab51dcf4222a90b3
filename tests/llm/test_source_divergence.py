import random
import re
from collections import Counter

import numpy as np
import pytest

from formloom.llm import source_divergence as D

from .cases import CLASH, rows

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(data, least=10, top=10):
    """(text, lang, source) rows: every kept term of every pair, with plain integers."""
    data = [(t or "", lang or "", s or "") for t, lang, s in data]
    out = []
    for lang in {x[1] for x in data}:
        docs = [(s, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in TERM.findall(t)]) for t, own, s in data if own == lang]
        seen = Counter(w for _, ws in docs for w in set(ws))
        keep = {w for w, k in seen.items() if k >= least}
        count = {s: Counter() for s, _ in docs}
        for s, ws in docs:
            count[s].update(w for w in ws if w in keep)
        whole = sum(count.values(), Counter())

        def p(c, w):
            return 1 + 10**9 * (c[w] + 2) // (sum(c.values()) + 2 * len(keep))

        def f(x, y):
            return (x - y) ** 2 // (x + y)
        for s, c in count.items():
            pairs = [(-sum(f(p(c, w), p(o, w)) for w in keep), i.encode()) for i, o in count.items() if i != s]
            best = [(-f(p(c, w), p(whole, w)), w.encode()) for w in keep if c[w] and p(c, w) > p(whole, w)]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(found, 1)]
    return sorted(out)


def table(spark, data):
    """Rows (text, lang, source), among columns with names that the operator also uses."""
    names = [c.split()[0] for c in CLASH.split(", ")] + ["term", "tile", "total", "v"]
    types = CLASH + ", term int, tile string, total long, v long"
    full = [(*x, *[7 if "long" in c or "int" in c else "z" for c in types.split(", ")]) for x in data]
    return spark.createDataFrame(full, f"text string, lang string, source string, {types}").repartition(3).select(*names, "source", "lang", "text")


def some(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("aBcdéß日") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    data = [(" ".join(rng.choices(words[:rng.randint(20, 60)], k=rng.randint(0, 40))) + rng.choice(["", " 12-Ab_c\x7f", "\x00É"]),
             rng.choice(["en", "en", "en", "de", None, ""]), rng.choice(["a", "b", "a1", "Ä", None, "z"])) for _ in range(150)]
    return data + [(t, lang, "long" if len(t or "") > 9000 else "s") for _, t, lang in rows(seed)] + [(None, "lone", "x"), ("", "lone", "y"), ("few words", "lone", "x"), ("only", "one", "source")]


@pytest.mark.parametrize("tile,block,gathered", [(256, 50_000, 200_000), (2, 15, 40)])
def test_divergence(spark, monkeypatch, tile, block, gathered):
    monkeypatch.setattr(D, "TILE", tile)
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "GATHERED", gathered)
    data = some(5)
    got = D.divergence(table(spark, data))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute(data)


def test_bounds(spark):
    data = [("rare often", "en", "a")] * 3 + [("often", "en", "b")] * 7
    assert {r.item for r in D.divergence(table(spark, data)).where("part = 'term'").collect()} <= {"often"}
    assert sorted(map(tuple, D.divergence(table(spark, data), least=3, top=1).collect())) == brute(data, 3, 1)
    assert D.divergence(table(spark, [])).collect() == []


def test_shares_of_huge_counts(spark):
    n, total = [0, 5, 10**12, 9 * 10**14, 4 * 10**15], [3, 7 * 10**9, 3 * 10**12 + 1, 9 * 10**15 - 1, 9 * 10**15 - 1]
    want = [1 + 10**9 * (a + 2) // b for a, b in zip(n, total)]
    assert D.shares(np.array(n), np.array(total)).tolist() == want
    df = spark.createDataFrame(list(zip(n, total)), "n long, total long")
    assert [r[0] for r in df.select(D.share(D.F.col("n"), D.F.col("total"))).collect()] == want
