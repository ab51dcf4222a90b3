import math
from itertools import permutations

import numpy as np

from formloom.llm import filter_audit as A

from .cases import frame, rows

COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def failed(text):
    words = (text or "").encode().split()
    out = "A" if len(words) < 100 else ""
    out += "B" if 100 * len(set(words)) < 80 * len(words) else ""
    out += "C" if 100 * sum(65 <= ord(c) <= 90 for c in text or "") > 10 * len(text or "") else ""
    return out + ("D" if set("#$%&*|") & set(text or "") else "")


def brute(data, marks):
    """Every order run filter by filter over the documents themselves."""
    first = {}
    for d, t, _ in data:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    docs = [(p or "", failed(t) + ("E" if d is not None and d > first[t or ""] else ""), *marks.get(d, (False, False))) for d, t, p in data]
    out = {}
    for part in {p for p, *_ in docs}:
        own, total = [x[1:] for x in docs if x[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x[0] for x in own) - len(gone), sum(x[0] == f for x in own),
                                                  sum(x[1] for x in gone), sum(x[2] for x in gone)]
        for k in out:
            if k[0] == part:
                out[k].append(total[k[1][k[2] - 1]])
    return out


def test_audit(spark):
    data = rows(3, 150) + [(200 + i, "Word " * i + "#" * (i % 3) + "AB C" * (i % 5), "de") for i in range(80, 120)]
    data += [(300, "THE SAME", ""), (301, "THE SAME", None), (301, "THE SAME", "en"), (None, "THE SAME", "en")]
    marks = [(d, d % 2, int(d % 3 == 0)) for d in range(0, 320, 2)] + [(301, 0, 0), (301, 1, None), (None, 1, 1), (4, None, None)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("mask", A.F.lit("x"))
    got = A.filter_audit(frame(spark, data), labels).collect()
    good = {d: (any(x[0] == d and x[1] == 1 for x in marks), any(x[0] == d and x[2] == 1 for x in marks)) for d, *_ in marks if d is not None}
    want = brute(data, good)
    assert {(r.part, r.filter_order, r.step): list(r)[3:] for r in got} == want
    assert len(got) == len(want) and got[0].__fields__ == COLUMNS


def test_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.filter_audit(frame(spark, []), labels).collect() == []
    alone = A.filter_audit(frame(spark, [(None, None, None)]), labels).collect()
    assert len(alone) == 600 and {r.part for r in alone} == {""} and sum(r.removed for r in alone) == 120


def test_walk_of_other_sizes():
    rng = np.random.default_rng(1)
    for k in (1, 2, 3, 6):
        masks, counts = rng.integers(0, 1 << k, 20), rng.integers(0, 9, (20, 3))
        want = [counts[(masks & s) == 0].sum(axis=0).tolist() for s in range(1 << k)]
        states = A.gray_walk(masks, counts, k)
        assert states.tolist() == want
        if k < 5:
            table = A.order_table(states, "ABCDEF"[:k])
            assert len(table["step"]) == k * math.factorial(k)
            assert sum(table["removed"]) == math.factorial(k) * (want[0][0] - want[-1][0])
