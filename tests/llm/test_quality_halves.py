import os
import random

import numpy as np
from formloom.llm import quality as Q

from .cases import frame, rows


def test_noise_is_not_memorised(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(150)]
    data = [(i, " ".join(rng.choice(words) for _ in range(200)), "en") for i in range(150)]
    noise = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") + (" " if i % 60 == 59 else "") for i in range(20_000))
    got = {r.doc_id: r for r in Q.quality(frame(spark, [*data, (900, noise, "en")])).collect()}
    assert not got[900].base_failed and not got[900].kept and got[900].perplexity > got[900].upper_band
    assert sum(got[i].kept for i in range(150)) > 140


def test_scores_are_the_other_half_s_model(spark):
    docs = frame(spark, rows(n=20)).select("doc_id", Q.F.coalesce("lang", Q.F.lit("")).alias("lang"), "text").withColumn("half", Q.half(Q.F.col("lang"), Q.F.col("text")))
    all_rows = docs.collect()
    model = Q.train(docs.select(Q.F.col("half").alias("lang"), "text"), 1 << 40)
    want = []
    for r in all_rows:
        g, _ = Q.grams([r.text])
        lp = Q.log_probability(model, r.half[:-1] + "10"[int(r.half[-1])], g)
        want.append((str(r.doc_id), r.lang, len(g), float(lp.sum())))
    got = [(str(r.doc_id), r.lang, r.n_grams, r.log_sum) for r in Q.score(docs.drop("half"), rows=4).collect()]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:3] == b[:3] and np.isclose(a[3], b[3], rtol=1e-4)


def test_texts_are_shuffled_once_and_not_copied(spark, monkeypatch):
    """No scratch table holds the texts, both readers of the blocks share a shuffle, and blocks grow with the bytes, not with the rows."""
    docs = frame(spark, [(i % 50, f"line {i} of some words {i * i}", "en") for i in range(9000)]).select("doc_id", "lang", "text")
    made, was = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: made.append(df.columns) or was(df))
    assert Q.block_count(docs, 1 << 17) == 1 and Q.block_count(docs, 1000) == 9
    got = Q.score(docs)
    assert len(got.collect()) == 9000 and made and not any("text" in c for c in made)
    assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()


def test_few_tasks_count(spark, monkeypatch):
    """A table of many small partitions is counted by one task a core, so that its 5-grams are not shuffled once for each of them."""
    docs = frame(spark, [(i, f"line {i} of some words {i * i}", "en") for i in range(400)]).select("doc_id", "lang", "text").repartition(64)
    seen, was = [], Q.count_grams
    monkeypatch.setattr(Q, "count_grams", lambda df: seen.append(df.rdd.getNumPartitions()) or was(df))
    assert Q.score(docs).count() == 400
    assert seen and seen[0] <= spark.sparkContext.defaultParallelism


def test_texts_travel_packed(spark):
    """Blocks hold many rows to a compressed piece, so the shuffle of the texts is smaller than they are; every row comes back once."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    data = [(i % 290, None if i % 100 == 7 else " ".join(rng.choice(words) for _ in range(200)), None if i % 3 else "en") for i in range(300)]
    docs = frame(spark, [*data, (None, "", "fr"), (None, "x" * 70_000, "fr")]).select("doc_id", "lang", "text")
    docs = docs.withColumn("half", Q.half(Q.F.col("lang"), Q.F.col("text"))).withColumn("block", Q.F.col("doc_id") % 3)
    docs = docs.fillna(1, ["block"]).repartition(2)
    for held in (1 << 14, Q.HELD):
        pieces = Q.packed(docs, held).collect()
        back = [(p.block, *r.values()) for p in pieces for b in Q.unpacked([Q.pa.scalar(bytes(p.data))]) for r in b.to_pylist()]
        assert sorted(back, key=str) == sorted(((r.block, r.doc_id, r.lang, r.half, r.text) for r in docs.collect()), key=str)
    assert len(pieces) <= 6 and 2 * sum(len(p.data) for p in pieces) < sum(len(t or "") for _, t, _ in data)
    plan = Q.score(docs.select("doc_id", "lang", "text"))._jdf.queryExecution().optimizedPlan().toString()
    dealt = [x for x in plan.split("\n") if "RepartitionByExpression [block" in x]
    assert dealt and "MapInArrow" in plan and all("text" not in x for x in dealt)


def test_the_counts_are_gone_when_texts_move(spark, monkeypatch):
    """Only the probabilities are still in the scratch folder when the texts are shuffled."""
    docs = frame(spark, [(i, f"line {i} of some words {i * i}", "en") for i in range(60)]).select("doc_id", "lang", "text")
    made, was = [], Q.cut
    monkeypatch.setattr(Q, "cut", lambda df: made.append(was(df)) or made[-1])
    got = Q.score(docs)
    folders = [x.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0].replace("//", "") for x in made]
    assert len(folders) > 5 and [os.path.isdir(x) for x in folders] == [False] * (len(folders) - 1) + [True]
    assert got.count() == 60
