"""A hashed maximum-entropy language model, trained and scored by Spark.

Words are told by 64-bit hashes. A document's tokens are its words and one end. The probability of a token is that of its class given
the words before it, times that of the word in its class. Classes are the ``frequent`` most frequent words (a class each) and hashes of the last
two bytes for the others. The class is a softmax over weights of hashed features: the word before, the pair of words
before, and the word before that one (a skip). Within a class a word has (c + 1) / (N + V + 1) by the class's counts, so an unknown
word has a share.

1. ``write_blocks`` turns texts into blocks: token numbers of a block's own dictionary, which has word hashes and training counts. Blocks are
   written once, bucketed by block, so later jobs don't shuffle tokens.
2. Dictionary rows are shuffled by word, where counts over the corpus are summed, and go back to their blocks as ``facts``.
3. Each round takes a share of the training blocks; together the rounds see every training token once. Tasks sum residuals and
   expectations by feature and class; the sums are added by chunk, and the weights move by residual over expectation.
4. Scoring reads blocks and facts and works through each block in batches.

The driver holds the weights (``slots`` x classes) and one line for each class; nothing that grows with the corpus.
A null or empty text is an end alone. A null id counts as an empty text for the training split. Ids may repeat: each row
is scored by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import cut, scratch

from .common import arrow_schema, ascii_lower, mix, ragged, record, slices, two, word_hashes

END, START = np.uint64(1), np.uint64(2)
BLOCKS = ("block long, doc_ids array<long>, held array<boolean>, lengths array<int>, tokens binary, words binary, "
          "trained binary, tails binary")
BATCH = 1 << 15
PART = 1 << 18  # bytes of text that are hashed at a time


def tails(texts: list[bytes], tail_classes: int) -> np.ndarray:
    """A class by the last two bytes of each word (words as in ``word_hashes``)."""
    raw = np.frombuffer(b"\n\n" + b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    last = np.nonzero(~space[:-1] & space[1:])[0]
    pair = raw[last].astype(np.uint64) | np.where(space[last - 1], 0, raw[last - 1]).astype(np.uint64) << np.uint64(8)
    return (mix(pair + np.uint64(1)) % np.uint64(tail_classes)).astype(np.uint8)


def write_blocks(docs: DataFrame, tail_classes: int, size: int = 4 << 20) -> DataFrame:
    """``docs`` (doc_id, text, held) as a table of blocks, bucketed by block."""
    spark = docs.sparkSession
    out = arrow_schema(spark, BLOCKS)

    def block(number, ids, held, parts):
        h, n, t = (np.concatenate(x) for x in zip(*parts))
        n = n + 1
        ends = np.cumsum(n) - 1
        flat = np.full(len(h) + len(n), END, np.uint64)
        tail = np.zeros(len(flat), np.uint8)
        word = np.ones(len(flat), bool)
        word[ends] = False
        flat[word], tail[word] = h, t
        words, first, back, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words have small numbers
        number_of = np.empty(len(words), np.int64)
        number_of[order] = np.arange(len(words))
        tokens = number_of[back]
        train = np.repeat(~np.array(held, bool), n)
        trained = np.bincount(tokens[train], minlength=len(words))
        return record(out, {"block": [number], "doc_ids": [ids], "held": [held], "lengths": [n.astype(np.int32)],
                            "tokens": [tokens.astype("<u4").tobytes()], "words": [words[order].astype("<u8").tobytes()],
                            "trained": [trained.astype("<u4").tobytes()], "tails": [tail[first][order].tobytes()]})

    def run(batches):
        from pyspark import TaskContext
        base = TaskContext.get().partitionId() << 24
        ids, held, parts, total, number = [], [], [], 0, 0
        for b in slices(batches, "text"):
            rows = b.select(["doc_id", "held"]).to_pydict()
            ids += rows["doc_id"]
            held += rows["held"]
            for some in slices([b], "text", size=PART):  # hashing takes some hundred bytes a character of its part
                texts = [ascii_lower(t or "") for t in some.column("text").to_pylist()]
                parts.append((*word_hashes(texts), tails(texts, tail_classes)))
                total += sum(map(len, texts))
            if total >= size:
                yield block(base + number, ids, held, parts)
                ids, held, parts, total, number = [], [], [], 0, number + 1
        if ids:
            yield block(base + number, ids, held, parts)
    name = f"formloom_blocks_{uuid.uuid4().hex[:12]}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs.mapInArrow(run, BLOCKS).write.bucketBy(buckets, "block").option("path", scratch(spark, "blocks")).saveAsTable(name)
    return spark.table(name)


def dictionary(blocks: DataFrame) -> DataFrame:
    """(word, block, place, trained, tail): the dictionaries of all blocks."""
    schema = "word long, block long, place int, trained long, tail int"
    out = arrow_schema(blocks.sparkSession, schema)

    def run(batches):
        for b in batches:
            for number, words, trained, tail in zip(b.column(0).to_pylist(), b.column(1), b.column(2), b.column(3)):
                w = np.frombuffer(words.as_buffer(), "<i8")
                n, t = np.frombuffer(trained.as_buffer(), "<u4"), np.frombuffer(tail.as_buffer(), np.uint8)
                for i in range(0, len(w), 100_000):
                    part = slice(i, i + 100_000)
                    yield record(out, {"word": w[part], "block": np.full(len(w[part]), number), "place": np.arange(i, i + len(w[part])),
                                       "trained": n[part].astype(np.int64), "tail": t[part].astype(np.int32)})
    return blocks.select("block", "words", "trained", "tails").mapInArrow(run, schema)


def facts_of(rows: DataFrame, top: dict[int, int], frequent: int, buckets: int) -> DataFrame:
    """(block, counts, classes): for each block the corpus counts and classes of its words, bucketed like the blocks."""
    spark = rows.sparkSession
    schema = "block long, counts binary, classes binary"
    out = arrow_schema(spark, schema)

    def run(batches):
        at, counts, classes = None, [], []

        def done():
            return record(out, {"block": [at], "counts": [np.concatenate(counts).astype("<u8").tobytes()],
                                "classes": [np.concatenate(classes).astype(np.uint8).tobytes()]})
        words = np.array(sorted(top), np.int64)
        ranks = np.array([top[w] for w in sorted(top)], np.int64)
        for b in batches:
            block, word, c, tail = (b.column(i).to_numpy() for i in range(4))
            k = np.minimum(np.searchsorted(words, word), len(words) - 1)
            cls = np.where(words[k] == word, ranks[k], frequent + tail)
            edge = np.nonzero(np.append(True, block[1:] != block[:-1]))[0] if len(block) else []
            for i, s in enumerate(edge):
                e = edge[i + 1] if i + 1 < len(edge) else len(block)
                if at is not None and block[s] != at:
                    yield done()
                    counts, classes = [], []
                at = int(block[s])
                counts.append(c[s:e])
                classes.append(cls[s:e])
        if at is not None:
            yield done()
    dealt = rows.select("block", "word", "c", "tail", "place").repartition(buckets, "block").sortWithinPartitions("block", "place")
    made = dealt.select("block", "word", "c", "tail").mapInArrow(run, schema)
    name = f"formloom_facts_{uuid.uuid4().hex[:12]}"
    made.write.bucketBy(buckets, "block").option("path", scratch(spark, "facts")).saveAsTable(name)
    return spark.table(name)


class Batches:
    """A block with its facts. Classes and feature slots are made for some of its tokens at a time."""

    def __init__(self, lengths, tokens, words, classes, slots: int):
        self.n = np.asarray(lengths, np.int64)
        self.tokens = np.frombuffer(tokens, "<u4")
        self.classes, self.words = np.frombuffer(classes, np.uint8), np.frombuffer(words, "<u8")
        first = np.cumsum(self.n) - self.n
        self.before = np.full(len(self.tokens), 2, np.uint8)  # how many tokens its text has before a token, two at most
        self.before[first[self.n > 1] + 1] = 1
        self.before[first] = 0
        self.slots = np.uint64(slots)

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Classes, and feature slots (three rows), of the tokens ``at``."""
        one, two_ = (np.where(self.before[at] >= k, self.words[self.tokens[at - k]], START) for k in (1, 2))
        s = self.slots
        return self.classes[self.tokens[at]], np.stack(
            [mix(one + np.uint64(11)) % s, mix(one * np.uint64(3) + mix(two_)) % s, mix(two_ + np.uint64(13)) % s]).astype(np.int32)


def probabilities(f: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The probability of every class for the feature slots ``f``."""
    x = weights.take(f[0], axis=0)
    x += weights.take(f[1], axis=0)
    x += weights.take(f[2], axis=0)
    x += bias
    top = x
    while top.shape[1] % 2 == 0:  # by halves: rows are short
        top = np.maximum(*np.split(top, 2, axis=1))
    x -= top.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def run_sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``np.add.reduceat(x, first)`` to the last bit: it is slow over many short runs, which are added side by side here."""
    size = np.diff(np.append(first, len(x)))
    out = x.take(first, axis=0)
    long = np.flatnonzero(size > 8)  # from here on it adds in another order
    own = np.flatnonzero((size > 1) & (size <= 8))
    rest, left, k = x.take(first[own] + 1, axis=0), np.arange(len(own)), 2
    while len(left := left[size[own[left]] > k]):
        rest[left] += x.take(first[own[left]] + k, axis=0)
        k += 1
    out[own] += rest
    if len(long):
        n = size[long]
        out[long] = np.add.reduceat(x.take(ragged(first[long], n), axis=0), np.cumsum(n) - n, axis=0)
    return out


def gradient(blocks: DataFrame, weights: np.ndarray, bias: np.ndarray, chunks: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Observed less expected, and expected, by slot and class, over the training documents of ``blocks``."""
    spark = blocks.sparkSession
    held = spark.sparkContext.broadcast((weights, bias))
    schema = "chunk int, g binary, e binary"
    out = arrow_schema(spark, schema)

    def run(batches):
        w, b0 = held.value
        g, e = np.zeros(w.shape, np.float32), np.zeros(w.shape, np.float32)
        some, small = False, np.uint16 if len(w) <= 1 << 16 else np.int32
        for b in batches:
            for i in range(b.num_rows):
                lengths, hold, tokens, words, classes = (b.column(j)[i] for j in range(5))
                x = Batches(lengths.as_py(), tokens.as_buffer(), words.as_buffer(), classes.as_buffer(), len(w))
                train = np.nonzero(np.repeat(~np.array(hold.as_py(), bool), x.n))[0]
                some |= bool(len(train))
                for k in range(0, len(train), BATCH):
                    cls, features = x.of(train[k:k + BATCH])
                    p = probabilities(features, w, b0)
                    for f in features:
                        order = np.argsort(f.astype(small), kind="stable")  # 16 bits: a radix sort
                        sorted_ = f[order]
                        first = np.nonzero(np.append(True, sorted_[1:] != sorted_[:-1]))[0]
                        e[sorted_[first]] += run_sums(p.take(order, axis=0), first)
                    g += np.bincount((features.astype(np.int64) * w.shape[1] + cls).ravel(), minlength=w.size).reshape(w.shape)
        if some:
            g -= e
            yield record(out, {"chunk": range(chunks), "g": [c.tobytes() for c in np.split(g, chunks)],
                               "e": [c.tobytes() for c in np.split(e, chunks)]})

    def add(batches):
        total: dict[int, list] = {}
        for b in batches:
            for chunk, g, e in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                x = [np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) for v in (g, e)]
                total[chunk] = [p + q for p, q in zip(total[chunk], x)] if chunk in total else x
        yield record(out, {"chunk": list(total), "g": [x[0].tobytes() for x in total.values()], "e": [x[1].tobytes() for x in total.values()]})
    parts = blocks.select("lengths", "held", "tokens", "words", "classes").mapInArrow(run, schema)
    g, e = np.zeros(weights.shape), np.zeros(weights.shape)
    rows = len(weights) // chunks
    for chunk, a, b in parts.repartition("chunk").mapInArrow(add, schema).collect():  # the size of the weights, twice
        at = slice(chunk * rows, (chunk + 1) * rows)
        g[at], e[at] = np.frombuffer(a).reshape(rows, -1), np.frombuffer(b).reshape(rows, -1)
    return g, e


def train_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, frequent: int = 40,
                    tail_classes: int = 24, slots: int = 1 << 13, rounds: int = 4, rate: float = 0.6, prior: float = 4.0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every row.

    Documents with crc32(id as text) mod ``folds`` = ``fold`` are held out of counts and training.
    """
    spark = docs.sparkSession
    rows = two(docs, id_col, text_col).withColumn(
        "held", F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold)
    blocks = write_blocks(rows, tail_classes)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a word's rows are one for each block, so the window holds no more than there are blocks
    entries = dictionary(blocks).withColumn("c", F.sum("trained").over(Window.partitionBy("word")))
    entries = cut(entries)
    vocabulary = entries.where("trained > 0").groupBy("word").agg(F.first("c").alias("c"), F.first("tail").alias("tail"))
    vocabulary = cut(vocabulary)
    end = int(END)
    top = {r[0]: i + 1 for i, r in enumerate(vocabulary.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(frequent - 1).collect())}
    top[end] = 0
    facts = facts_of(entries, top, frequent, buckets)
    rank = F.create_map(*[F.lit(x) for kv in top.items() for x in kv])[F.col("word")]
    sums = vocabulary.groupBy(F.coalesce(rank, F.col("tail") + frequent).alias("k")).agg(F.sum("c"), F.count("*")).collect()
    classes = frequent + tail_classes
    n, v = np.zeros(classes), np.zeros(classes)
    for k, a, b in sums:
        n[k], v[k] = a, b
    bias = np.log((n + 1) / (n + 1).sum()).astype(np.float32)
    weights = np.zeros((slots, classes), np.float32)
    joined = blocks.join(facts, "block")
    for r in range(rounds):
        g, e = gradient(joined.where(F.pmod(F.xxhash64("block"), F.lit(rounds)) == r), weights, bias)
        weights += (rate * np.clip(g / (e + prior), -1, 2)).astype(np.float32)
    held = spark.sparkContext.broadcast((weights, bias, n, v))
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out = arrow_schema(spark, schema)

    def run(batches):
        w, b0, n_k, v_k = held.value
        total, distinct = n_k.sum(), v_k.sum()
        for b in batches:
            for i in range(b.num_rows):
                ids, hold, lengths, tokens, words, classes, counts = (b.column(j)[i] for j in range(7))
                x = Batches(lengths.as_py(), tokens.as_buffer(), words.as_buffer(), classes.as_buffer(), len(w))
                c = np.frombuffer(counts.as_buffer(), "<u8")[x.tokens].astype(np.float64)
                base = np.log10((c + 1) / (total + distinct + 1))
                both = np.empty(len(c))
                for k in range(0, len(c), BATCH):
                    at = np.arange(k, min(k + BATCH, len(c)))
                    cls, features = x.of(at)
                    p = probabilities(features, w, b0)
                    both[at] = np.log10((c[at] + 1) / (n_k + v_k + 1)[cls]) + np.log10(np.maximum(p[np.arange(len(p)), cls], 1e-30))
                doc = np.repeat(np.arange(len(x.n)), x.n)
                size = len(x.n)
                yield record(out, {"doc_id": ids.as_py(), "held_out": hold.as_py(), "n_tokens": x.n,
                                   "n_known": np.bincount(doc[c > 0], minlength=size), "train_tokens": np.full(size, int(total)),
                                   "base_score": np.bincount(doc, base, size), "score": np.bincount(doc, both, size)})
    return joined.select("doc_ids", "held", "lengths", "tokens", "words", "classes", "counts").mapInArrow(run, schema)
