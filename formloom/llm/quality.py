"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity bands for each language.

The model is a character model of order five with modified Kneser-Ney smoothing, one for each language. A character is a
12-bit symbol (a code point, or a hash of a rare one), an n-gram the 60-bit word of its symbols.
Spark counts all documents: tasks fold their 5-grams, the counts of lower orders (distinct left neighbours) come
from those of the order above. No text is scored by a model that counted it: texts are dealt into two halves by their hash
(equal texts into the same one), and each half is scored by the model of the other. The model stays a Spark table with all its n-grams: the
distinct 5-grams of a half are joined to it order by order, and their probabilities go to blocks of documents of a bounded size.
(``train`` and ``log_probability`` hold a model as sorted arrays, for small corpora.)

A document's score is its mean negative log probability per character. Each language has a median, a robust spread
between documents and a variance per character; the band of a document is the median plus or minus
``width`` times the spread that a text of its length has by chance and by language. Texts below it (repetitive) and above it
(not language) are rejected.

A null text has no words and fails the base rules, as an empty one does. A null language is a language of its own. Ids may be null or
repeat: each row is judged by itself. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut, discard, small_side

from .common import SPACES, arrow_schema, mix, record, slices, words_of

ORDER, BITS, LOW = 5, 12, 3072
SYMBOLS = 1 << BITS
FEATURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_grams long, "
            "log_sum double, square_sum double")


def repeat_words(words: list[bytes], size: int = 8) -> int:
    """Words in windows of ``size`` words that the text has twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    x = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, len(words))
    if len(number) == len(words):
        return 0
    x = mix(x + np.uint64(1))
    h = np.zeros(n, np.uint64)
    for i in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[i:i + n]
    _, back, count = np.unique(h, return_inverse=True, return_counts=True)
    at = np.nonzero(count[back] > 1)[0]
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def base_rules(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = words_of(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, "#*$%&|<>")), dup,
            repeat_words(words))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-grams of all texts in a row, and how many each has: one for each character and one for the end."""
    plain = [b" ".join(words_of(t or "")).decode("utf-8", "surrogatepass").lower() for t in texts]
    code = np.frombuffer("".join("\1" * (ORDER - 1) + t + "\2" for t in plain).encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.where(code < LOW, code, LOW + (code * np.uint32(2654435761) >> np.uint32(22))).astype(np.uint64)
    n = np.fromiter(map(len, plain), np.int64, len(plain)) + 1
    if not len(s):
        return np.zeros(0, np.uint64), n
    g = s.copy()
    for k in range(1, ORDER):
        g[k:] |= s[:-k] << np.uint64(BITS * k)
    ends = np.cumsum(n + ORDER - 1)
    keep = np.ones(len(s), bool)
    for k in range(ORDER - 1):
        keep[ends - n - ORDER + 1 + k] = False
    return g[keep], n


def fold(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0] if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and how often each occurs."""
    codes = np.sort(codes)
    first = np.nonzero(np.append(True, codes[1:] != codes[:-1]))[0] if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.append(first, len(codes)))


def by_language(langs: list[str | None], n: np.ndarray):
    """Language, its rows, and which of the grams in a row are its own."""
    names = np.array([x or "" for x in langs], object)
    for lang in sorted(set(names)):
        rows = names == lang
        yield lang, rows, np.repeat(rows, n)


def count_grams(docs: DataFrame, held: int = 3_000_000) -> DataFrame:
    """(lang, code, a): the 5-grams of all documents. A task folds as it reads and lets go of ``held`` distinct ones at a time."""
    schema = "lang string, code long, a long"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        kept: dict[str, list] = {}

        def merge(lang):
            kept[lang] = [fold(np.concatenate([c for c, _ in kept[lang]]), np.concatenate([a for _, a in kept[lang]]))]

        def let_go():
            for lang in list(kept):
                merge(lang)
                codes, a = kept.pop(lang)[0]
                for i in range(0, len(codes), 200_000):
                    part = codes[i:i + 200_000]
                    yield record(out, {"lang": [lang] * len(part), "code": part.astype(np.int64), "a": a[i:i + 200_000]})
        for b in slices(batches, "text", size=2 << 20):
            rows = b.to_pydict()
            g, n = grams(rows["text"])
            for lang, _, own in by_language(rows["lang"], n):
                kept.setdefault(lang, []).append(runs(g[own]))
                if sum(len(c) for c, _ in kept[lang][1:]) > 500_000:
                    merge(lang)
            if sum(len(c) for x in kept.values() for c, _ in x) > held:
                yield from let_go()
        yield from let_go()
    return docs.select("lang", "text").mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("a").alias("a"))


def entries_of(level: DataFrame) -> DataFrame:
    """(lang, order, code, context, a, u) of all orders: discounted shares from the counts ``level`` (lang, code, a) of the highest."""
    tables = [level.withColumn("order", F.lit(ORDER))]
    for order in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.col("code").bitwiseAND((1 << BITS * order) - 1).alias("code")).agg(F.count("*").alias("a"))
        tables.append(level.withColumn("order", F.lit(order)))
    table = tables[0]
    for t in tables[1:]:
        table = table.unionByName(t)
    table = cut(table.withColumn("context", F.shiftrightunsigned("code", BITS)))
    # discounts from the counts of counts; one row for each language and order
    n = [F.sum((F.col("a") == k).cast("double")) for k in range(1, 5)]
    counts = table.groupBy("lang", "order").agg(*[x.alias(f"n{i + 1}") for i, x in enumerate(n)])
    y = F.col("n1") / F.greatest(F.col("n1") + 2 * F.col("n2"), F.lit(1.0))
    d = [F.least(F.greatest(k - (k + 1) * y * F.col(f"n{k + 1}") / F.greatest(F.col(f"n{k}"), F.lit(1.0)), F.lit(0.1)),
                 F.lit(k - 0.1)) for k in (1, 2, 3)]
    discounts = small_side(counts.select("lang", "order", *[x.alias(f"d{k + 1}") for k, x in enumerate(d)]))
    sums = table.groupBy("lang", "order", "context").agg(F.sum("a").alias("total"))
    a = F.col("a")
    u = (a - F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))) / F.col("total")
    shares = cut(table.join(discounts, ["lang", "order"]).join(sums, ["lang", "order", "context"])
                 .select("lang", "order", "code", "context", "a", u.alias("u")))
    discard(table)
    return shares


def train(docs: DataFrame, max_entries: int = 1 << 21) -> dict:
    """``{(lang, order): (codes, probabilities, contexts, back-off weights)}`` with sorted codes and contexts."""
    entries = entries_of(cut(count_grams(docs)))
    # the smallest count that fits the arrays: at most 1,000 counts of counts come to the driver
    sizes = {r[0]: r[1] for r in entries.where(F.col("order") > 2).groupBy(F.least("a", F.lit(1000))).count().collect()}
    least, total = 1, sum(sizes.values())
    while total > max_entries and least <= 1000:
        total -= sizes.get(least, 0)
        least += 1
    kept = entries.where((F.col("order") <= 2) | (F.col("a") >= least))
    weights = kept.groupBy("lang", "order", "context").agg((1 - F.sum("u")).alias("w"))
    model: dict = {}
    for name, df in (("code", kept.select("lang", "order", "code", "u")), ("context", weights)):
        got = df.select("lang", "order", F.col(name).alias("key"), F.col("u" if name == "code" else "w").cast("float").alias("v")).toArrow()
        lang, order = np.array(got["lang"].to_pylist(), object), got["order"].to_numpy()
        key, v = got["key"].to_numpy().astype(np.uint64), got["v"].to_numpy()
        for x in sorted(set(lang)):
            for k in range(1, ORDER + 1):
                own = np.nonzero((lang == x) & (order == k))[0]
                own = own[np.argsort(key[own])]
                model[x, k] = model.get((x, k), ()) + (key[own], v[own])
    return model


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, other: float) -> np.ndarray:
    """The values of sorted ``wanted`` keys; each distinct one is looked up once."""
    new = np.append(True, wanted[1:] != wanted[:-1])
    one = wanted[new]
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, one), len(keys) - 1)
    return np.where(keys[at] == one, values[at].astype(np.float64), other)[np.cumsum(new) - 1]


def log_probability(model: dict, lang: str, codes: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each 5-gram's last character."""
    if not len(codes):
        return np.zeros(0)
    one, back = np.unique(codes, return_inverse=True)
    p = np.full(len(one), 1.0 / SYMBOLS)
    for k in range(1, ORDER + 1):
        if (lang, k) not in model:
            break
        keys, u, contexts, w = model[lang, k]
        part = one & np.uint64((1 << BITS * k) - 1)
        order = np.argsort(part, kind="stable") if k < ORDER else np.arange(len(one))
        part = part[order]
        p[order] = _find(keys, u, part, 0.0) + np.maximum(_find(contexts, w, part >> np.uint64(BITS), 1.0), 1e-6) * p[order]
    return np.log(p)[back]


def half(lang, text):
    """The language with the half that the text is in."""
    return F.concat(F.coalesce(lang, F.lit("")), F.lit("\0"), F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("string"))


def probabilities(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """(lang, code, lp): the natural log of the probability of the last character of each wanted 5-gram (lang, code)."""
    p = below = None
    for k in range(1, ORDER + 1):
        own = entries.where(F.col("order") == k)
        weights = own.groupBy("lang", "context").agg((1 - F.sum("u")).alias("w"))
        part = F.col("code").bitwiseAND((1 << BITS * k) - 1)
        got = wanted.select("lang", part.alias("code")).distinct().withColumn("context", F.shiftrightunsigned("code", BITS))
        got = got.join(own.select("lang", "code", "u"), ["lang", "code"], "left").join(weights, ["lang", "context"], "left")
        if p is None:
            got = got.withColumn("lower", F.lit(1.0 / SYMBOLS))
        else:
            got = got.withColumn("rest", F.col("code").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(p, ["lang", "rest"])
        value = F.coalesce("u", F.lit(0.0)) + F.greatest(F.coalesce("w", F.lit(1.0)), F.lit(1e-6)) * F.col("lower")
        p = cut(got.select("lang", F.col("code").alias("rest"), value.alias("lower")))
        if below is not None:
            discard(below)
        below = p
    return p.select("lang", F.col("rest").alias("code"), F.log("lower").alias("lp"))


BLOCK = 96 << 20  # bytes of text: a larger block asks for fewer probabilities, since most of its 5-grams come again
HELD = 16 << 20  # bytes of text that a task holds while it packs them


def block_count(docs: DataFrame, rows: int) -> int:
    """Blocks of ``BLOCK`` bytes and ``rows`` rows on average; a small table has a block for each core, but none under a sixth of that."""
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return max(-(-size // BLOCK), -(-n // rows), min(cores, -(-6 * size // BLOCK)), 1)


def packed(docs: DataFrame, held: int = HELD) -> DataFrame:
    """(block, data): the rows of ``docs`` (block, doc_id, lang, half, text), many to a piece of compressed Arrow data."""
    schema = "block long, data binary"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        kept, size = [], 0
        small = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))

        def let_go():
            table = pa.Table.from_batches(kept).combine_chunks().sort_by("block")
            number = table.column("block").to_numpy()
            edge = [0, *(np.nonzero(np.diff(number))[0] + 1), len(number)]
            for a, b in zip(edge, edge[1:]):
                part = table.slice(a, b - a).drop_columns("block")
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=small) as writer:
                    writer.write_table(part)
                yield record(out, {"block": [number[a]], "data": [sink.getvalue().to_pybytes()]})
            kept.clear()
        for b in slices(batches, "text"):
            kept.append(b)
            size += pc.sum(pc.binary_length(b.column("text"))).as_py() or 0
            if size > held:
                yield from let_go()
                size = 0
        if kept:
            yield from let_go()
    return docs.select("block", "doc_id", "lang", "half", "text").mapInArrow(run, schema)


def unpacked(data: pa.Array | pa.ChunkedArray):
    """The batches (doc_id, lang, half, text) of packed pieces, one piece at a time."""
    for piece in data:
        with pa.ipc.open_stream(piece.as_buffer()) as reader:
            yield from reader


def score(docs: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """doc_id, lang, the base counts and the sums of log probabilities of every document (doc_id, lang, text) by the other half's model.

    Texts are shuffled once and packed, into blocks by their hash: the list of a block's 5-grams and its scores read the same shuffle.
    """
    docs = docs.withColumn("half", half(F.col("lang"), F.col("text")))
    n = block_count(docs, rows)
    # few tasks count, one a core at least: a 5-gram leaves each of them once
    read = docs.coalesce(max(docs.sparkSession.sparkContext.defaultParallelism, n // 2))
    counts = cut(count_grams(read.select(F.col("half").alias("lang"), "text")))
    swap = F.concat(F.expr("left(lang, length(lang) - 1)"), F.when(F.col("lang").endswith("0"), "1").otherwise("0"))
    entries = entries_of(counts.select(swap.alias("lang"), "code", "a"))
    found = probabilities(counts.select("lang", "code"), entries)
    discard(counts, entries)  # before the texts move, which take the most room
    of = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(n).cast("long"))
    blocks = packed(docs.withColumn("block", of)).repartition("block")
    made = arrow_schema(docs.sparkSession, "block long, lang string, code long")
    out = arrow_schema(docs.sparkSession, f"doc_id long, lang string, {FEATURES}")

    def distinct(batches):
        at, kept = None, {}

        def merge(lang):
            kept[lang] = [np.unique(np.concatenate(kept[lang]))]

        def let_go():
            for lang in kept:
                merge(lang)
                codes = kept[lang][0]
                yield record(made, {"block": np.full(len(codes), at), "lang": [lang] * len(codes), "code": codes.astype(np.int64)})
            kept.clear()
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data")):
                if block != at:
                    yield from let_go()
                    at = block
                for part in slices(unpacked([data]), "text", size=2 << 20):
                    g, n = grams(part.column("text").to_pylist())
                    for lang, _, own in by_language(part.column("half").to_pylist(), n):
                        kept.setdefault(lang, []).append(runs(g[own])[0])
                        if sum(map(len, kept[lang][1:])) > 500_000:
                            merge(lang)
        yield from let_go()

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        table = {}
        lang, code, lp = (right.column(c) for c in ("lang", "code", "lp"))
        for x in lang.unique().to_pylist():
            own = pc.equal(lang, x)
            c, v = (y.filter(own).to_numpy() for y in (code, lp))
            c, first = np.unique(c.astype(np.uint64), return_index=True)
            table[x] = c, v[first]
        done = []
        for b in slices(unpacked(left.column("data")), "text", size=2 << 20):
            got = b.to_pydict()
            g, n = grams(got["text"])
            lp = np.zeros(len(g))
            for x, _, own in by_language(got["half"], n):
                c, v = table[x]
                one, back = np.unique(g[own], return_inverse=True)
                lp[own] = v[np.searchsorted(c, one)][back]
            doc = np.repeat(np.arange(len(n)), n)
            base = np.array([base_rules(t) for t in got["text"]], np.int64).reshape(-1, 5)
            names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
            done.append(record(out, {"doc_id": got["doc_id"], "lang": got["lang"], "n_grams": n, "log_sum": np.bincount(doc, lp, len(n)),
                                     "square_sum": np.bincount(doc, lp * lp, len(n))} | {c: base[:, i] for i, c in enumerate(names)}))
        return pa.Table.from_batches(done, out)
    wanted = blocks.sortWithinPartitions("block").mapInArrow(distinct, "block long, lang string, code long")
    dealt = wanted.join(found, ["lang", "code"]).select("block", "lang", "code", "lp")
    return blocks.groupBy("block").cogroup(dealt.groupBy("block")).applyInArrow(
        sums, f"doc_id long, lang string, {FEATURES}")


def quality(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", width: float = 6.0) -> DataFrame:
    """Counts, base_failed, perplexity, its band and kept for every row."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.col(text_col).alias("text"))
    scored = cut(score(docs))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    scored = scored.withColumn("base_failed", failed).withColumn("x", -F.col("log_sum") / F.col("n_grams"))
    good = scored.where(~F.col("base_failed")).withColumn("near", F.round("x", 4))  # few distinct values: exact and bounded
    middle = good.groupBy("lang").agg(F.percentile("near", 0.5).alias("mid"), (
        F.sum("square_sum") / F.sum("n_grams") - F.pow(F.sum("log_sum") / F.sum("n_grams"), 2)).alias("var"))
    middle = small_side(middle)
    apart = good.join(middle, "lang").groupBy("lang").agg(F.percentile(F.round(F.abs(F.col("x") - F.col("mid")), 4), 0.5).alias("mad"))
    bands = small_side(middle.join(apart, "lang"))
    spread = width * F.sqrt(F.pow(1.4826 * F.col("mad"), 2) + F.col("var") / F.col("n_grams"))
    out = scored.join(bands, "lang", "left").withColumn("spread", spread)
    low, high = F.exp(F.col("mid") - F.col("spread")), F.exp(F.col("mid") + F.col("spread"))
    inside = F.coalesce(F.abs(F.col("x") - F.col("mid")) <= F.col("spread"), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      F.exp("x").alias("perplexity"), low.alias("lower_band"), high.alias("upper_band"),
                      (~F.col("base_failed") & inside).alias("kept"))
