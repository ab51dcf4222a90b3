"""Jaccard join of documents over word shingles, size-aware: subsets for small sets, inverted lists for large ones.

Documents with equal sets are one class from the start; links are found between classes.

* Light: two sets of sizes a and b link when they share ``o = ceil(t * (a + b) / (1 + t))`` elements. For pairs of small sets every subset
  of ``o`` elements is a key, marked with the two sizes; equal keys are links, nothing is left to verify.
* Heavy: all other pairs share an element among the first ``n - ceil(t * n) + 1`` of each set in one order of all elements
  (rarer ones first, by counts over all documents in a table of fixed size). Inverted lists of these elements are
  scanned. First every class is held against one head of its lists, so groups of near copies fall
  together in work linear in their size; then pairs that are still apart and share enough of their first elements are counted, those whose
  count and rest cannot reach ``o`` leave, and the others are verified on their whole sets. Every class carries the parities of its elements in
  ``PARITIES`` hash cells: the cells in which two sets differ are no more than the elements in which they differ, so of the pairs still apart those
  with too many of them leave before anything is counted or sent. No pair is left out: each pair that
  can link was verified or already is in one component.
* The boundary is the size with the least cost by the histogram of small sizes: rows of subsets below, rows of lists above.

A class is named by a 64-bit hash of its set, and shingles are 64-bit hashes. Null and empty texts have an empty set and link with
nothing: their component is their own doc_id. Ids may be null or repeat: each row counts by its text, and a
component is named by its smallest id that is not null. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.session import cut, small_side

from .common import arrow_schema, ascii_lower, mix, record, shingle_sets, slices, two
from .graph import components

CELLS, CHUNK = 1 << 20, 1 << 14
LARGEST_SMALL = 20


def enough(a, b, t: int = 80):
    """The least overlap of linked sets: 100 * i >= t * (a + b - i)."""
    return -(-t * (a + b) // (100 + t))


def kept_by_any(n, t: int = 80):
    """The least overlap of a set of size n with any that it links with."""
    return -(-t * n // 100)


def subset_sizes(n: int, largest: int, t: int = 80):
    """(other size, subset size) for every size of a small partner that is not bound to be equal."""
    for m in range(max(1, kept_by_any(n, t)), min(largest, 100 * n // t) + 1):
        o = enough(n, m, t)
        if o <= min(n, m) and not (o == n == m):
            yield m, o


def boundary(histogram: dict[int, int], t: int = 80, list_cost: int = 12) -> int:
    """The largest small size: least cost of subset rows up to it and list rows (``list_cost`` each, with their scan) beyond."""
    def cost(x):
        light = sum(c * sum(comb(n, o) for _, o in subset_sizes(n, x, t)) for n, c in histogram.items() if n <= x)
        lists = sum(c * (n - kept_by_any(n, t) + 1) for n, c in histogram.items() if 100 * n > t * x)
        return light + list_cost * lists
    return min(range(0, LARGEST_SMALL + 1), key=cost)


def count_cells(docs: DataFrame, size: int) -> np.ndarray:
    """How often the shingles of each hash cell occur in all documents: a table of fixed size, summed by chunks."""
    schema = "chunk int, n binary"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        total = np.zeros(CELLS, np.int64)
        for b in slices(batches, "text"):
            h, _ = shingle_sets([ascii_lower(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()], size)
            total += np.bincount((h >> np.uint64(44)).astype(np.int64), minlength=CELLS)
        if total.any():
            yield record(out, {"chunk": range(CELLS // CHUNK), "n": [c.astype("<u4" if c.max() < 1 << 32 else "<u8").tobytes()
                                                                     for c in total.reshape(-1, CHUNK)]})

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, n in zip(b.column(0).to_pylist(), b.column(1)):
                raw = n.as_py()
                one = np.frombuffer(raw, "<u4" if len(raw) == 4 * CHUNK else "<u8").astype(np.int64)
                total[chunk] = total.get(chunk, 0) + one
        yield record(out, {"chunk": list(total), "n": [x.astype("<u8").tobytes() for x in total.values()]})
    rows = docs.mapInArrow(run, schema).repartition("chunk").mapInArrow(add, schema).collect()  # 64 rows, 8 MB
    cells = np.zeros(CELLS, np.int64)
    for chunk, n in rows:
        cells[chunk * CHUNK:(chunk + 1) * CHUNK] = np.frombuffer(n, "<u8")
    return cells


def levels(cells: np.ndarray) -> np.ndarray:
    """0 for cells of usual counts, more by the power of two of what stands out: frequent elements come last."""
    usual = float(np.median(cells))
    over = np.maximum(cells - usual - 6 * np.sqrt(usual + 1), 0) / 32
    return np.minimum(np.floor(np.log2(over + 1)), 31).astype(np.uint8)


PARITIES = 256
SETS = "doc_id long, n long, cid long, tokens array<long>, small array<long>, bits array<long>"


def parities(h: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
    """Per text the parity of its number of elements in each of ``PARITIES`` hash cells, as longs."""
    cell = (mix(h ^ np.uint64(0x8EBC6AF09C88C6E3)) >> np.uint64(20)).astype(np.int64) % PARITIES
    odd = (np.bincount(text * PARITIES + cell, minlength=texts * PARITIES) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8").reshape(texts, PARITIES // 64)


def alike(a: str | Column, b: str | Column, n_a: Column, n_b: Column, t: int) -> Column:
    """No link is ruled out by the parities ``a`` and ``b``: linked sets differ in at most ``n_a + n_b - 2 * o`` elements."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    odd = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(PARITIES // 64)), F.lit(0))
    return odd <= n_a + n_b - 2 * _up(n_a + n_b, t, 100 + t)


def class_ids(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    start = np.cumsum(n) - n
    full = n > 0
    out = np.zeros(len(n), np.uint64)
    if full.any():
        out[full] = np.add.reduceat(mix(h ^ np.uint64(0xA0761D6478BD642F)), start[full])
    return mix(out + n.astype(np.uint64)).view(np.int64)


def sets(docs: DataFrame, size: int, t: int) -> DataFrame:
    """Every row with the size and class of its set, the first elements of the set, and all of them if it is small."""
    level = levels(count_cells(docs, size))
    held = docs.sparkSession.sparkContext.broadcast(level)  # 1 MB
    out = arrow_schema(docs.sparkSession, SETS)

    def run(batches):
        for b in slices(batches, "text"):
            rows = b.to_pydict()
            h, n = shingle_sets([ascii_lower(x or "") for x in rows["text"]], size)
            cid = class_ids(h, n)
            order = held.value[(h >> np.uint64(44)).astype(np.int64)].astype(np.uint64) << np.uint64(50) | h >> np.uint64(14)
            text = np.repeat(np.arange(len(n)), n)
            order = order[np.lexsort((order, text))].astype(np.int64)
            start = np.cumsum(n) - n
            bits = parities(h, text, len(n))
            first = np.where(n > 0, n - kept_by_any(n, t) + 1, 0)
            yield record(out, {
                "doc_id": rows["doc_id"], "n": n, "cid": [c if k else None for c, k in zip(cid.tolist(), n.tolist())],
                "tokens": [order[s:s + f] for s, f in zip(start.tolist(), first.tolist())],
                "small": [h[s:s + k].view(np.int64) if 0 < k <= LARGEST_SMALL else None for s, k in zip(start.tolist(), n.tolist())],
                "bits": list(bits)})
    return docs.mapInArrow(run, SETS)


def light_links(classes: DataFrame, largest: int, t: int) -> DataFrame:
    """Links between small sets: a key of sizes a < b links its sets of one size with those of the other, a key of equal sizes all of its sets."""
    schema = "key long, side int, cid long"
    out = arrow_schema(classes.sparkSession, schema)

    def run(batches):
        for b in batches:
            keys, sides, cids = [], [], []
            for cid, small in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = mix(np.array(sorted(small), np.int64).view(np.uint64))
                for m, o in subset_sizes(len(own), largest, t):
                    at = np.array(list(combinations(range(len(own)), o)), np.int64)
                    tag = np.uint64(min(len(own), m) << 16 | max(len(own), m))
                    keys.append(mix(own[at].sum(axis=1) + mix(np.array([tag]))))
                    sides += [(len(own) > m) - (len(own) < m)] * len(at)
                    cids += [cid] * len(at)
            yield record(out, {"key": np.concatenate(keys).view(np.int64) if keys else [], "side": sides, "cid": cids})
    rows = classes.where((F.col("n") <= largest)).select("cid", "small").mapInArrow(run, schema)
    head = [F.min(F.when(F.col("side") == -k, F.col("cid"))).alias(f"h{k + 1}") for k in (-1, 0, 1)]  # of the other side
    heads = rows.groupBy("key").agg(*head)
    other = F.when(F.col("side") == -1, F.col("h0")).when(F.col("side") == 0, F.col("h1")).otherwise(F.col("h2"))
    return rows.join(heads, "key").select(other.alias("a"), F.col("cid").alias("b")).where("a != b").distinct()


def verified(pairs: DataFrame, reps: DataFrame, docs: DataFrame, size: int, t: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets link. The sets of the pairs' classes come from their texts once more.

    Pairs meet under ``b``; a ``b`` with many partners is dealt out to several tasks, each with its set.
    """
    pairs = cut(pairs)
    salts = pairs.groupBy("b").agg(F.ceil(F.count("*") / 256).alias("k"))
    own = pairs.join(salts, "b").select(F.col("a").alias("cid"), "b", F.pmod(F.xxhash64("a"), "k").alias("salt"), F.lit(1).alias("role"))
    heads = salts.select(F.col("b").alias("cid"), "b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("salt"), F.lit(0).alias("role"))
    wanted = own.unionByName(heads).join(reps.select("cid", "rep"), "cid").select(F.col("rep").alias("own"), "cid", "b", "salt", "role")
    wanted = small_side(wanted)
    rows = docs.join(wanted, docs.doc_id.eqNullSafe(wanted.own)).select("text", "cid", "b", "salt", "role")
    schema = "cid long, b long, salt long, role int, elements binary"
    out = arrow_schema(docs.sparkSession, schema)

    def build(batches):
        for part in slices(batches, "text"):
            got = part.to_pydict()
            h, n = shingle_sets([ascii_lower(x or "") for x in got["text"]], size)
            end, cid = np.cumsum(n), class_ids(h, n)
            keep = [i for i, c in enumerate(got["cid"]) if n[i] and cid[i] == c]  # an id may have several texts
            yield record(out, {k: [got[k][i] for i in keep] for k in ("cid", "b", "salt", "role")}
                         | {"elements": [h[end[i] - n[i]:end[i]].tobytes() for i in keep]})
    link = "a long, b long"
    link_out = arrow_schema(docs.sparkSession, link)

    def test(batches):
        head, at = None, None
        for part in batches:
            a, b = [], []
            cols = [part.column(i) for i in range(4)]
            for cid, bucket, salt, role, raw in zip(*(c.to_pylist() for c in cols), part.column(4)):
                x = np.frombuffer(raw.as_buffer(), np.uint64)
                if role == 0:
                    head, at = x.copy(), (bucket, salt)
                elif at == (bucket, salt):
                    both = np.searchsorted(head, x)
                    both = int((head[np.minimum(both, len(head) - 1)] == x).sum())
                    if 100 * both >= t * (len(x) + len(head) - both):
                        a.append(cid)
                        b.append(bucket)
            yield record(link_out, {"a": a, "b": b})
    spread = rows.mapInArrow(build, schema).repartition("b", "salt").sortWithinPartitions("b", "salt", "role")
    return spread.mapInArrow(test, link).distinct()


def _up(x: Column, t: int, of: int = 100) -> Column:
    """ceil(x * t / of) of whole numbers."""
    return F.floor((x * t + of - 1) / of)


def _pairs(apart: DataFrame, t: int) -> DataFrame:
    """Pairs (a, b) that may link, of rows (token, cid, n, pos, root) that share a token and aren't in one component.

    Linked sets share k elements among the first n - o + k of each, for every k that their first elements allow; half
    of the largest k is taken. Past the last element they share there they can share no more than the shorter rest.
    """
    def side(x):
        return apart.select("token", *[F.col(c).alias(f"{c}_{x}") for c in ("cid", "n", "pos", "root", "bits")])
    n_a, n_b = F.col("n_a"), F.col("n_b")
    o = _up(n_a + n_b, t, 100 + t)
    k = F.floor((o - _up(F.greatest("n_a", "n_b"), t)) / 2) + 1
    first = (F.col("pos_a") <= n_a - o + k) & (F.col("pos_b") <= n_b - o + k)
    met = side("a").join(side("b"), "token").where(
        (F.col("cid_a") < F.col("cid_b")) & (F.col("root_a") != F.col("root_b")) & _near(n_a, n_b, t) & first
                                               & alike("bits_a", "bits_b", n_a, n_b, t))
    met = met.groupBy("cid_a", "cid_b", "n_a", "n_b").agg(
        F.count("*").alias("c"), F.max("pos_a").alias("at_a"), F.max("pos_b").alias("at_b"))
    rest = F.least(n_a - F.col("at_a"), n_b - F.col("at_b"))
    return met.where((F.col("c") >= k) & (F.col("c") + rest >= o)).select(F.col("cid_a").alias("a"), F.col("cid_b").alias("b"))


def _near(n_a: Column, n_b: Column, t: int) -> Column:
    return (100 * F.least(n_a, n_b)) >= (t * F.greatest(n_a, n_b))


def heavy_links(rows: DataFrame, reps: DataFrame, docs: DataFrame, largest: int, links: DataFrame, size: int, t: int,
                rounds: int = 2) -> DataFrame:
    """Links of pairs with a set above the boundary; ``links`` are those already known."""
    listed = rows.where(F.col("n") * 100 > t * largest).select(F.posexplode("tokens").alias("pos", "token"), "cid")
    shared = listed.groupBy("token").agg(F.min("cid").alias("x"), F.max("cid").alias("z")).where("x < z").select("token")
    once = listed.join(shared, "token").groupBy("token", "cid").agg((F.min("pos") + 1).alias("pos"))
    lists = cut(once.join(reps.select("cid", "n"), "cid"))
    for k in range(rounds + 1):
        known = components(links)
        apart = lists.join(known.withColumnRenamed("id", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
        open_lists = apart.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("z")).where("x < z").select("token")
        apart = apart.join(open_lists, "token")
        if k < rounds:
            # a head for each list and round, of one class; every class then meets the head that it shares most lists with
            pick = F.min(F.struct(F.xxhash64("cid", F.lit(k)), "cid", "n", "root"))
            heads = apart.groupBy("token").agg(pick.alias("h"))
            met = apart.join(heads, "token").where((F.col("h.root") != F.col("root")) & _near(F.col("n"), F.col("h.n"), t))
            met = met.groupBy(F.col("cid").alias("a"), F.col("h.cid").alias("b")).agg(F.count("*").alias("c"))
            best = met.groupBy("a").agg(F.max(F.struct("c", "b")).alias("m"))
            pairs = best.where(F.col("m.c") > 2).select("a", F.col("m.b").alias("b"))
        else:
            pairs = _pairs(apart.join(reps.select("cid", "bits"), "cid"), t)
        links = links.unionByName(cut(verified(pairs, reps, docs, size, t)))
    return links


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, t: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; ``t`` is the similarity in per cent."""
    docs = two(docs, id_col, text_col)
    rows = cut(sets(docs, size, t))
    full = rows.where(F.col("cid").isNotNull())
    reps = cut(full.groupBy("cid").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.first("bits").alias("bits")))
    histogram = {r[0]: r[1] for r in reps.where(F.col("n") <= LARGEST_SMALL).groupBy("n").count().collect()}  # 20 rows
    largest = boundary(histogram, t)
    small = full.where(F.col("n") <= largest).select("cid", "n", "small").dropDuplicates(["cid"])
    links = cut(light_links(small, largest, t))
    links = heavy_links(full.drop("bits"), reps, docs, largest, links, size, t)
    roots = components(links).withColumnRenamed("id", "cid")
    named = rows.select("doc_id", "n", "cid").join(roots, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = cut(named)
    names = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("name"))
    return named.join(names, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("name")).alias("component_id"))
