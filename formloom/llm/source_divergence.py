"""How far the sources of a language are from each other and from the language, term by term.

``bytes.translate`` lowers A-Z and blanks every separator in one pass, ``bytes.split`` yields the terms and a ``Counter`` per
document their frequencies; each task folds them per (language, source) before the shuffle. A language keeps the terms that
stand in at least ``least`` of its documents. Shares are integers in billionths, smoothed by two, and so are all sums: no rounding.

For two sources the divergence over all kept terms is that of a term in neither, times all terms, plus the differences of
the terms that one of them has. So only counted terms are visited: they are dealt by hash into blocks, the sources of a
language into tiles, and a task adds up one block for one pair of tiles. No task holds a language or a source.

Null texts, languages and sources count as empty strings; empty texts give their group without terms. Texts of any length are read whole; the terms
gathered in a task are passed on whenever there are many. Equal rows and equal ids are documents of their own. Ties
are ordered by the bytes of the item, which is unique in its group. An empty table gives no rows, a language without kept terms a divergence
of 0. Only text, language and source are read, under names of our own, so further columns can't clash.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formloom.session import cut, small_side

from .common import arrow_schema, record, slices

#: Bytes of a term stay, A-Z lowered; all others are blanks. The class is [^\x00-\x40\x5B-\x60\x7B-\x7F].
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
BILLION = 1_000_000_000
#: Counted terms that a task gathers before it passes them on; entries of a block; sources of a tile.
GATHERED, BLOCK, TILE = 200_000, 50_000, 256


def terms(text: bytes) -> Counter:
    """How often each term stands in a document."""
    return Counter(text.translate(TABLE).split())


def term_counts(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents with the term. Every group has a row, with term null."""
    def named(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(text_col).alias("text"))
    schema = "lang string, source string, term string, n long, docs long"
    out = arrow_schema(docs.sparkSession, schema)

    def flush(groups):
        for (lang, source), (n, seen) in groups.items():
            keys = [*n, None]
            yield record(out, {"lang": [lang] * len(keys), "source": [source] * len(keys), "term": pa.array(keys, pa.binary()).cast(pa.string()),
                               "n": [*n.values(), 0], "docs": [*(seen[k] for k in n), 0]})

    def run(batches):
        groups, size = {}, 0
        for b in slices(batches, "text"):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source")), b.column("text").cast(pa.binary()).to_pylist()):
                n, seen = groups.setdefault((lang, source), (Counter(), Counter()))
                found, size = terms(text or b""), size - len(n)
                n.update(found)
                seen.update(found.keys())
                size += len(n)
                if size > GATHERED:
                    yield from flush(groups)
                    groups, size = {}, 0
        yield from flush(groups)
    return own.mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """``1 + floor(10^9 * (n + 2) / total)`` by long division in base 1000, which no count overflows."""
    rest, out = n + 2, F.lit(1).cast("long")
    for unit in (1_000_000, 1000, 1):
        out = out + F.call_function("div", rest * 1000, total) * unit
        rest = (rest * 1000) % total
    return out


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """:func:`share` in numpy."""
    rest, out = n + 2, np.ones(np.broadcast(n, total).shape, np.int64)
    for unit in (1_000_000, 1000, 1):
        out += rest * 1000 // total * unit
        rest = rest * 1000 % total
    return out


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def tile_sums(a: np.ndarray, b: np.ndarray, entries_a: tuple, entries_b: tuple, terms_of_all: int) -> np.ndarray:
    """Sum of ``gap`` for every source of one tile against every source of another.

    ``entries``: source, term and share of the counted terms, ordered by source. ``a``, ``b``: the share of a term that a
    source has not. ``terms_of_all`` terms that neither has are added; terms of a source stand for themselves instead.
    """
    (s_a, t_a, p_a), (s_b, t_b, p_b) = entries_a, entries_b
    out = np.zeros((len(a), len(b)), np.int64)
    starts = np.searchsorted(s_a, np.arange(len(a) + 1))
    width = int(max(t_a.max(initial=-1), t_b.max(initial=-1))) + 1
    row, has = np.empty(width, np.int64), np.zeros(width, bool)
    for g in range(len(a)):
        none = gap(a[g], b)
        t, p = t_a[starts[g]:starts[g + 1]], p_a[starts[g]:starts[g + 1]]
        row[:] = a[g]
        row[t], has[t] = p, True
        # what b has, whether or not g has it too; then what g has, without what both have
        change = gap(row[t_b], p_b) - none[s_b]
        both = has[t_b]
        change[both] -= gap(row[t_b[both]], b[s_b[both]]) - none[s_b[both]]
        np.add.at(out[g], s_b, change)
        step = max(1, (1 << 20) // max(len(b), 1))
        for at in range(0, len(t), step):
            out[g] += (gap(p[at:at + step, None], b[None, :]) - none).sum(axis=0)
        out[g] += terms_of_all * none
        has[t] = False
    return out


def pair_sums(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    ``kept``: (lang, source, term, n); ``groups``: (lang, source, total, v) with total null where the language keeps no term.
    """
    spark = kept.sparkSession
    sizes = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(kept.groupBy("lang").agg(F.count("*").alias("entries")), "lang", "left")
    sizes = small_side(sizes.select("lang", F.ceil(F.col("sources") / TILE).cast("int").alias("tiles"),
                                    F.greatest(F.ceil(F.coalesce("entries", F.lit(0)) / BLOCK), F.lit(1)).cast("int").alias("blocks")))
    mine = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    dealt = kept.join(sizes, "lang").select("lang", "source", "term", "n", F.lit(None).cast("long").alias("total"), F.lit(0).cast("long").alias("v"),
                                            F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"), mine.alias("tile"), partner.alias("other"))
    told = groups.join(sizes, "lang").select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "total", "v", "tiles",
                                             F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    told = told.select("lang", "source", "term", "n", "total", "v", "block", mine.alias("tile"), partner.alias("other"))
    rows = dealt.unionByName(told).withColumn("low", F.least("tile", "other")).withColumn("high", F.greatest("tile", "other")).drop("other")
    schema = "lang string, source string, item string, value long"
    out = arrow_schema(spark, schema)

    def ints(column: pa.ChunkedArray) -> np.ndarray:
        return column.combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64)

    def tile(t: pa.Table, which: int, v: int) -> tuple:
        """Names, totals, shares of missing terms and the counted terms (source, term, share) of a tile's sources."""
        t = t.filter(pc.equal(t["tile"], which))
        head, body = t.filter(pc.is_null(t["term"])), t.filter(pc.is_valid(t["term"]))
        total = ints(head["total"]) if v else np.ones(len(head), np.int64)
        s = ints(pc.index_in(body["source"], head["source"].combine_chunks()))
        order = np.argsort(s, kind="stable")
        s, w, n = s[order], ints(body["word"])[order], ints(body["n"])[order]
        return head["source"].to_pylist(), shares(np.zeros(len(total), np.int64), total), (s, w, shares(n, total[s]))

    def run(t: pa.Table) -> pa.Table:
        lang, block, low, high = (t[c][0].as_py() for c in ("lang", "block", "low", "high"))
        v = pc.max(t["v"]).as_py()
        t = t.append_column("word", t["term"].combine_chunks().dictionary_encode().indices)
        (a, none_a, has_a), (b, none_b, has_b) = (tile(t, which, v) for which in (low, high))
        sums = tile_sums(none_a, none_b, has_a, has_b, v if block == 0 else 0) if v else np.zeros((len(a), len(b)), np.int64)
        source, item, value = np.repeat(np.arange(len(a)), len(b)), np.tile(np.arange(len(b)), len(a)), sums.ravel()
        if low == high:
            keep = source != item
            source, item, value = source[keep], item[keep], value[keep]
        x, y = [a[i] for i in source], [b[i] for i in item]
        if low != high:
            x, y, value = x + y, y + x, np.concatenate([value, value])
        return pa.Table.from_batches([record(out, {"lang": [lang] * len(x), "source": x, "item": y, "value": value})], schema=out)
    parts = rows.groupBy("lang", "block", "low", "high").applyInArrow(run, schema)
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, *, least: int = 10, top: int = 10, **columns: str) -> DataFrame:
    """lang, source, part, item, value and rank: ``pair`` rows of all other sources, ``term`` rows of the ``top`` terms above the language."""
    counts = cut(term_counts(docs, **columns))
    counted = counts.where(F.col("term").isNotNull())
    own = cut(counted.groupBy("lang", "term").agg(F.sum("n").alias("of_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least).drop("docs"))
    kept = cut(counted.drop("docs").join(own, ["lang", "term"]))
    langs = small_side(own.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("lang_total")))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.where(F.col("term").isNull()).select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = small_side(groups.select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), (F.coalesce("total", F.lit(0)) + 2 * F.col("v")).alias("total"),
                                      (F.col("lang_total") + 2 * F.col("v")).alias("lang_total")))
    pairs = pair_sums(kept.select("lang", "source", "term", "n"), groups.select("lang", "source", "total", "v"))
    p, q = F.col("p"), F.col("q")
    above = kept.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"),
                                                         share(F.col("of_lang"), F.col("lang_total")).alias("q"))
    above = above.where(p > q).select("lang", "source", "item", F.call_function("div", (p - q) * (p - q), p + q).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")

    def ranked(df, part):
        return df.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").unionAll(ranked(above, "term").where(F.col("rank") <= top))
