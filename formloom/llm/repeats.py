"""Exact repeats of at least ``length`` bytes in a collection, by column-wise construction over aligned documents.

Every string of ``length`` bytes holds one *anchor*: its ``gram``-byte piece of least hash (the first of equals). Two equal strings have theirs at the
same place, so repeats are found among the contexts around equal anchors: the bytes that strings through the anchor can reach,
one aligned string (row) for each place. Contexts that are equal as a whole need no more: all they hold
repeats. The distinct contexts of all anchors of a slice go through the column-wise construction: round by round one symbol of
each row is added, the rows' order by reversed prefix (the collection's Burrows-Wheeler transform, column by column) and the common
lengths of neighbours are updated, and where a common length reaches ``length`` the string that ends there repeats.
The rows come in sequence from files sorted by anchor (of the shuffle); memory holds one slice of them with its order and lengths.
Anchors with more than ``most`` distinct contexts are left out of the slices: their strings are counted one by one in an aggregation.

A document's bytes are its UTF-8 text, a null text is empty; repeats never cross documents, may overlap, and count within
one document. Rows are told apart by (id, text), so ids may be null or repeat; fully equal rows are separate documents with equal
results. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

from .common import _BASE, arrow_schema, mix, ragged, record, slices, two

_NONE = 256  # the symbol outside a document: equal to nothing


class Bytes:
    """The texts of a slice in a row, with hashes of any stretch."""

    def __init__(self, texts: list[str | None]):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        n = len(self.raw)
        by, back = np.full(n + 1, _BASE, np.uint64), np.full(n + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        by[0] = back[0] = 1
        self.total = np.zeros(n + 1, np.uint64)
        salt = mix(np.arange(1, 257, dtype=np.uint64))
        np.cumsum(salt[self.raw] * np.multiply.accumulate(by)[:n], out=self.total[1:])
        self.back = np.multiply.accumulate(back)

    def hashes(self, s: np.ndarray, e: np.ndarray, salt=0) -> np.ndarray:
        return mix((self.total[e] - self.total[s]) * self.back[s] + (e - s + salt).astype(np.uint64))

    def anchors(self, length: int, gram: int) -> np.ndarray:
        """Places of the least piece of every string of ``length`` bytes, ascending."""
        n, wide = len(self.raw), length - gram + 1
        if n < length:
            return np.zeros(0, np.int64)
        at = np.arange(n - gram + 1)
        least = self.hashes(at, at + gram) >> np.uint64(32) << np.uint64(32) | at.astype(np.uint64)
        step = 1
        while 2 * step <= wide:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if step < wide:
            least = np.minimum(least[:step - wide], least[wide - step:])
        end = np.repeat(self.begin + self.size, self.size)
        inside = np.nonzero(np.arange(n - length + 1) + length <= end[:n - length + 1])[0]
        return np.unique((least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64))


ANCHORS = "anchor long, context long, row long, place int, left int, right int"


def find_anchors(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """The anchors of all documents: hash, hash of the context, row, place and what the context has on either side."""
    out = arrow_schema(rows.sparkSession, ANCHORS)
    far = length - gram

    def run(batches):
        for b in slices(batches, "text"):
            got = b.to_pydict()
            x = Bytes(got["text"])
            at = x.anchors(length, gram)
            doc = np.searchsorted(x.begin, at, "right") - 1
            left = np.minimum(at - x.begin[doc], far)
            right = np.minimum(x.begin[doc] + x.size[doc] - at, length)
            context = x.hashes(at - left, at + right, left << 20)
            yield record(out, {"anchor": x.hashes(at, at + gram).view(np.int64), "context": context.view(np.int64),
                               "row": np.array(got["row"], np.int64)[doc], "place": at - x.begin[doc], "left": left, "right": right})
    return rows.mapInArrow(run, ANCHORS)


def column_wise(group: np.ndarray, columns: np.ndarray, length: int) -> np.ndarray:
    """``out[row, c]``: the ``length`` symbols up to column c + length - 1 are also in another row of the group.

    ``columns`` has a line of symbols for each column. ``order`` lists the rows by group and reversed prefix, ``common[t]`` is
    the common length of the rows at t - 1 and t.
    """
    n_columns, m = columns.shape
    order = np.argsort(group, kind="stable")
    same = np.append(False, group[order][1:] == group[order][:-1])
    common = np.where(same, 0, -1)
    out = np.zeros((n_columns - length + 1, m), bool)
    dense = np.unique(group, return_inverse=True)[1].astype(np.int64)
    for c in range(n_columns):
        symbol = columns[c][order].astype(np.int64)
        key = dense[order] << 9 | symbol
        perm = np.argsort(key, kind="stable")
        key = key[perm]
        # the common length of two rows that meet is the least on the way between them, and one more
        i, j = perm[:-1], perm[1:]
        meet = np.nonzero((key[1:] == key[:-1]) & (key[1:] & 511 != _NONE))[0]
        i, j = i[meet], j[meet]
        new = np.zeros(m, np.int64)
        if len(meet):
            new[meet + 1] = _least(common, i + 1, j) + 1
        order = order[perm]
        g = dense[order]
        new[np.append(True, g[1:] != g[:-1])] = -1
        common = new
        if c >= length - 1:
            hit = common >= length
            both = hit.copy()
            both[:-1] |= hit[1:]
            out[c - length + 1, order[both]] = True
    return out.T


def _least(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of x[a..b] for each pair."""
    out = x[b].copy()
    more = np.nonzero(b > a)[0]
    if len(more):
        a, b = a[more], b[more]
        span = b - a + 1
        level = np.floor(np.log2(span)).astype(np.int64)
        got = np.empty(len(more), x.dtype)
        table, k = x, 0
        while True:
            own = level == k
            if own.any():
                got[own] = np.minimum(table[a[own]], table[b[own] - (1 << k) + 1])
            if k == level.max():
                break
            table = np.minimum(table[:-(1 << k)], table[1 << k:])
            k += 1
        out[more] = got
    return out


CONTEXTS = "anchor long, context long, many boolean, left int, symbols binary"


def read_contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted contexts (row, array of anchor, context, many, place, left, right)."""
    joined = rows.join(wanted, "row").select("doc_id", "text", "wanted")  # the same shuffle of documents serves the end
    out = arrow_schema(rows.sparkSession, CONTEXTS)

    def run(batches):
        for b in slices(batches, "text"):
            cols: dict = {f: [] for f in out.names}
            for _, text, some in zip(*b.to_pydict().values()):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for w in some:
                    for f in ("anchor", "context", "many", "left"):
                        cols[f].append(w[f])
                    cols["symbols"].append(raw[w["place"] - w["left"]:w["place"] + w["right"]])
            yield record(out, cols)
    return joined.mapInArrow(run, CONTEXTS)


PARTS = "anchor long, context long, start int, stop int"


def _runs(ok: np.ndarray, length: int, far: int, anchor, context) -> dict:
    """Covered stretches of each row, from runs of repeated strings; places count from the anchor."""
    edge = np.diff(np.pad(ok, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    stop = np.nonzero(edge == -1)[1]
    return {"anchor": anchor[row], "context": context[row], "start": start - far, "stop": stop + length - 1 - far}


def repeated_parts(contexts: DataFrame, length: int, gram: int, held: int = 8192) -> DataFrame:
    """The parts of contexts that repeat in another context of their anchor, by rounds over slices of whole anchors."""
    far, width = length - gram, 2 * length - gram
    out = arrow_schema(contexts.sparkSession, PARTS)

    def rounds(anchor, context, left, raw):
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        matrix = np.full((len(raw), width), _NONE, np.int16)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        start = np.arange(len(raw)) * width + far - np.array(left, np.int64)
        matrix.ravel()[ragged(start, lengths)] = flat
        ok = column_wise(np.array(anchor, np.int64), np.ascontiguousarray(matrix.T), length)
        return record(out, _runs(ok, length, far, np.array(anchor, np.int64), np.array(context, np.int64)))

    def run(batches):
        kept: list[list] = [[], [], [], []]
        for b in batches:
            for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                if kept[0] and row[:2] == (kept[0][-1], kept[1][-1]):
                    continue  # the same context, sent by equal rows
                if len(kept[0]) >= held and row[0] != kept[0][-1]:
                    yield rounds(*kept)
                    kept = [[], [], [], []]
                for k, v in zip(kept, row):
                    k.append(v)
        if kept[0]:
            yield rounds(*kept)
    dealt = contexts.where(~F.col("many")).select("anchor", "context", "left", "symbols")
    return dealt.repartition("anchor").sortWithinPartitions("anchor", "context").mapInArrow(run, PARTS)


def counted_parts(contexts: DataFrame, length: int, gram: int) -> DataFrame:
    """The same for anchors with very many contexts: every string through the anchor is counted by its bytes."""
    far = length - gram
    schema = "anchor long, context long, start int, string binary"
    out = arrow_schema(contexts.sparkSession, schema)

    def run(batches):
        for b in batches:
            for anchor, context, left, raw in zip(*(b.column(i).to_pylist() for i in range(4))):
                n = max(0, min(left, len(raw) - length) + 1)
                yield record(out, {"anchor": [anchor] * n, "context": [context] * n, "start": [k - left for k in range(n)],
                                   "string": [hashlib.blake2b(raw[k:k + length], digest_size=16).digest() for k in range(n)]})
    strings = contexts.where("many").dropDuplicates(["anchor", "context"]).select("anchor", "context", "left", "symbols").mapInArrow(run, schema)
    place = ["anchor", "start", "string"]  # the anchor at one place: else a string with two anchors would count twice
    twice = strings.groupBy(*place).count().where("count > 1").select(*place)
    return strings.join(twice, place).select("anchor", "context", "start", (F.col("start") + length).alias("stop"))


def repeated_spans(docs: DataFrame, *, length: int = 400, gram: int = 32, most: int = 50_000) -> DataFrame:
    """(row, spans): the covered stretches of each row that has some, as unmerged (start, stop) in bytes.

    ``docs`` has ``doc_id``, ``text`` and ``row`` (a hash of both).
    """
    anchors = cut(find_anchors(docs, length, gram))
    met = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.min("context").alias("x"), F.max("context").alias("z"))
    met = met.where("n > 1").select("anchor", (F.col("x") < F.col("z")).alias("mixed"))
    again = cut(anchors.join(met, "anchor"))
    one = F.min(F.struct("row", "place", "left", "right")).alias("one")
    distinct = cut(again.groupBy("anchor", "context", "mixed").agg(F.count("*").alias("n"), one))
    # contexts that occur twice as a whole: all strings in them repeat
    whole = distinct.where((F.col("n") > 1) & (F.col("one.left") + F.col("one.right") >= length)).select(
        "anchor", "context", (-F.col("one.left")).alias("start"), F.col("one.right").alias("stop"))
    counts = cut(distinct.where("mixed").groupBy("anchor").agg((F.count("*") > most).alias("many")))
    sent = distinct.where("mixed").join(counts, "anchor").select(F.col("one.row").alias("row"), F.struct(
        "anchor", "context", "many", F.col("one.place").alias("place"), F.col("one.left").alias("left"), F.col("one.right").alias("right")).alias("w"))
    wanted = sent.groupBy("row").agg(F.collect_list("w").alias("wanted"))  # at most one for each byte of the row
    contexts = read_contexts(docs, wanted)
    parts = whole.unionByName(repeated_parts(contexts, length, gram))
    if not counts.where("many").isEmpty():
        parts = parts.unionByName(counted_parts(contexts, length, gram))
    spans = again.join(parts, ["anchor", "context"]).select(
        "row", F.struct((F.col("place") + F.col("start")).alias("start"), (F.col("place") + F.col("stop")).alias("stop")).alias("span"))
    return spans.distinct().groupBy("row").agg(F.collect_list("span").alias("spans"))


def merge(spans: list | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["start"], s["stop"]) for s in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, gram: int = 32,
                   most: int = 50_000) -> DataFrame:
    """doc_id, n_bytes, the removed ``spans`` (maximal, in bytes) and the ``kept`` bytes of every row."""
    rows = two(docs, id_col, text_col).withColumn("row", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows, length=length, gram=gram, most=most)
    schema = "doc_id long, n_bytes long, spans array<struct<start:int,stop:int>>, kept binary"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for b in slices(batches, "text"):
            cols: dict = {f: [] for f in out.names}
            got = b.to_pydict()
            for doc_id, text, some in zip(got["doc_id"], got["text"], got["spans"]):
                raw, gone = (text or "").encode("utf-8", "surrogatepass"), merge(some)
                cols["doc_id"].append(doc_id)
                cols["n_bytes"].append(len(raw))
                cols["spans"].append([{"start": a, "stop": e} for a, e in gone])
                ends = [0, *(e for _, e in gone)]
                cols["kept"].append(b"".join(raw[e:a] for e, a in zip(ends, [*(a for a, _ in gone), len(raw)])))
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)
    return rows.join(spans, "row", "left").select("doc_id", "text", "spans").mapInArrow(run, schema)
