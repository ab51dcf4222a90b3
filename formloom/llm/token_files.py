"""Token-id files of patched frame-of-reference blocks.

A file is a table of pages (Parquet rows, so every store that Spark writes can hold it). A page has whole
documents: a header, the documents' ids and lengths, the index of block starts and the blocks. A block holds
128 token ids: its minimum, ids minus the minimum packed at the width that covers ``percentile`` of them, and the
rest as exceptions (place, high bits). ``block(page, k)`` decodes one block through the index.

Pages follow ascending doc_id (null ids first, equal ids by text). A page has ``page_ids`` ids or one longer
document. A null text is an empty one; an empty table gives an empty file.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formloom.session import cut

from .common import arrow_schema, ragged, record, slices, two
from .pieces import coder, with_end

BLOCK = 128
HEAD = "<4sIQI"  # magic, documents, ids, blocks
PAGES = "shard int, page int, n_docs long, n_ids long, payload binary"


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def _pack(low: np.ndarray, w: int) -> np.ndarray:
    """Rows of 128 values of w bits as 2 * w little-endian 64-bit words."""
    n = len(low)
    out = np.zeros((2 * w, n), np.uint64)
    cols = np.ascontiguousarray(low.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        out[word] |= cols[i] << np.uint64(shift)
        if shift + w > 64:
            out[word + 1] |= cols[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out.T).astype("<u8")


def _unpack(words: np.ndarray, w: int) -> np.ndarray:
    n = len(words)
    cols = np.ascontiguousarray(words.T)
    out = np.empty((BLOCK, n), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(BLOCK):
        word, shift = divmod(i * w, 64)
        v = cols[word] >> np.uint64(shift)
        if shift + w > 64:
            v = v | (cols[word + 1] << np.uint64(64 - shift))
        out[i] = v & mask
    return out.T


def encode_page(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, percentile: float = 0.9) -> bytes:
    n, k = len(ids), -(-len(ids) // BLOCK)
    grid = np.full(k * BLOCK, ids[-1] if n else 0, np.uint32)
    grid[:n] = ids
    grid = grid.reshape(k, BLOCK)
    base = grid.min(axis=1) if k else np.zeros(0, np.uint32)
    delta = grid - base[:, None]
    at = min(BLOCK - 1, max(0, int(np.ceil(percentile * BLOCK)) - 1))
    width = _widths(np.partition(delta, at, axis=1)[:, at]) if k else np.zeros(0, np.int64)
    high = delta >> width[:, None].astype(np.uint32)
    row, place = np.nonzero(high)
    n_exc = np.bincount(row, minlength=k).astype(np.int64)
    size = 16 * width + 5 * n_exc
    start = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        if w == 0:
            continue
        own = np.nonzero(width == w)[0]
        packed = _pack(delta[own] & np.uint32((1 << int(w)) - 1), int(w)).view(np.uint8).reshape(len(own), -1)
        data[start[own][:, None] + np.arange(16 * int(w))] = packed
    if len(row):
        j = np.arange(len(row)) - (np.cumsum(n_exc) - n_exc)[row]
        tail = start[row] + 16 * width[row]
        data[tail + j] = place.astype(np.uint8)
        four = high[row, place].astype("<u4").view(np.uint8).reshape(-1, 4)
        data[(tail + n_exc[row] + 4 * j)[:, None] + np.arange(4)] = four
    keys = np.array([0 if d is None else d for d in doc_ids], "<i8")
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    return b"".join([struct.pack(HEAD, b"PFR1", len(doc_ids), n, k), keys.tobytes(), valid.tobytes(),
                     np.asarray(lengths, "<u8").tobytes(), start.astype("<u8").tobytes(), base.astype("<u4").tobytes(),
                     width.astype(np.uint8).tobytes(), n_exc.astype(np.uint8).tobytes(), data.tobytes()])


class Page:
    """A page read back: documents at once, blocks on demand."""

    def __init__(self, payload: bytes):
        magic, docs, self.n, k = struct.unpack_from(HEAD, payload)
        if magic != b"PFR1":
            raise ValueError("not a page of token ids")
        at = struct.calcsize(HEAD)

        def take(kind, count):
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out
        keys, valid = take("<i8", docs), take(np.uint8, docs)
        self.doc_ids = [int(a) if b else None for a, b in zip(keys, valid)]
        self.lengths = take("<u8", docs).astype(np.int64)
        self.start, self.base = take("<u8", k).astype(np.int64), take("<u4", k)
        self.width, self.n_exc = take(np.uint8, k).astype(np.int64), take(np.uint8, k).astype(np.int64)
        self.data = np.frombuffer(payload, np.uint8, -1, at)

    def blocks(self, which: np.ndarray) -> np.ndarray:
        """The ids of these blocks, a row each (the last block of a page is filled up)."""
        start, width, n_exc = self.start[which], self.width[which], self.n_exc[which]
        out = np.zeros((len(which), BLOCK), np.uint32)
        for w in np.unique(width):
            if w:
                own = np.nonzero(width == w)[0]
                raw = self.data[start[own][:, None] + np.arange(16 * int(w))]
                out[own] = _unpack(np.ascontiguousarray(raw).view("<u8"), int(w))
        if n_exc.any():
            row = np.repeat(np.arange(len(which)), n_exc)
            j = ragged(np.zeros(len(which), np.int64), n_exc)
            tail = start[row] + 16 * width[row]
            place = self.data[tail + j]
            four = self.data[(tail + n_exc[row] + 4 * j)[:, None] + np.arange(4)]
            high = np.ascontiguousarray(four).view("<u4").ravel()
            out[row, place] |= high << width[row].astype(np.uint32)
        return out + self.base[which][:, None]

    def block(self, k: int) -> np.ndarray:
        return self.blocks(np.array([k]))[0][:max(0, min(BLOCK, self.n - k * BLOCK))]

    def ids(self) -> np.ndarray:
        return self.blocks(np.arange(len(self.start))).ravel()[:self.n]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end: int, *, id_col: str = "doc_id", text_col: str = "text",
                 page_ids: int = 1 << 20, percentile: float = 0.9) -> None:
    """Tokenize the documents and write the file at ``path``.

    Texts are dealt by ranges of doc_id and sorted there; what is shuffled is text, once. A page goes
    out when it is full, so a task holds one page and one slice of texts.
    """
    schema = arrow_schema(docs.sparkSession, PAGES)

    def run(batches):
        from pyspark import TaskContext
        shard, page = TaskContext.get().partitionId(), 0
        keys, lens, parts, held = [], [], [], 0

        def out():
            n = np.concatenate(lens)
            return record(schema, {"shard": [shard], "page": [page], "n_docs": [len(keys)], "n_ids": [held], "payload": [
                encode_page(keys, n, np.concatenate(parts), percentile)]})
        for b in slices(batches, "text"):
            got = b.to_pydict()
            ids, n = with_end(*coder(tokenizer).encode(got["text"]), end)
            at, upto = 0, np.cumsum(n)
            while at < len(n):
                before = int(upto[at - 1]) if at else 0
                stop = int(np.searchsorted(upto, before + page_ids - held, "right"))
                stop = max(stop, at + (0 if keys else 1))
                if stop > at:
                    keys += got["doc_id"][at:stop]
                    lens.append(n[at:stop])
                    parts.append(ids[before:int(upto[stop - 1])])
                    held += int(upto[stop - 1]) - before
                if stop < len(n) or held >= page_ids:
                    yield out()
                    page += 1
                    keys, lens, parts, held = [], [], [], 0
                at = stop
        if keys:
            yield out()

    ordered = two(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, PAGES).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """Documents of a file: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    table = spark.read.schema(PAGES).parquet(path)
    schema = "shard int, page int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids
    out = arrow_schema(spark, schema)

    def run(batches):
        for b in batches:
            for shard, page, payload in zip(b.column(0), b.column(1), b.column(2)):
                p = Page(payload.as_py())
                flat, upto = p.ids().astype("<u4"), np.cumsum(p.lengths)
                cols = {"shard": pa.repeat(shard, len(p.doc_ids)), "page": pa.repeat(page, len(p.doc_ids)),
                        "doc_id": p.doc_ids, "local": upto - p.lengths, "n_tokens": p.lengths,
                        "ids_crc32": [zlib.crc32(flat[e - n:e].data) for e, n in zip(upto, p.lengths)]}
                if ids:
                    cols["ids"] = [flat[e - n:e].astype(np.int32) for e, n in zip(upto, p.lengths)]
                yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type)
                                                  for f in out], schema=out)

    docs = table.select("shard", "page", "payload").mapInArrow(run, schema)
    # starts: sums over shards (one row for each written part), then over the pages of a shard
    sizes = cut(table.select("shard", "page", "n_ids"))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).withColumn(
        "before", F.sum("n").over(Window.orderBy("shard")) - F.col("n")).select("shard", "before")
    pages = sizes.withColumn("inside", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("page")) - F.col("n_ids"))
    at = pages.join(shards, "shard").select("shard", "page", (F.col("before") + F.col("inside")).alias("base"))
    return docs.join(at, ["shard", "page"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)
