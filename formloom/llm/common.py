"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = rb"[^\x20\x09-\x0D]+"
SPACES = " \t\n\v\f\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8: ``bytes.split`` splits at exactly these six bytes."""
    return text.encode("utf-8", "surrogatepass").split()


def ascii_lower(text: str) -> bytes:
    """UTF-8 with A-Z lowered and nothing else: ``bytes.lower`` knows ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower()


def slices(batches: Iterable[pa.RecordBatch], column: str, rows: int = 4096,
           size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most ``rows`` rows and about ``size`` bytes of text (one row at least)."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(column))), 0)
        total = np.cumsum(n.to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(total):
            before = int(total[at - 1]) if at else 0
            end = int(np.searchsorted(total, before + size, "right"))
            end = min(max(end, at + 1), at + rows, len(total))
            yield b.slice(at, end - at)
            at = end


def map_slices(df: DataFrame, text: str, schema: str, fn: Callable[[dict], dict], rows: int = 4096,
               size: int = 4 << 20) -> DataFrame:
    """``fn`` over slices as dicts of lists; it returns a dict of columns in the order of ``schema``."""
    out = arrow_schema(df.sparkSession, schema)

    def run(batches):
        for b in slices(batches, text, rows, size):
            got = fn(b.to_pydict())
            yield pa.RecordBatch.from_arrays([pa.array(got[f.name], f.type) for f in out], schema=out)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str | StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema)


def record(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def two(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, under names of our own: other columns can't clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix finaliser) of unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i] + lengths[i] - 1`` of every i, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def same(a: str | Column, b: str | Column) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) if isinstance(a, str) else a.eqNullSafe(b)


_BASE = 0x9E3779B97F4A7C15


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words ``[^\\x20\\x09-\\x0D]+`` in a row, and how many words each text has."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | (raw - np.uint8(9) < 5)
    begin = ~space
    begin[1:] &= space[:-1]
    s = np.nonzero(begin)[0]
    over = space.copy()
    over[1:] &= ~space[:-1]
    over[0] = False
    e = np.nonzero(over)[0]
    n = len(raw)
    by, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    by[0] = back[0] = 1
    total = np.zeros(n + 1, np.uint64)
    salt = mix(np.arange(1, 257, dtype=np.uint64))
    np.cumsum(salt[raw] * np.multiply.accumulate(by), out=total[1:])
    back = np.multiply.accumulate(back)
    h = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(s, ends)
    return h, np.diff(np.append(0, upto))


def shingle_sets(texts: list[bytes], size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``size``-word shingles of each text (64-bit hashes, sorted in each text), one text after the other, and their number.

    A text with fewer words has its whole sequence as one; a text without words has none.
    """
    w, n = word_hashes(texts)
    if not len(w):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    k = np.uint64(0xD6E8FEB86659FD93)
    end = np.cumsum(n)
    text = np.repeat(np.arange(len(n)), n)
    h = w.copy()
    left = end[text] - np.arange(len(w))  # words from here to the end of the text
    for i in range(1, size):
        more = np.zeros(len(w), np.uint64)
        more[:-i] = w[i:] if i < len(w) else more[:-i]
        h = np.where(left > i, h * k + more, h)
    keep = (left >= size) | ((n[text] < size) & (left == n[text]))
    h, text = mix(h[keep] + np.minimum(left[keep], size).astype(np.uint64)), text[keep]
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))
    return h[new], np.bincount(text[new], minlength=len(texts))
