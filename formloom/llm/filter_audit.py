"""Which document filter removes what, under every order of the filters.

Every document gets a mask of the filters it fails. The documents of a part with one mask are a cell, so a part has
at most ``2 ** k`` cells, and all orders of the ``k`` filters follow from the survivors of the ``2 ** k`` subsets of filters. A Gray
code visits the subsets so that one filter is switched at a time: a counter per cell says how many of the active
filters it fails, and the running survivors change only by the cells whose counter leaves or reaches zero.

The cells are counted by Spark (folded on the map side); the walk sees cells only, part by part.

Null texts count as empty, null parts (``lang``) as the empty string. Texts of any length are read whole. A document
is a repeat if a row with a smaller id has its text; equal ids are no repeats of each other, and a row
without id is neither a repeat nor makes one. Equal rows count once each. A document with several labels is good
(toxic) if one of them says so; labels without an id belong to nobody. An empty table gives no rows. Only the id, the text, the part and the three label columns
are read, under names of our own, so further columns can't clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

from .common import arrow_schema, map_slices, record

#: The filters of :func:`document_masks`; bit i of a mask belongs to letter i.
FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 100, 80, 10, b"#$%&*|"
MEASURES = ("kept", "good_lost", "toxic_lost")
_CAPITALS = bytes(range(65, 91))


def fails(text: bytes, length: int) -> int:
    """Mask of A (few words), B (few distinct words), C (many capitals) and D (odd signs) of a text of ``length`` code points."""
    words = text.split()
    return ((len(words) < FEWEST_WORDS)
            | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, _CAPITALS))) > CAPITAL_PERCENT * length) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def _judge(cols: dict) -> dict:
    texts = [(t or "") for t in cols["text"]]
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    return {"doc_id": cols["doc_id"], "part": cols["part"], "mask": [fails(r, len(t)) for r, t in zip(raw, texts)],
            "same": [hashlib.sha256(r).digest() for r in raw]}


def document_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, mask, n): how many rows with this id in this part fail exactly the filters of ``mask``.

    E asks whether the text stands under a smaller id. Rows with the same id, part and text are folded
    before any shuffle, and the smallest id of a text is a minimum folded on the map side, so a text or an id that a third
    of all rows share is spread over all tasks: the two meet by (text, id), not by text.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    judged = map_slices(own, "text", "doc_id long, part string, mask int, same binary", _judge)
    rows = cut(judged.groupBy("doc_id", "part", "same", "mask").agg(F.count("*").alias("n")))  # texts are read once
    first = rows.where(F.col("doc_id").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("doc_id"))
    named = rows.where(F.col("doc_id").isNotNull()).join(first.withColumn("first", F.lit(True)), ["same", "doc_id"], "left")
    bit = 1 << FILTERS.index("E")
    named = named.withColumn("mask", F.when(F.col("first"), F.col("mask")).otherwise(F.col("mask") + bit))
    columns = ["doc_id", "part", "mask", "n"]
    return named.select(columns).unionAll(rows.where(F.col("doc_id").isNull()).select(columns))


def cells(masks: DataFrame, labels: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, kept, good_lost, toxic_lost): rows of each cell, and how many of them are labelled good and toxic."""
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("bad"))
    marks = marks.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("good").alias("good"), F.max("bad").alias("bad"))

    def counted(df):
        return df.groupBy("part", "mask").agg(F.sum("n").alias("kept"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good_lost"),
                                              F.sum(F.when(F.col("bad"), F.col("n")).otherwise(0)).alias("toxic_lost"))
    # rows without an id have no label: they don't meet in the one task that would hold the key null
    named = counted(masks.where(F.col("doc_id").isNotNull()).join(marks, "doc_id", "left"))
    nameless = counted(masks.where(F.col("doc_id").isNull()).withColumn("good", F.lit(False)).withColumn("bad", F.lit(False)))
    return named.unionAll(nameless).groupBy("part", "mask").agg(*[F.sum(m).alias(m) for m in MEASURES])


def gray_walk(masks: Sequence[int], counts: np.ndarray, k: int) -> np.ndarray:
    """Survivors of every subset of ``k`` filters: row s has, per measure, the sum over the cells that fail no filter of s."""
    masks = np.asarray(masks, np.int64)
    failing = [np.nonzero(masks >> f & 1)[0] for f in range(k)]
    active = np.zeros(len(masks), np.int64)  # filters of the present subset that a cell fails
    alive = counts.sum(axis=0)
    states = np.zeros((1 << k, counts.shape[1]), np.int64)
    states[0] = alive
    subset = 0
    for step in range(1, 1 << k):
        f = (step & -step).bit_length() - 1
        subset ^= 1 << f
        if subset >> f & 1:
            alive = alive - counts[failing[f][active[failing[f]] == 0]].sum(axis=0)
            active[failing[f]] += 1
        else:
            active[failing[f]] -= 1
            alive = alive + counts[failing[f][active[failing[f]] == 0]].sum(axis=0)
        states[subset] = alive
    return states


def order_table(states: np.ndarray, names: str) -> dict[str, list]:
    """Columns of one part: every order of the filters, step by step, by differences between the stored states."""
    k, every = len(names), (1 << len(names)) - 1
    kept = [int(x) for x in states[:, 0]]
    value = []
    for f in range(k):
        others = [s for s in range(1 << k) if not s >> f & 1]
        value.append(sum(math.factorial(s.bit_count()) * math.factorial(k - 1 - s.bit_count()) * (kept[s] - kept[s | 1 << f]) for s in others))
    out: dict[str, list] = {c: [] for c in ("filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")}
    for order in permutations(range(k)):
        before, name = 0, "".join(names[f] for f in order)
        for step, f in enumerate(order, 1):
            after = before | 1 << f
            gone = states[before] - states[after]
            row = (name, step, kept[after], int(gone[0]), kept[0] - kept[1 << f] - int(gone[0]), kept[every ^ 1 << f] - kept[every],
                   int(gone[1]), int(gone[2]), value[f])
            for c, x in zip(out, row):
                out[c].append(x)
            before = after
    return out


SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, "
          "toxic_lost long, shapley long")


def order_audit(table: DataFrame, names: str = FILTERS) -> DataFrame:
    """One row per part, order of the filters and step, from the cells of :func:`cells`: at most ``2 ** len(names)`` of a part."""
    out = arrow_schema(table.sparkSession, SCHEMA)
    parts = table.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))

    def run(batches):
        for b in batches:
            for part, own in zip(b.column("part").to_pylist(), b.column("cells").to_pylist()):
                counts = np.array([[c[m] for m in MEASURES] for c in own], np.int64)
                got = order_table(gray_walk([c["mask"] for c in own], counts, len(names)), names)
                yield record(out, {"part": [part] * len(got["step"]), **got})
    return parts.mapInArrow(run, SCHEMA)


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters over all documents, a part for each language."""
    return order_audit(cells(document_masks(docs), labels))
