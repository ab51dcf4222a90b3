"""Best-fit packing of documents into sequences of a fixed capacity.

Documents of one length are interchangeable, and so are gaps of one size; both are integers from 1 to the
capacity. So the sweeps run over *runs*: a run of documents is (length, ranks from..to), a run of
gaps is (size, bins from..to). What grows with the data is distributed: tokenizing, the range sort of the documents by
length, their ranks (places within written partitions plus the counts of the partitions before) and the
placement of every document through its rank. What is left is bounded by the capacity, whatever the input:
``plan`` sees one count for each length. It works in supersteps, longest documents first: the run of documents takes its
successor, the smallest gap that holds it; where documents compete for a gap, the lower rank has it and the
others go on to the next; gaps are updated, and bins are opened for the rest.

A null text is an empty one: its end id alone. Equal documents (also repeated rows) are separate items. Null ids are
ordinary ids. An empty table gives no sequences. Documents of more than ``capacity`` ids are cut
into full pieces and a rest.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from formloom.session import cut

from .common import arrow_schema, map_slices, record, two
from .pieces import coder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end: int, capacity: int = 4096, *, id_col: str = "doc_id",
                 text_col: str = "text", ids: bool = False) -> DataFrame:
    """The pieces of at most ``capacity`` ids that documents are packed in."""
    def fn(rows):
        flat, n = with_end(*coder(tokenizer).encode(rows["text"]), end)
        flat = flat.astype("<u4")
        count = -(-n // capacity)
        doc = np.repeat(np.arange(len(n)), count)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
        start = piece * capacity
        length = np.minimum(n[doc] - start, capacity)
        at = (np.cumsum(n) - n)[doc] + start
        parts = [flat[a:a + k] for a, k in zip(at.tolist(), length.tolist())]
        out = {"doc_id": [rows["doc_id"][i] for i in doc], "piece": piece, "start": start, "length": length,
               "ids_crc32": [zlib.crc32(p.data) for p in parts]}
        return out | ({"ids": [p.astype(np.int32) for p in parts]} if ids else {})
    return map_slices(two(docs, id_col, text_col), "text", PIECES + ", ids array<int>" * ids, fn)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (length, rank, bin, per_bin, offset), sorted, and the number of bins.

    The documents of ``length`` from ``rank`` on go ``per_bin`` to a bin, from ``bin`` on, the first at ``offset``.
    At most ``capacity`` runs are opened and two are split off in each superstep, so the table is
    bounded by the capacity and not by the documents.
    """
    gaps: dict[int, deque] = {}
    sizes: list[int] = []  # the sizes that have gaps, ascending
    rows, bins = [], 0

    def free(size, first, n):
        if size > 0 and n > 0:
            if size not in gaps:
                gaps[size] = deque()
                bisect.insort(sizes, size)
            gaps[size].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            i = bisect.bisect_left(sizes, length)
            if i == len(sizes):  # no gap holds them: open bins for all that are left
                size, n = capacity, -(-left // (capacity // length))
                first, bins = bins, bins + n
            else:
                size = sizes[i]
                first, n = gaps[size].popleft()
                if not gaps[size]:
                    del gaps[size], sizes[i]
            each = size // length
            take = min(left, n * each)
            full, more = divmod(take, each)
            rows.append((length, rank, first, each, capacity - size))
            free(size - each * length, first, full)
            free(size - more * length, first + full, 1 if more else 0)
            used = full + (more > 0)
            free(size, first + used, n - used)
            left, rank = left - take, rank + take
    return np.array(sorted(rows), np.int64).reshape(-1, 5), bins


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (any table with ``length``, doc_id and piece) with sequence_id and offset."""
    spark = pieces.sparkSession
    pieces = cut(pieces)  # the range sort reads its input twice
    ordered = pieces.repartitionByRange("length", "doc_id", "piece").sortWithinPartitions("length", "doc_id", "piece")
    inner = StructType([*ordered.schema, StructField("part", IntegerType()), StructField("nth", LongType())])
    schema = arrow_schema(spark, inner)

    def number(batches):
        from pyspark import TaskContext
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for b in batches:
            n = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            if not len(n):
                continue
            new = np.append(True, n[1:] != n[:-1])
            run = np.maximum.accumulate(np.where(new, np.arange(len(n)), 0))
            nth = np.arange(len(n)) - run + np.where((run == 0) & (n[0] == last), seen, 0)
            last, seen = n[-1], int(nth[-1]) + 1
            yield record(schema, {f: b.column(i) for i, f in enumerate(b.schema.names)}
                         | {"part": np.full(len(n), part, np.int32), "nth": nth})

    numbered = cut(ordered.mapInArrow(number, inner))
    parts = numbered.groupBy("length", "part").agg((F.max("nth") + 1).alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n"))
    counts = {r[0]: r[1] for r in parts.groupBy("length").agg(F.sum("n")).collect()}  # at most ``capacity`` rows
    table, _ = plan(counts, capacity)
    held = spark.sparkContext.broadcast(table)
    ranked = numbered.join(before.drop("n"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.select(*pieces.columns, "rank")
    out_type = StructType([*pieces.schema, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    out_schema = arrow_schema(spark, out_type)

    def place(batches):
        rows = held.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False).astype(np.int64)
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(rank):
                continue
            row = rows[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            step, slot = np.divmod(rank - row[:, 1], row[:, 3])
            yield record(out_schema, {f: b.column(i) for i, f in enumerate(b.schema.names) if f != "rank"}
                         | {"sequence_id": row[:, 2] + step, "offset": row[:, 4] + slot * length})
    return ranked.mapInArrow(place, out_type)


def sequences(packed: DataFrame) -> DataFrame:
    """The ids of each sequence, from pieces that carry ``ids``; a sequence has at most ``capacity`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(parts["ids"]).alias("ids"))
