"""Near-duplicate documents by SimHash, joined by the generalised pigeonhole principle.

A fingerprint bit is the majority of that bit over the XXH64 of all 4-word shingles, repeats included. Distinct fingerprints are
linked when at most ``bits`` (4) bits differ, without missing a pair:

* Correlated bits are grouped into ``m`` parts. If two fingerprints differ in at most ``bits`` bits and the thresholds of the
  parts sum to ``bits - m + 1``, some part differs by no more than its own threshold. A threshold of -1 skips a part.
* The thresholds may be any for each probing fingerprint. Dynamic programming picks those of least cost,
  which is the number of probes plus the estimated number of candidates, from histograms of blocks of each part over all fingerprints.
  ``m`` itself is that of least cost over all fingerprints.
* A probe is a value within the threshold of the part; it meets the fingerprints whose part has that value, and each pair that meets is verified on all 64
  bits. Only larger fingerprints are sought: the smaller one of a pair probes.

Groups of near copies would make pairs with the square of their size, and only components are wanted. So fingerprints that share a part's
value first hang on a few heads of that value, in turns as long as many grow together; after that only pairs of different components
meet. Where a value holds many fingerprints of one component, probes of that component pass them by: the value's
main component and the rest are lists of their own.

Null and empty texts have no shingle, so fingerprint zero, linked like any other; a text with fewer words than a shingle
is one shingle. Texts of any length are read whole. Equal rows and rows with equal ids are rows of their own; a component without any id has
none. An empty table gives no rows. Only id and text are read, under names of our own, so further columns can't clash.
"""

from __future__ import annotations

from functools import partial
from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formloom.session import cut

from .common import arrow_schema, ascii_lower, map_slices, record, two
from .graph import components

SEED = 42
#: Numbers of parts to choose from; widest block of a histogram; cost of a probe, in candidates verified.
PARTS, BLOCK_BITS, PROBE_COST = (2, 3, 4, 5), 11, 60
HEADS = 6


def shingle_hashes(text: bytes, size: int = 4) -> np.ndarray:
    """XXH64 (seed 42) of every space-joined shingle; of the whole sequence if there are fewer words."""
    words = text.split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    stops = list(accumulate(len(w) + 1 for w in words))
    n, digest = max(len(words) - size + 1, 1), xxhash.xxh64_intdigest
    starts, stops = [0, *stops[:n - 1]], stops[min(size, len(words)) - 1:]
    return np.fromiter((digest(joined[a:b - 1], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed 64-bit integer."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        raw = hashes[at:at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, f) of every row."""
    def run(cols):
        return {"doc_id": cols["doc_id"], "f": [fingerprint(shingle_hashes(ascii_lower(t or ""), size)) for t in cols["text"]]}
    return map_slices(two(docs, id_col, text_col), "text", "doc_id long, f long", run)


def bits_of(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(f, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def longs(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False)


def together(nodes: DataFrame) -> np.ndarray:
    """How many of ``nodes`` (f) have both bits, for all 64 x 64 pairs of bits; 64 rows of each task are summed."""
    schema = "bit int, n array<long>"
    out = arrow_schema(nodes.sparkSession, schema)

    def run(batches):
        total = np.zeros((64, 64), np.int64)
        for b in batches:
            x = bits_of(longs(b, "f")).astype(np.float32)  # exact: a batch has fewer than 2 ** 24 rows
            total += (x.T @ x).astype(np.int64)
        yield record(out, {"bit": list(range(64)), "n": total.tolist()})
    got = nodes.select("f").mapInArrow(run, schema).groupBy("bit").agg(F.array(*[F.sum(F.col("n")[i]) for i in range(64)]).alias("n"))
    out_matrix = np.zeros((64, 64), np.int64)
    for r in got.collect():  # 64 rows
        out_matrix[r.bit] = r.n
    return out_matrix


def grouped_bits(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """``m`` parts of nearly equal width; a part is grown by the bit that correlates most with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, 0)
    left, parts = set(range(64)), []
    for k in range(m):
        width = (64 - sum(map(len, parts))) // (m - k)
        rest = sorted(left)
        part = [rest[int(near[np.ix_(rest, rest)].max(axis=1).argmax())]]
        while len(part) < width:
            rest = sorted(left - set(part))
            part.append(rest[int(near[np.ix_(rest, part)].sum(axis=1).argmax())])
        parts.append(part)
        left -= set(part)
    return parts


def blocks_of(part: list[int]) -> list[list[int]]:
    k = -(-len(part) // BLOCK_BITS)
    return [part[i * len(part) // k:(i + 1) * len(part) // k] for i in range(k)]


def value_of(f: np.ndarray, part: list[int]) -> np.ndarray:
    """The bits of ``part`` as one integer, the first one lowest."""
    u, out = f.astype(np.int64).view(np.uint64), np.zeros(len(f), np.uint64)
    for i, b in enumerate(part):
        out |= (u >> np.uint64(b) & np.uint64(1)) << np.uint64(i)
    return out.astype(np.int64)


def histograms(nodes: DataFrame, blocks: list[list[int]]) -> list[np.ndarray]:
    """How many of ``nodes`` (f) have each value of each block: 2,048 numbers of a block at most."""
    schema = "block int, value int, n long"
    out = arrow_schema(nodes.sparkSession, schema)

    def run(batches):
        total = [np.zeros(1 << len(b), np.int64) for b in blocks]
        for batch in batches:
            f = longs(batch, "f")
            for t, b in zip(total, blocks):
                t += np.bincount(value_of(f, b), minlength=len(t))
        for i, t in enumerate(total):
            at = np.nonzero(t)[0]
            yield record(out, {"block": np.full(len(at), i), "value": at, "n": t[at]})
    result = [np.zeros(1 << len(b), np.int64) for b in blocks]
    for r in nodes.select("f").mapInArrow(run, schema).groupBy("block", "value").agg(F.sum("n").alias("n")).collect():
        result[r.block][r.value] = r.n
    return result


def shells(histogram: np.ndarray, most: int) -> np.ndarray:
    """Row d: how many have a value at distance d, for each value."""
    near = np.zeros((most + 1, len(histogram)), np.int64)
    near[0] = histogram
    values = np.arange(len(histogram))
    for bit in range(len(histogram).bit_length() - 1):
        moved = near[:, values ^ (1 << bit)]
        near[1:] += moved[:-1]
    return near


def estimates(f: np.ndarray, parts: list[list[int]], near: list[list[np.ndarray]], n: int, bits: int) -> list[np.ndarray]:
    """Per part a (bits + 1, len(f)) array: estimated number of fingerprints within each distance, blocks taken as independent."""
    out = []
    for part, own in zip(parts, near):
        share = np.zeros((bits + 1, len(f)))
        share[0] = 1
        for block, table in zip(blocks_of(part), own):
            at = table[:, value_of(f, block)] / max(n, 1)
            share = np.stack([sum(share[d - e] * at[e] for e in range(d + 1)) for d in range(bits + 1)])
        out.append(n * np.cumsum(share, axis=0))
    return out


def flips(width: int, t: int) -> np.ndarray:
    """All values of ``width`` bits with at most ``t`` ones, by number of ones."""
    return np.array([sum(1 << i for i in c) for d in range(t + 1) for c in combinations(range(width), d)], np.int64)


def allocate(costs: list[np.ndarray], total: int) -> tuple[np.ndarray, np.ndarray]:
    """Thresholds of each part (-1: skipped) that sum to ``total`` at the least cost, and that cost, for every fingerprint.

    ``costs[i][t]`` is what part i costs at threshold t.
    """
    n, m = costs[0].shape[1], len(costs)
    width = total + m + 1  # thresholds are counted from -1: part by part they add up to total + m
    best = np.full((width, n), np.inf)
    best[0] = 0
    picks = []
    for cost in costs:
        options = np.stack([np.zeros(n), *cost])
        new, pick = np.full((width, n), np.inf), np.zeros((width, n), np.int64)
        for s in range(width):
            for t in range(min(s + 1, len(options))):
                c = best[s - t] + options[t]
                less = c < new[s]
                new[s], pick[s] = np.where(less, c, new[s]), np.where(less, t, pick[s])
        best = new
        picks.append(pick)
    at, out = np.full(n, width - 1), np.zeros((m, n), np.int64)
    for i in reversed(range(m)):
        t = picks[i][at, np.arange(n)]
        out[i], at = t - 1, at - t
    return out, best[width - 1]


def plan(f: np.ndarray, parts: list[list[int]], near: list[list[np.ndarray]], n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    probes = [np.cumsum([comb(len(p), d) for d in range(bits + 1)]) for p in parts]
    found = estimates(f, parts, near, n, bits)
    return allocate([PROBE_COST * k[:, None] + c for k, c in zip(probes, found)], bits - len(parts) + 1)


def choose(nodes: DataFrame, bits: int) -> tuple[list[list[int]], list[list[np.ndarray]], int]:
    """Parts of correlated bits, the shells of their blocks and the number of fingerprints; as many parts as cost least over all."""
    n = nodes.count()
    both = together(nodes)
    layouts = [grouped_bits(both, n, m) for m in PARTS if m <= bits + 1]
    counted = histograms(nodes, [b for parts in layouts for p in parts for b in blocks_of(p)])
    near, at = [], 0
    for parts in layouts:
        near.append([])
        for p in parts:
            k = len(blocks_of(p))
            near[-1].append([shells(h, bits) for h in counted[at:at + k]])
            at += k
    schema = "layout int, cost double"
    out = arrow_schema(nodes.sparkSession, schema)

    def run(batches):
        total = np.zeros(len(layouts))
        for b in batches:
            total += [plan(longs(b, "f"), parts, own, n, bits)[1].sum() for parts, own in zip(layouts, near)]
        yield record(out, {"layout": list(range(len(layouts))), "cost": total})
    cost = {r.layout: r.cost for r in nodes.select("f").mapInArrow(run, schema).groupBy("layout").agg(F.sum("cost").alias("cost")).collect()}
    best = min(range(len(layouts)), key=lambda i: (cost.get(i, 0), i))
    return layouts[best], near[best], n


def indexed(nodes: DataFrame, parts: list[list[int]]) -> DataFrame:
    """(f, root, part, value): every fingerprint under its value in each part."""
    def values(part: list[int]) -> Column:
        out = F.lit(0).cast("long")
        for i, b in enumerate(part):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned("f", b).bitwiseAND(F.lit(1).cast("long")), i))
        return out
    each = F.posexplode(F.array(*[values(p) for p in parts])).alias("part", "value")
    return nodes.select("f", "root", each)


def probed(nodes: DataFrame, parts: list[list[int]], near: list[list[np.ndarray]], n: int, bits: int) -> DataFrame:
    """(f, root, part, value): the values that each fingerprint probes under its own thresholds."""
    schema = "f long, root long, part int, value long"
    out = arrow_schema(nodes.sparkSession, schema)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                b = whole.slice(at, 2048)
                f, root = longs(b, "f"), longs(b, "root")
                thresholds, _ = plan(f, parts, near, n, bits)
                for i, part in enumerate(parts):
                    value = value_of(f, part)
                    for t in np.unique(thresholds[i]):
                        if t >= 0:
                            own, change = np.nonzero(thresholds[i] == t)[0], flips(len(part), int(t))
                            step = max(1, (1 << 17) // len(change))
                            for k in range(0, len(own), step):
                                rows = own[k:k + step]
                                yield record(out, {"f": np.repeat(f[rows], len(change)), "root": np.repeat(root[rows], len(change)),
                                                   "part": np.full(len(rows) * len(change), i), "value": (value[rows, None] ^ change).ravel()})
    return nodes.select("f", "root").mapInArrow(run, schema)


def far(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def order(column: str, turn: int) -> Column:
    return F.struct(F.xxhash64(column, F.lit(turn)).alias("o"), F.col(column).alias("r"))


def hung(nodes: DataFrame, index: DataFrame, bits: int, turn: int) -> DataFrame:
    """``nodes`` (f, root) with components joined over links to a few heads of each value that several components share.

    Heads are early in a random order of the components. A component hangs on the earliest one that a head
    linked to one of its members belongs to, so what hangs together is a forest, and jumps from parent to parent end at its roots.
    """
    mine = F.pmod(F.xxhash64("f", F.lit(-1 - turn)), F.lit(HEADS))
    pick = [F.min(F.when(mine == k, F.struct(order("root", turn).alias("key"), F.col("f").alias("h")))).alias(f"h{k}") for k in range(HEADS)]
    mixed = index.groupBy("part", "value").agg(F.min("root").alias("x"), F.max("root").alias("z"), *pick).where("x < z")
    heads = cut(mixed.select("part", "value", F.array_compact(F.array(*[F.col(f"h{k}") for k in range(HEADS)])).alias("heads")))
    near = F.filter("heads", lambda h: (h["key"] < F.col("key")) & (F.bit_count(h["h"].bitwiseXOR(F.col("f"))) <= bits))
    met = index.withColumn("key", order("root", turn)).join(heads, ["part", "value"]).select("root", F.array_min(F.transform(near, lambda h: h["key"])).alias("up"))
    up = cut(met.where(F.col("up").isNotNull()).groupBy("root").agg(F.min("up")["r"].alias("up")))
    while True:
        above = up.select(F.col("root").alias("up"), F.col("up").alias("top"))
        jumped = cut(up.join(above, "up", "left").select("root", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")))
        up = jumped.select("root", "up")
        if not jumped.where("moved").limit(1).count():
            return cut(nodes.join(up, "root", "left").select("f", F.coalesce("up", "root").alias("root")))


def apart_links(index: DataFrame, probes: DataFrame, bits: int) -> DataFrame:
    """(a, b): components with a link: probes meet the main component of a value unless it is their own, and all others."""
    of_value = index.groupBy("part", "value", "root").agg(F.count("*").alias("n"))
    main = cut(of_value.groupBy("part", "value").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("k")).select(
        "part", "value", F.col("m.root").alias("main"), (F.col("k") > 1).alias("more")))
    own = F.col("root") == F.col("main")
    lists = F.array_compact(F.array(F.when(~own, F.lit(0)), F.when(F.col("more"), F.lit(1))))
    sought = probes.join(main, ["part", "value"]).where(~own | F.col("more")).select("part", "value", F.explode(lists).alias("list"), F.col("f").alias("a"), F.col("root").alias("ra"))
    kept = index.join(main, ["part", "value"]).select("part", "value", F.when(own, 0).otherwise(1).alias("list"), F.col("f").alias("b"), F.col("root").alias("rb"))
    met = sought.join(kept, ["part", "value", "list"]).where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (far("a", "b") <= bits))
    return met.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()


def fingerprint_components(nodes: DataFrame, bits: int = 4) -> DataFrame:
    """(f, root) of distinct fingerprints: those that links of at most ``bits`` differing bits connect have one root among them."""
    nodes = cut(nodes.select("f", F.col("f").alias("root")))
    parts, near, n = choose(nodes, bits)
    left = n
    for turn in range(64):  # each that goes on has joined components; the step after is exact whatever they found
        nodes = hung(nodes, indexed(nodes, parts), bits, turn)
        before, left = left, nodes.where("f = root").count()
        if 20 * (before - left) <= n:
            break
    rest = cut(apart_links(indexed(nodes, parts), probed(nodes, parts, near, n, bits), bits))
    named = components(rest).select(F.col("id").alias("root"), F.col("root").alias("top"))
    return cut(nodes.join(named, "root", "left").select("f", F.coalesce("top", "root").alias("root")))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, size=size))
    nodes = cut(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = fingerprint_components(nodes, bits)
    names = cut(roots.join(nodes, "f"))
    # a row alone in its component is named by itself; the others' names meet their rows
    several = cut(names.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("rows")).where("rows > 1"))
    shared = cut(names.join(several, "root").select("f", "component_id", F.lit(True).alias("shared")))
    joined = rows.join(shared, "f", "left")
    hexed = F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint")
    return joined.select("doc_id", hexed, F.when(F.col("shared"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
