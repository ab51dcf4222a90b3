"""k-means of many models at once.

A model is (data set, k, start).  All models of all data sets are moved by the same passes over the rows: a task assigns its
rows to the centres of every model that still moves and sends, per data set and k, one array of counts, sums and costs, which are added
up per (data set, k) on the executors.  The driver holds centres, whose number depends on the models, never on the rows.

The rows of a data set are dealt once into blocks, each in the order of a tree of boxes. A box that lies nearer to one centre than to
any other goes to that centre with the sums of its rows; only rows in boxes on a border between clusters are looked at one by one, so
a pass costs what the borders are long. Every row counts in every pass.

Starts are drawn by k-means++ from a pool of ``POOL`` rows (those with the smallest md5 of their id; a bounded sample that only
places the first centres) and settle on the pool, side by side in tasks; the passes then settle them on all rows.
Starts that agree after the pool are one model from there on.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, discard

POOL = 2048
BLOCK = 1 << 19  # numbers of a block of rows
LEAF = 32  # rows of a smallest box
SMALL = 1 << 16  # rows times centres of a model below which boxes don't pay
FEW = 4  # centres that a list of those still possible for a box has at most, if it isn't all of them
CELLS = 1 << 15  # distances to one centre of each model held at a time


@dataclass
class Fit:
    """Best start of one data set and k: ``centres`` (k x p) by rising coordinates, rows and sums of the clusters, cost."""

    data_set: int
    k: int
    centres: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    squares: np.ndarray
    cost: float


def finite(cols: Sequence[str]) -> Column:
    """No column is NULL, NaN or infinite."""
    out = F.lit(True)
    for c in cols:
        out = out & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return F.coalesce(out, F.lit(False))


def _sums(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(models, k, p + 3): rows, sums of the columns and sum of squares of the nearest centres' clusters, and the cost of all of them with the first.

    Centres are taken one by one over blocks that stay in the processor's cache; a row of equal distances belongs to the first.
    """
    m, k, p = centres.shape
    out = np.zeros((m, k, p + 3))
    turns = [np.hstack([-2 * c, (c * c).sum(axis=1)[:, None]]) for c in centres.transpose(1, 0, 2)]
    step = max(1, CELLS // max(m, 1))
    for at in range(0, len(x), step):
        rows = x[at:at + step]
        square = (rows * rows).sum(axis=1)
        lifted = np.vstack([rows.T, np.ones(len(rows))])
        columns = np.column_stack([np.ones(len(rows)), rows, square])
        distances = [t @ lifted for t in turns]
        least = distances[0]
        for d in distances[1:]:
            least = np.minimum(least, d)
        left = np.ones(least.shape, bool)
        for j, d in enumerate(distances):
            hit = (d == least) & left
            left ^= hit
            out[:, j, :p + 2] += hit.astype(float) @ columns
        out[:, 0, p + 2] += np.maximum(least + square, 0).sum(axis=1)
    return out


def _moved(centres: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """The means; a centre without rows stays."""
    n = sums[:, :, :1]
    return np.where(n > 0, sums[:, :, 1:1 + centres.shape[2]] / np.maximum(n, 1), centres)


def _seeded(x: np.ndarray, k: int, starts: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ centres of every start."""
    at = rng.integers(0, len(x), starts)
    centres = [x[at]]
    least = np.full((starts, len(x)), np.inf)
    for _ in range(k - 1):
        least = np.minimum(least, ((x[None] - centres[-1][:, None]) ** 2).sum(axis=2))
        total = least.cumsum(axis=1)
        draw = rng.random(starts) * total[:, -1]
        at = np.minimum([np.searchsorted(t, u, "right") for t, u in zip(total, draw)], len(x) - 1)
        centres.append(x[at])
    return np.stack(centres, axis=1)


def _settled(x: np.ndarray, centres: np.ndarray, rounds: int) -> np.ndarray:
    moving = np.arange(len(centres))
    centres = centres.copy()
    for _ in range(rounds):
        new = _moved(centres[moving], _sums(x, centres[moving]))
        changed = np.abs(new - centres[moving]).max(axis=(1, 2)) > 1e-12
        centres[moving] = new
        moving = moving[changed]
        if not len(moving):
            break
    return centres


def _distinct(centres: np.ndarray) -> np.ndarray:
    """Centres of each model by rising coordinates, and each model once."""
    order = [np.lexsort(c.T[::-1]) for c in np.round(centres, 9)]
    centres = np.stack([c[o] for c, o in zip(centres, order)])
    _, first = np.unique(np.round(centres, 9).reshape(len(centres), -1), axis=0, return_index=True)
    return centres[np.sort(first)]


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    v = batch.column(batch.schema.get_field_index("v"))
    return v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _edges(n: int, level: int) -> np.ndarray:
    """Where the boxes of a level begin, and the end; two boxes make up one of the level above."""
    return n * np.arange((1 << level) + 1) // (1 << level)


def _levels(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF)))


def _ordered(x: np.ndarray) -> np.ndarray:
    """The rows so that every box has its rows side by side; a box is halved across its longest side."""
    for level in range(_levels(len(x))):
        e = _edges(len(x), level)
        side = (np.maximum.reduceat(x, e[:-1]) - np.minimum.reduceat(x, e[:-1])).argmax(axis=1)
        box = np.repeat(np.arange(len(side)), np.diff(e))
        x = x[np.lexsort((x[np.arange(len(x)), side[box]], box))]
    return x


class _Tree:
    """Middle, half sides and sums (rows, columns, squares) of the boxes of every level over ordered rows."""

    def __init__(self, x: np.ndarray):
        columns = np.column_stack([np.ones(len(x)), x, (x * x).sum(axis=1)])
        edges = _edges(len(x), _levels(len(x)))
        at = edges[:-1]
        low, high, sums = np.minimum.reduceat(x, at), np.maximum.reduceat(x, at), np.add.reduceat(columns, at)
        # column x box x row: rows of the smallest boxes from their middle, and what they add up to (nothing beyond a box's last row)
        rows = at[:, None] + np.arange(np.diff(edges).max())
        mine, rows = (rows < edges[1:, None])[:, :, None], np.minimum(rows, len(x) - 1)
        self.rows = np.ascontiguousarray((x[rows] - ((low + high) / 2)[:, None]).transpose(2, 0, 1))
        self.cells = np.ascontiguousarray((columns[rows] * mine).transpose(2, 0, 1))
        self.levels = []
        while True:
            self.levels.insert(0, ((low + high) / 2, (high - low) / 2, sums))
            if len(sums) == 1:
                break
            low, high, sums = np.minimum(low[::2], low[1::2]), np.maximum(high[::2], high[1::2]), sums[::2] + sums[1::2]

    def sums(self, centres: np.ndarray) -> np.ndarray:
        """What ``_sums`` gives over all rows."""
        m, k, p = centres.shape
        out = np.zeros((m * k, p + 2))

        def add(to, what):
            for c in range(p + 2):
                out[:, c] += np.bincount(to, what[:, c], m * k)
        level = min(3, len(self.levels) - 1)
        boxes = 1 << level
        open_boxes = [(np.repeat(np.arange(m), boxes), np.tile(np.arange(boxes), m), np.tile(np.arange(k), (m * boxes, 1)))]
        for level in range(level, len(self.levels)):
            middle, half, sums = self.levels[level]
            left = defaultdict(list)
            for model, box, some in _pieces(open_boxes, CELLS):
                row = np.arange(len(model))
                c = centres[model[:, None], some]
                d = ((middle[box][:, None] - c) ** 2).sum(axis=2)
                near = d.argmin(axis=1)
                # how much nearer another centre can be at a corner than in the middle, against the nearest one
                gain = 2 * (np.abs(c - c[row, near][:, None]) * half[box][:, None]).sum(axis=2)
                possible = d - d[row, near][:, None] <= gain + 1e-12 * d
                number = possible.sum(axis=1)
                own = number == 1
                add(model[own] * k + some[row, near][own], sums[box[own]])
                for n in range(2, some.shape[1] + 1):
                    here = number == n if n <= FEW else number > FEW
                    if here.any():
                        kept = some[here][possible[here]].reshape(-1, n) if n <= FEW else some[here]
                        left[kept.shape[1]].append((model[here], box[here], kept))
                    if n > FEW:
                        break
            open_boxes = [tuple(map(np.concatenate, zip(*x))) for x in left.values()]
            if level + 1 < len(self.levels):
                open_boxes = [(np.repeat(a, 2), np.column_stack([2 * b, 2 * b + 1]).ravel(), np.repeat(c, 2, axis=0)) for a, b, c in open_boxes]
        for model, box, some in _pieces(open_boxes, CELLS // self.rows.shape[2] + 1):
            c = centres[model[:, None], some] - self.levels[-1][0][box][:, None]
            x, square = self.rows[:, box], (c * c).sum(axis=2)
            distances = [sum((x[j] * (-2 * c[:, i, j, None]) for j in range(p)), square[:, i, None]) for i in range(some.shape[1])]
            least = distances[0]
            for d in distances[1:]:
                least = np.minimum(least, d)
            rest, left, columns = self.levels[-1][2][box], distances[0] > least, self.cells[:, box]
            for i, d in enumerate(distances[1:], 1):  # the first centre gets what the others leave
                hit = (d == least) & left
                left &= ~hit
                got = np.stack([np.einsum("ab,ab->a", hit, v) for v in columns], axis=1)
                rest = rest - got
                add(model * k + some[:, i], got)
            add(model * k + some[:, 0], rest)
        out = out.reshape(m, k, p + 2)
        n, s, q = out[:, :, 0], out[:, :, 1:p + 1], out[:, :, p + 1]
        cost = np.zeros((m, k, 1))
        cost[:, 0, 0] = np.maximum(q - 2 * (s * centres).sum(axis=2) + n * (centres * centres).sum(axis=2), 0).sum(axis=1)
        return np.concatenate([out, cost], axis=2)


def _pieces(tables: Iterable[tuple], rows: int) -> Iterable[tuple]:
    for t in tables:
        for at in range(0, len(t[0]), rows):
            yield tuple(x[at:at + rows] for x in t)


def _dealt(points: DataFrame, p: int) -> DataFrame:
    """(s, block, x): the rows of ``points`` (v) by data set, in blocks of a bounded size and in the order of a tree."""
    spark = points.sparkSession
    size = points.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    blocks = -(-size.n * p // BLOCK)
    schema = "s int, block int, x binary"
    arrow = pa.schema([("s", pa.int32()), ("block", pa.int32()), ("x", pa.binary())])

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                x = _matrix(b)
                first, step = zlib.crc32(x.tobytes()) % blocks, min(blocks, 16)
                part = [(s, (first + j) % blocks, x[j::step, s * p:(s + 1) * p].tobytes()) for s in range(x.shape[1] // p) for j in range(step)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    def ordered(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(sorted(t["x"].to_pylist()))).reshape(-1, p)  # in an order of its own, so that a repeated run adds alike
        return pa.table([t["s"][:1], t["block"][:1], pa.array([_ordered(x).tobytes()], pa.binary())], schema=arrow)
    tasks = min(size.width // p * blocks, 64 * spark.sparkContext.defaultParallelism)
    return cut(points.select("v").mapInArrow(run, schema).repartition(tasks, "s", "block").groupBy("s", "block").applyInArrow(ordered, schema))


def _added(dealt: DataFrame, models: dict[tuple[int, int], np.ndarray], p: int) -> dict[tuple[int, int], np.ndarray]:
    """The sums of every model over all rows of ``dealt`` (s, block, x)."""
    schema = "s int, k int, a array<double>"
    arrow = pa.schema([("s", pa.int32()), ("k", pa.int32()), ("a", pa.list_(pa.float64()))])
    by_set = defaultdict(list)
    for s, k in models:
        by_set[s].append(k)

    def run(batches: Iterable[pa.RecordBatch]):
        for b in batches:
            for i in range(b.num_rows):
                s, x = b.column(0)[i].as_py(), np.frombuffer(b.column(1)[i].as_buffer()).reshape(-1, p)
                if not len(x):
                    continue
                tree = _Tree(x) if len(x) * max(by_set[s]) > SMALL else None
                made = [(tree.sums(models[s, k]) if len(x) * k > SMALL else _sums(x, models[s, k])).ravel() for k in by_set[s]]
                yield pa.RecordBatch.from_arrays([pa.array([s] * len(made), pa.int32()), pa.array(by_set[s], pa.int32()),
                                                  pa.array(made, pa.list_(pa.float64()))], schema=arrow)

    def add(t: pa.Table) -> pa.Table:
        a = t["a"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)
        a = a[np.lexsort(a.T[::-1])].sum(axis=0)  # in an order of its own, so that a repeated run adds alike
        return pa.table([t["s"][:1], t["k"][:1], pa.array([a], pa.list_(pa.float64()))], schema=arrow)
    parts = dealt.where(F.col("s").isin(list(by_set))).select("s", "x").mapInArrow(run, schema)
    rows = parts.groupBy("s", "k").applyInArrow(add, schema).collect()  # one per data set and k
    return {(r.s, r.k): np.array(r.a).reshape(-1, r.k, p + 3) for r in rows}


def _started(pool: np.ndarray, spark, sets: int, p: int, ks: Sequence[int], nstart: int, seed: int, rounds: int) -> dict:
    """Centres of every start settled on the pool; one task per few (data set, k)."""
    work = spark.range(sets * len(ks), numPartitions=max(1, min(sets * len(ks), 4 * spark.sparkContext.defaultParallelism)))
    schema = "s int, k int, c array<double>"
    arrow = pa.schema([("s", pa.int32()), ("k", pa.int32()), ("c", pa.list_(pa.float64()))])

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                s, k = i // len(ks), ks[i % len(ks)]
                x = pool[:, s * p:(s + 1) * p]
                centres = _seeded(x, k, nstart if k > 1 else 1, np.random.default_rng([seed, s, k]))
                centres = _distinct(_settled(x, centres, rounds))
                yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([k], pa.int32()), pa.array([centres.ravel()], pa.list_(pa.float64()))], schema=arrow)
    return {(r.s, r.k): np.array(r.c).reshape(-1, r.k, p) for r in work.mapInArrow(run, schema).collect()}


def fit_many(points: DataFrame, p: int, ks: Sequence[int], nstart: int = 25, seed: int = 1, rounds: int = 100) -> dict[tuple[int, int], Fit]:
    """The best start of every data set and k.

    ``points`` has ``id`` and ``v``, an array with the ``p`` coordinates of the row in each data set, one after the other.
    """
    spark, ks = points.sparkSession, list(ks)
    pool = points.select("v").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "v").limit(POOL).toPandas()
    if pool.empty:
        raise ValueError("rows with finite coordinates are needed")
    pool = np.array(pool["v"].tolist(), float)
    models = _started(pool, spark, pool.shape[1] // p, p, ks, nstart, seed, rounds)
    best: dict[tuple[int, int], Fit] = {}
    dealt = _dealt(points, p)
    for turn in range(rounds):
        added = _added(dealt, models, p)
        moving = {}
        for key, centres in models.items():
            sums = added[key]
            new = _moved(centres, sums)
            still = np.abs(new - centres).max(axis=(1, 2)) > 1e-9
            if turn + 1 == rounds:
                still[:] = False
            for i in np.nonzero(~still)[0]:
                cost = float(sums[i, :, p + 2].sum())
                if key not in best or cost < best[key].cost - 1e-12 * abs(cost):
                    order = np.lexsort(np.round(centres[i], 9).T[::-1])
                    n = sums[i, order, 0]
                    best[key] = Fit(*key, centres[i][order], n, sums[i, order, 1:1 + p], sums[i, order, 1 + p], cost)
            if still.any():
                moving[key] = _distinct(new[still])
        models = moving
        if not models:
            break
    discard(dealt)
    return best


def points_of(df: DataFrame, cols: Sequence[str], id_col: str | None = None) -> DataFrame:
    """``id, v`` of the rows with finite columns, one data set; without an id the values name the row."""
    v = F.array(*[F.col(c).cast("double") for c in cols])
    return df.filter(finite(cols)).select((F.col(id_col) if id_col else F.to_json(v)).alias("id"), v.alias("v"))


def nearest(cols: Sequence[str], centres: np.ndarray) -> Column:
    """Number (from 1) of the nearest centre; NULL for a row without finite columns."""
    at = [F.col(c).cast("double") for c in cols]

    def distance(c):
        return sum(((x - float(v)) * (x - float(v)) for x, v in zip(at, c)), F.lit(0.0))
    d = F.array(*[distance(c) for c in centres])
    return F.when(finite(cols), F.array_position(d, F.array_min(d)).cast("int"))


def mean_silhouettes(points: DataFrame, fits: Sequence[Fit]) -> dict[int, float]:
    """Mean silhouette over squared distances of every fit of the first data set, in one pass over the rows."""
    p = fits[0].centres.shape[1]
    schema = "k int, n long, w double"
    arrow = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("w", pa.float64())])

    def widths(x, f):
        near = ((x[:, None] - f.centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.maximum(f.n * (x * x).sum(axis=1)[:, None] - 2 * x @ f.sums.T + f.squares, 0)
        rows = np.arange(len(x))
        own = total[rows, near] / np.maximum(f.n[near] - 1, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            other = np.where(f.n > 0, total / f.n, np.inf)
            other[rows, near] = np.inf
            b = other.min(axis=1)
            w = (b - own) / np.maximum(own, b)
        return np.where((f.n[near] > 1) & np.isfinite(w), w, 0.0)

    def run(batches):
        total = np.zeros((len(fits), 2))
        for batch in batches:
            x = _matrix(batch)[:, :p]
            for at in range(0, len(x), 1 << 14):
                for i, f in enumerate(fits):
                    w = widths(x[at:at + (1 << 14)], f)
                    total[i] += len(w), w.sum()
        yield pa.RecordBatch.from_arrays([pa.array([f.k for f in fits], pa.int32()), pa.array(total[:, 0].astype(np.int64)), pa.array(total[:, 1])], schema=arrow)
    got = points.select("v").mapInArrow(run, schema).groupBy("k").agg((F.sum("w") / F.sum("n")).alias("w")).collect()
    return {r.k: r.w for r in got}
