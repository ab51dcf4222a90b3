"""Occupied cells of many perturbed bootstrap samples, without moving a point.

Which runs draw a row, how often, and where the noise of every draw puts it follow from the row's own key (``functions.draws``),
so a task needs its own rows only: no index, no join, no shuffle of draws.  For a (pair, run) it marks the
cells that its draws occupy, one bit per noise draw, and sends the words of a block of cells; words of all tasks
are joined with OR, then counted.  What moves is cells x draws / 64 words per task at most, whatever the number of points.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws

BLOCK = 1024  # cells whose words travel together
CHUNK = 1 << 16  # draws placed at a time


def _uniforms(h: np.ndarray) -> list[np.ndarray]:
    h = np.asarray(h).astype(np.uint32)
    return [draws.mixed_32(h, i) / 4294967296.0 for i in range(1, 5)]


def placed(x: np.ndarray, y: np.ndarray, h: np.ndarray, reach: tuple[float, float], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions moved by the noise of the draws ``h``."""
    u = _uniforms(h)
    if kind == "uniform":
        return x + (u[0] * 2 - 1) * reach[0], y + (u[2] * 2 - 1) * reach[1]

    def normal(a, b):
        return np.sqrt(-2.0 * np.log(np.maximum(a, 2.0 ** -33))) * np.cos(2 * np.pi * b)
    return x + normal(u[0], u[1]) * (reach[0] / 1.96), y + normal(u[2], u[3]) * (reach[1] / 1.96)


def rough(kind: str, h: np.ndarray, first: int, second: int) -> np.ndarray:
    """The noise of :func:`placed` on one axis, in shares of its reach and single precision."""
    u = draws.mixed_32(h, first).astype(np.float32)
    u *= np.float32(2.0 ** -32)
    if kind == "uniform":
        return u * 2 - 1
    v = draws.mixed_32(h, second).astype(np.float32)
    v *= np.float32(2 * np.pi * 2.0 ** -32)
    np.log(np.maximum(u, np.float32(2.0 ** -33), out=u), out=u)
    u *= np.float32(-2 / 1.96 ** 2)
    return np.sqrt(u, out=u) * np.cos(v, out=v)


def _covered(x: np.ndarray, y: np.ndarray, g: dict, resolution: int, radius: float):
    """(draw, cell) of all cells with a centre within ``radius`` cell sizes; a cell is ix * resolution + iy."""
    r = radius * g["cell"]

    def first(v, origin, step):
        if not step:  # an axis without extent: every line of cells lies on it
            return np.zeros(len(v)), resolution
        return np.ceil((v - r - origin) / step), int(2 * r / step) + 1
    (low_x, wide_x), (low_y, wide_y) = first(x, g["gx0"], g["dx"]), first(y, g["gy0"], g["dy"])
    down = [(iy, (g["gy0"] + iy * g["dy"] - y) ** 2, (iy >= 0) & (iy < resolution)) for iy in (low_y + j for j in range(wide_y))]
    for i in range(wide_x):
        ix = low_x + i
        across = (g["gx0"] + ix * g["dx"] - x) ** 2
        inside = (ix >= 0) & (ix < resolution)
        for iy, height, within in down:
            at = np.flatnonzero(inside & within & (across + height <= r * r))
            yield at, (ix[at] * resolution + iy[at]).astype(np.int64)


SCRATCH = 64 << 20  # bytes of marks by corners; a finer grid goes by sorted codes


class _Marks:
    """One bit per (cell, noise draw) of a grid."""

    def __init__(self, cells: int, words: int):
        self.cells, self.words = cells, words
        self.packed = np.zeros(cells * words, np.uint64)

    def add(self, x: np.ndarray, y: np.ndarray, m: np.ndarray, g: dict, resolution: int, radius: float) -> None:
        """Marks what the draws ``m`` (from 0) at (x, y) cover."""
        for i, cell in _covered(x, y, g, resolution, radius):
            if len(i):
                codes = np.unique(cell * (self.words * 64) + m[i])
                word = codes >> 6
                start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
                self.packed[word[start]] |= np.bitwise_or.reduceat(np.uint64(1) << (codes & 63).astype(np.uint64), start)

    def table(self) -> np.ndarray:
        return self.packed.view(np.int64).reshape(self.cells, self.words)


RENEW = 1 << 18  # draws before crowded cells are looked for


class _ByteMarks:
    """The same marks as a byte per draw, on a grid with a margin as wide as what a draw reaches.

    A draw reaches the square of cells from a low corner on. Where the squares of a corner and of the corners beside it are all marked
    for a noise draw, nothing is left to mark: ``done`` has these corners, and a rough place (within a cell) tells which draws
    need no exact one. It is renewed when the draws have doubled.
    """

    def __init__(self, g: dict, resolution: int, words: int, radius: float):
        self.r = radius * g["cell"]
        self.x, self.y = ((g[f"g{c}0"], g[f"d{c}"], int(2 * self.r / g[f"d{c}"]) + 1) for c in "xy")
        self.inner, self.draws, self.margin = resolution, words * 64, (self.x[2] + 1, self.y[2] + 1)
        self.wide = resolution + 2 * self.margin[0], resolution + 2 * self.margin[1]
        self.seen = np.zeros((*self.wide, self.draws), np.bool_)
        self.done: np.ndarray | None = None
        self.taken, self.renew = 0, RENEW

    @staticmethod
    def fits(g: dict, resolution: int, words: int, radius: float) -> bool:
        if not (g["dx"] > 0 and g["dy"] > 0):  # an axis without extent
            return False
        wide = [resolution + 2 * (int(2 * radius * g["cell"] / g[step]) + 2) for step in ("dx", "dy")]
        return 4 * words * 64 * wide[0] * wide[1] <= SCRATCH

    def _inner(self, of: np.ndarray) -> np.ndarray:
        (a, b), n = self.margin, self.inner
        return of[a:a + n, b:b + n]

    def _renew(self) -> None:
        done = np.ones_like(self.seen)  # the margin needs no marks
        self._inner(done)[:] = self._inner(self.seen)
        for n, axis in ((self.x[2], 0), (self.y[2], 1)):
            cells = np.moveaxis(done, axis, 0)
            ahead = cells.copy()
            for i in range(1, n + 1):
                cells[:-i] &= ahead[i:]
            cells[1:] &= ahead[:-1]
        self.done, self.taken, self.renew = done.ravel(), 0, 2 * self.renew

    def open(self, x: np.ndarray, y: np.ndarray, h: np.ndarray, reach: tuple[float, float], kind: str) -> np.ndarray:
        """Which draws ``h`` (rows, draws) of the rows at (x, y) may still have something to mark."""
        self.taken += h.size
        if self.taken > self.renew:
            self._renew()
        if self.done is None:
            return np.arange(h.size)

        def corner(v, axis, span, wide, first, second):
            origin, step, n = axis
            moved = rough(kind, h, first, second) * np.float32(span / step)
            moved += ((v - self.r - origin) / step).astype(np.float32)[:, None]
            low = np.fmin(np.fmax(np.ceil(moved, out=moved), -n - 1), self.inner, out=moved)
            return low.astype(np.int32) + np.int32(n + 1)
        code = corner(x, self.x, reach[0], self.wide[0], 1, 2) * np.int32(self.wide[1])
        code += corner(y, self.y, reach[1], self.wide[1], 3, 4)
        code *= np.int32(self.draws)
        code += np.arange(h.shape[1], dtype=np.int32)
        return np.flatnonzero(~self.done.take(code.ravel()))

    def add(self, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> None:
        """Marks what the draws ``m`` (from 0) at (x, y) cover."""
        r, (gx0, dx, nx), (gy0, dy, ny) = self.r, self.x, self.y

        def low(v, origin, step, n):  # what lies beyond the margin is held to it
            first = np.ceil((v - r - origin) / step)
            return first, np.fmin(np.fmax(first, -n), self.inner).astype(np.int64) + n + 1
        (low_x, ix), (low_y, iy) = low(x, gx0, dx, nx), low(y, gy0, dy, ny)
        code = (ix * self.wide[1] + iy) * self.draws + m
        seen = self.seen.ravel()
        down = [(gy0 + (low_y + j) * dy - y) ** 2 for j in range(ny)]
        for i in range(nx):
            across = (gx0 + (low_x + i) * dx - x) ** 2
            for j in range(ny):
                seen[code[across + down[j] <= r * r] + (i * self.wide[1] + j) * self.draws] = True

    def table(self) -> np.ndarray:
        inner = np.ascontiguousarray(self._inner(self.seen))
        return np.packbits(inner, bitorder="little").view("<u8").view(np.int64).reshape(-1, self.draws // 64)


def occupied(points: DataFrame, grid_table: DataFrame, resolution: int, runs: int, mc: int, uncertainty: float, seed: int,
             rate: float | None, radius: float = 1.5, kind: str = "gaussian") -> DataFrame:
    """``pair, b, block, hits``: per run and block of cells, in how many of ``mc`` noise draws each cell is occupied.

    With a ``rate`` every run draws each row a Poisson number of times; without, every run holds each row once.
    """
    words = -(-mc // 64)
    steps = np.array(draws.poisson_steps(rate)) if rate is not None else None
    grids = {r.pair: r.asDict() for r in grid_table.collect()}  # one row per pair of axes
    keyed = points.select("pair", "x", "y", draws.key(F.lit(seed), F.col("pair"), F.col("id")).alias("h"))
    arrow = pa.schema([("pair", pa.string()), ("b", pa.int32()), ("block", pa.int32()), ("w", pa.list_(pa.int64()))])

    def marks(x, y, h, b, g):
        """Words (cells, words) of one run over the rows of this task."""
        times = np.ones(len(h), np.int64) if steps is None else np.searchsorted(steps, draws.mixed_np(h, b) / 4294967296.0, "right")
        row = np.repeat(np.arange(len(h)), times)
        copy = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        base = draws.mixed_32(h[row].astype(np.uint32), b, copy)[:, None]
        quick = _ByteMarks.fits(g, resolution, words, radius)
        found = _ByteMarks(g, resolution, words, radius) if quick else _Marks(resolution * resolution, words)
        reach = uncertainty * g["span_x"], uncertainty * g["span_y"]
        per = max(1, CHUNK // mc)
        m = np.arange(1, mc + 1)
        for at in range(0, len(row), per):
            part = row[at:at + per]
            drawn = draws.mixed_32(base[at:at + per], m)
            left = found.open(x[part], y[part], drawn, reach, kind) if quick else np.arange(drawn.size)
            own, noise = part[left // mc], left % mc
            px, py = placed(x[own], y[own], drawn.ravel()[left], reach, kind)
            found.add(px, py, noise) if quick else found.add(px, py, noise, g, resolution, radius)
        return found.table()

    def run(batches: Iterable[pa.RecordBatch]):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        whole = pa.Table.from_batches(batches)  # the rows of one input split, 32 bytes each
        for pair in whole["pair"].unique().to_pylist():
            own = whole.filter(pc.equal(whole["pair"], pair))
            x, y = (own[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("x", "y"))
            h = own["h"].combine_chunks().to_numpy(zero_copy_only=False)
            for b in range(1, runs + 1):
                found = marks(x, y, h, b, grids[pair])
                blocks = [(k, found[k * BLOCK:(k + 1) * BLOCK]) for k in range(-(-len(found) // BLOCK))]
                blocks = [(k, w.ravel()) for k, w in blocks if w.any()]
                for at in range(0, len(blocks), 64):
                    part = blocks[at:at + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([pair] * len(part)), pa.array([b] * len(part), pa.int32()), pa.array([k for k, _ in part], pa.int32()),
                                                      pa.array([w for _, w in part], pa.list_(pa.int64()))], schema=arrow)
    out = pa.schema([("pair", pa.string()), ("b", pa.int32()), ("block", pa.int32()), ("hits", pa.list_(pa.int32()))])

    def join(t: pa.Table) -> pa.Table:
        w = np.zeros(1, np.int64)
        for chunk in t["w"].chunks:
            for one in chunk:
                w = w | np.asarray(one.values)
        hits = np.bitwise_count(w.view(np.uint64)).reshape(-1, words).sum(axis=1, dtype=np.int32)
        return pa.table([t["pair"][:1], t["b"][:1], t["block"][:1], pa.array([hits], pa.list_(pa.int32()))], schema=out)
    sent = keyed.mapInArrow(run, "pair string, b int, block int, w array<long>")
    return sent.groupBy("pair", "b", "block").applyInArrow(join, "pair string, b int, block int, hits array<int>")


def occupied_counts(points: DataFrame, grid_table: DataFrame, resolution: int, runs: int, mc: int, uncertainty: float, seed: int,
                    rate: float | None, radius: float = 1.5, kind: str = "gaussian") -> DataFrame:
    """``pair, ix, iy, hits, full``: occupied draws over all runs, and runs with at least half of their draws occupied."""
    blocks = occupied(points, grid_table, resolution, runs, mc, uncertainty, seed, rate, radius, kind)
    arrow = pa.schema([("pair", pa.string()), ("ix", pa.int32()), ("iy", pa.int32()), ("hits", pa.int64()), ("full", pa.int64())])

    def add(t: pa.Table) -> pa.Table:
        hits = np.stack([np.asarray(one.values) for chunk in t["hits"].chunks for one in chunk]).astype(np.int64)  # one row per run
        total, full = hits.sum(axis=0), (1 - hits / mc <= 0.5).sum(axis=0)
        at = np.flatnonzero(total)
        cell = t["block"][0].as_py() * BLOCK + at
        return pa.table([pa.array([t["pair"][0].as_py()] * len(at), pa.string()), pa.array(cell // resolution, pa.int32()), pa.array(cell % resolution, pa.int32()),
                         pa.array(total[at]), pa.array(full[at], pa.int64())], schema=arrow)
    return blocks.groupBy("pair", "block").applyInArrow(add, "pair string, ix int, iy int, hits long, full long")
