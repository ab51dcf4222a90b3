"""Convex hulls: of one outline, of a group of points, in two and three axes.

Hulls compose: hull(A u B) = hull(hull(A) u hull(B)).  A group is therefore
reduced in three steps, none of which holds a whole group:

1. a JVM filter drops points strictly inside the polygon of each group's
   extreme points in eight directions (partial aggregation, no data shuffle);
2. each partition reduces its remaining points to one hull per group;
3. the small hulls are merged per (group, salt) and then per group.

Collinear points are not vertices; of equal points the lowest id stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import kernels
from ..functions import outline as O
from ..session import small_side

FLUSH_ROWS = 500_000
SALTS = 64


# ---- numpy helpers ------------------------------------------------------------


def hull_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Positions of the hull vertices, counter-clockwise from the leftmost."""
    order = np.lexsort((y, x))
    keep = np.ones(len(order), bool)
    keep[1:] = (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)
    order = order[keep]
    if len(order) < 3:
        return order
    px, py = x[order].tolist(), y[order].tolist()

    def chain(seq):
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                o, a = out[-2], out[-1]
                if (px[a] - px[o]) * (py[i] - py[o]) - (py[a] - py[o]) * (px[i] - px[o]) > 0:
                    break
                out.pop()
            out.append(i)
        return out
    n = len(order)
    lower, upper = chain(range(n)), chain(range(n - 1, -1, -1))
    return order[lower[:-1] + upper[:-1]]


def polygon_area(x, y) -> float:
    return 0.5 * abs(float(np.dot(x, np.roll(y, -1)) - np.dot(np.roll(x, -1), y)))


def clip_convex(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Intersection of two counter-clockwise convex polygons."""
    out = subject
    for a, b in zip(clip, np.roll(clip, -1, axis=0)):
        if len(out) == 0:
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        nxt, nside = np.roll(out, -1, axis=0), np.roll(side, -1)
        kept = []
        for p, q, s, t in zip(out, nxt, side, nside):
            if s >= 0:
                kept.append(p)
            if (s > 0 > t) or (s < 0 < t):
                kept.append(p + (q - p) * (s / (s - t)))
        out = np.array(kept).reshape(-1, 2)
    return out


def hull_iou(a: np.ndarray, b: np.ndarray) -> float:
    """Area of the intersection over the union of two point sets' hulls."""
    if len(a) < 3 or len(b) < 3:
        return float("nan")
    ha, hb = a[hull_order(a[:, 0], a[:, 1])], b[hull_order(b[:, 0], b[:, 1])]
    if len(ha) < 3 or len(hb) < 3:
        return float("nan")
    c = clip_convex(ha, hb)
    inter = polygon_area(c[:, 0], c[:, 1]) if len(c) >= 3 else 0.0
    union = polygon_area(ha[:, 0], ha[:, 1]) + polygon_area(hb[:, 0], hb[:, 1]) - inter
    return inter / union if union > 0 else float("nan")


def _simplex(p: np.ndarray):
    """Four points that span the most, ``None`` for the plane or line on which all lie, and the plane's two axes."""
    scale = max(float(np.ptp(p, axis=0).max()), 1e-300)
    eps = 1e-12 * scale
    a = int(np.argmin(p[:, 0]))
    b = int(np.argmax(np.linalg.norm(p - p[a], axis=1)))
    line = p[b] - p[a]
    off = np.linalg.norm(np.cross(p - p[a], line), axis=1)
    c = int(np.argmax(off))
    if off[c] <= eps * scale:
        return None, eps, (line, None)
    normal = np.cross(line, p[c] - p[a])
    height = (p - p[a]) @ normal
    d = int(np.argmax(np.abs(height)))
    if abs(height[d]) <= eps * scale * scale:
        return None, eps, (line, np.cross(normal, line))
    return (a, b, c, d), eps, None


def flat_hull(p: np.ndarray) -> np.ndarray:
    """Positions of the hull vertices of points in one plane or on one line."""
    _, _, (line, across) = _simplex(p)
    u = p @ (line / max(float(np.linalg.norm(line)), 1e-300))
    if across is None:
        return np.unique([int(u.argmin()), int(u.argmax())])
    return np.sort(hull_order(u, p @ (across / max(float(np.linalg.norm(across)), 1e-300))))


def hull_facets(p: np.ndarray) -> np.ndarray:
    """Triangles (outward order) of the 3-D hull; empty when it has no volume.

    An inner polytope grows by the farthest point of a facet at a time. Every point outside is kept with one facet that it lies
    above; when facets go, only their points are dealt out to the new ones, and a point above none of them is inside for good.
    """
    empty = np.zeros((0, 3), int)
    if len(p) < 4:
        return empty
    first, eps, _ = _simplex(p)
    if first is None:
        return empty
    inside = p[list(first)].mean(axis=0)

    def oriented(f):
        n = np.cross(p[f[1]] - p[f[0]], p[f[2]] - p[f[0]])
        return (f[0], f[2], f[1]) if n @ (inside - p[f[0]]) > 0 else tuple(f)

    def plane(fs):
        n = np.cross(p[fs[:, 1]] - p[fs[:, 0]], p[fs[:, 2]] - p[fs[:, 0]])
        n = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-300)
        return n, np.einsum("ij,ij->i", n, p[fs[:, 0]])

    def dealt(left, ns, os_):
        out = []
        for n, o in zip(ns, os_):
            above = p[left] @ n - o > eps
            out.append(left[above])
            left = left[~above]
        return out
    a, b, c, d = first
    faces = np.array([oriented(f) for f in ((a, b, c), (a, b, d), (a, c, d), (b, c, d))])
    normals, offsets = plane(faces)
    outside = dealt(np.arange(len(p)), normals, offsets)
    todo = [k for k, o in enumerate(outside) if len(o)]
    while todo:
        k = todo[-1]
        i = int(outside[k][np.argmax(p[outside[k]] @ normals[k])])
        seen = normals @ p[i] - offsets > eps
        seen[k] = True
        edges = {}
        for f in faces[seen]:
            for e in ((f[0], f[1]), (f[1], f[2]), (f[2], f[0])):
                if (e[1], e[0]) in edges:
                    del edges[(e[1], e[0])]
                else:
                    edges[e] = True
        fresh = np.array([(u, v, i) for u, v in edges])
        n2, o2 = plane(fresh)
        orphans = np.concatenate([outside[j] for j in np.flatnonzero(seen)])
        kept = np.flatnonzero(~seen)
        outside = [outside[j] for j in kept] + dealt(orphans[orphans != i], n2, o2)
        faces, normals, offsets = np.vstack([faces[kept], fresh]), np.vstack([normals[kept], n2]), np.concatenate([offsets[kept], o2])
        todo = [j for j, o in enumerate(outside) if len(o)]
    return faces


def facet_volume(p: np.ndarray, faces: np.ndarray) -> float:
    if not len(faces):
        return 0.0
    o = p.mean(axis=0)
    a, b, c = (p[faces[:, k]] - o for k in range(3))
    return float(np.abs(np.einsum("ij,ij->i", a, np.cross(b, c)).sum()) / 6)


# ---- many outlines at a time ----------------------------------------------------


def _chains(x: np.ndarray, y: np.ndarray, order: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower chain of every row at once: positions (rows x points) and how many.

    ``order`` lists each row's points from left to right, the first ``count`` are real. All rows take
    their next point together and drop points together until none of them turns the wrong way.
    """
    rows, n = order.shape
    at = np.arange(rows)
    stack, size = np.zeros((rows, n), np.int64), np.zeros(rows, np.int64)
    for k in range(n):
        live = k < count
        p = order[:, k]
        px, py = x[at, p], y[at, p]
        todo = np.flatnonzero(live & (size > 1))
        while len(todo):
            o, a = stack[todo, size[todo] - 2], stack[todo, size[todo] - 1]
            ox, oy = x[todo, o], y[todo, o]
            turn = (x[todo, a] - ox) * (py[todo] - oy) - (y[todo, a] - oy) * (px[todo] - ox)
            todo = todo[turn <= 0]
            size[todo] -= 1
            todo = todo[size[todo] > 1]
        on = np.flatnonzero(live)
        stack[on, size[on]] = p[on]
        size[on] += 1
    return stack, size


def hull_orders(x: np.ndarray, y: np.ndarray, left: np.ndarray | None = None) -> list[np.ndarray]:
    """:func:`hull_order` of every row of two rows x points arrays; ``left`` masks the points that take part."""
    rows, n = x.shape
    left = np.isfinite(x) & np.isfinite(y) if left is None else left
    order = np.lexsort((y, x, ~left), axis=1)
    sx, sy = np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1)
    fresh = np.take_along_axis(left, order, 1)
    fresh[:, 1:] &= (sx[:, 1:] != sx[:, :-1]) | (sy[:, 1:] != sy[:, :-1])  # of equal points the first stays
    order = np.take_along_axis(order, np.argsort(~fresh, axis=1, kind="stable"), 1)
    count = fresh.sum(axis=1)
    lower, low = _chains(x, y, order, count)
    back = np.take_along_axis(order, np.where(np.arange(n) < count[:, None], count[:, None] - 1 - np.arange(n), np.arange(n)), 1)
    upper, up = _chains(x, y, back, count)
    return [order[i, :count[i]] if count[i] < 3 else np.concatenate([lower[i, :low[i] - 1], upper[i, :up[i] - 1]]) for i in range(rows)]


def _by_length(x: pd.Series, y: pd.Series):
    """Rows of a batch as rows x points arrays of one number of points, at most ``kernels.CHUNK`` cells each."""
    sizes = x.str.len().to_numpy()
    for n in np.unique(sizes[~np.isnan(sizes.astype(float))]):
        at = np.flatnonzero(sizes == n)
        step = max(1, kernels.CHUNK // max(int(n), 1))
        for k in range(0, len(at), step):
            part = at[k:k + step]
            yield part, np.array(x.iloc[part].tolist(), float).reshape(len(part), -1), np.array(y.iloc[part].tolist(), float).reshape(len(part), -1)


def _padded(ids: list[np.ndarray]) -> np.ndarray:
    out = np.full((len(ids), max(map(len, ids), default=0)), -1)
    for i, v in enumerate(ids):
        out[i, :len(v)] = v
    return out


def longest_chords(x: np.ndarray, y: np.ndarray, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length and ends (i < j) of the longest chord between the vertices ``ids`` of every row; the first of equal ones."""
    rows = len(ids)
    best, bi, bj = np.zeros(rows), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    s = _padded([np.sort(v) for v in ids])
    if not s.size:
        return best, bi, bj
    real = s >= 0
    at = np.maximum(s, 0)
    hx, hy = np.where(real, np.take_along_axis(x, at, 1), np.nan), np.where(real, np.take_along_axis(y, at, 1), np.nan)
    bi[:], bj[:] = at[:, 0], at[:, 0]
    line = np.arange(rows)
    for k in range(s.shape[1] - 1):
        d = np.nan_to_num(np.hypot(hx[:, k + 1:] - hx[:, k:k + 1], hy[:, k + 1:] - hy[:, k:k + 1]), nan=-1.0)
        m = d.argmax(axis=1)
        far = d[line, m]
        more = far > best
        best[more], bi[more], bj[more] = far[more], at[more, k], at[line, k + 1 + m][more]
    return best, bi, bj


def _hull_of(coo) -> Column:
    """Struct ``hull`` (vertex indices), ``length, i, j`` (longest chord, i < j).

    The ends of the longest chord are hull vertices, so only those are paired.
    """
    @F.pandas_udf("hull array<int>, length double, i int, j int")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"hull": [None] * len(x), "length": np.nan, "i": 0, "j": 0})
        for part, u, v in _by_length(x, y):
            ids = [np.roll(i, -int(np.argmin(i))) if len(i) else i for i in hull_orders(u, v)]
            length, i, j = longest_chords(u, v, ids)
            for k, h in zip(part, ids):
                out.at[k, "hull"] = h + 1
            out.loc[part, "length"], out.loc[part, "i"], out.loc[part, "j"] = length, i + 1, j + 1
        return out
    return run(coo.getField("x"), coo.getField("y"))


def with_hull(outlines: DataFrame) -> DataFrame:
    """Adds ``hull`` (vertex indices, counter-clockwise from the lowest) and
    ``caliper`` struct ``length, i, j``: the longest chord."""
    return (kernels.hold(outlines, "coo", F.col("coo")).withColumn("_h", _hull_of(F.col("coo"))).withColumn("hull", F.col("_h.hull"))
            .withColumn("caliper", F.struct("_h.length", "_h.i", "_h.j")).drop("_h"))


def onion(outlines: DataFrame, close: bool = True) -> DataFrame:
    """``id, layer, ord, seq``: repeated hulls while more than 3 points stay."""
    @F.pandas_udf("layer array<int>, ord array<int>, seq array<int>")
    def peel(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        none = np.zeros(0, np.int32)
        out: list[tuple] = [(none, none, none)] * len(x)
        for part, u, v in _by_length(x, y):
            found: list[list[np.ndarray]] = [[] for _ in range(len(part))]
            left = np.isfinite(u) & np.isfinite(v)
            rows = np.flatnonzero(left.sum(axis=1) > 3)
            while len(rows):
                for r, ids in zip(rows, hull_orders(u[rows], v[rows], left[rows])):
                    ids = np.roll(ids, -int(np.argmin(ids)))
                    found[r].append(np.append(ids, ids[0]) if close else ids)
                    left[r, ids] = False
                rows = rows[left[rows].sum(axis=1) > 3]
            for k, shown in zip(part, found):
                if shown:
                    sizes = [len(s) for s in shown]
                    out[k] = (np.repeat(np.arange(1, len(shown) + 1, dtype=np.int32), sizes),
                              np.concatenate([np.arange(1, n + 1, dtype=np.int32) for n in sizes]), (np.concatenate(shown) + 1).astype(np.int32))
        return pd.DataFrame(out, columns=["layer", "ord", "seq"])
    c = F.col("coo")
    held = kernels.hold(outlines, "coo", c).withColumn("_l", peel(c.getField("x"), c.getField("y")))
    return held.select("id", "coo", F.explode(F.arrays_zip("_l.layer", "_l.ord", "_l.seq")).alias("l")).select(
        "id", "l.layer", "l.ord", "l.seq", F.element_at(c, F.col("l.seq"))["x"].alias("x"),
        F.element_at(c, F.col("l.seq"))["y"].alias("y"))


# ---- groups of points -------------------------------------------------------------


def _drop_inner(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Drop points strictly inside their group's octagon of extreme points."""
    turns = [k * math.pi / 4 for k in range(8)]
    # directions are taken on axes of comparable spread
    s = df.agg(F.struct(F.stddev_pop(x).alias("x"), F.stddev_pop(y).alias("y")).alias("s")).scalar()
    u = F.col(x) / F.when(F.col("_s.x") > 0, F.col("_s.x")).otherwise(F.lit(1.0))
    v = F.col(y) / F.when(F.col("_s.y") > 0, F.col("_s.y")).otherwise(F.lit(1.0))
    ends = [f for i, t in enumerate(turns) for f in (
        F.max_by(x, u * math.cos(t) + v * math.sin(t)).alias(f"_x{i}"),
        F.max_by(y, u * math.cos(t) + v * math.sin(t)).alias(f"_y{i}"))]
    ext = df.withColumn("_s", s).groupBy(*keys).agg(
        *ends, F.max(F.abs(F.col(x))).alias("_mx"), F.max(F.abs(F.col(y))).alias("_my"))

    # an edge as a x + b y + c > t for points strictly on its left
    def side(i):
        ax, ay, bx, by = (F.col(f"_{c}{j}") for j in (i, (i + 1) % 8) for c in "xy")
        a, b, c = ay - by, bx - ax, (by - ay) * ax - (bx - ax) * ay
        none = (a == 0) & (b == 0)
        tol = 1e-12 * (F.abs(a) * F.col("_mx") + F.abs(b) * F.col("_my") + F.abs(c))
        return none, F.struct(a.alias("a"), b.alias("b"), c.alias("c"), F.when(none, F.lit(-1.0)).otherwise(tol).alias("t"))
    sides = [side(i) for i in range(8)]
    real = sum((F.when(n, F.lit(0)).otherwise(F.lit(1)) for n, _ in sides), F.lit(0))
    lines = ext.select(*keys, F.when(real >= 3, F.struct(*[e.alias(f"e{i}") for i, (_, e) in enumerate(sides)])).alias("_e"))
    marked = df.join(small_side(lines), list(keys)) if keys else df.withColumn("_e", lines.select("_e").scalar())
    left = [F.col(f"_e.e{i}.a") * F.col(x) + F.col(f"_e.e{i}.b") * F.col(y) + F.col(f"_e.e{i}.c") > F.col(f"_e.e{i}.t")
            for i in range(8)]
    inner = reduce(lambda p, q: p & q, left, F.col("_e").isNotNull())
    return marked.filter(~inner).drop("_e")


def _partial(keys, cols, shrink):
    """mapInPandas body keeping one reduced frame per group, flushed by size."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def squeeze():
            whole = pd.concat(held, ignore_index=True)
            if not keys:
                return shrink(whole)
            return pd.concat([shrink(g) for _, g in whole.groupby(list(keys), dropna=False, sort=False)],
                             ignore_index=True)
        for pdf in batches:
            if len(pdf):
                held.append(pdf)
                rows += len(pdf)
            if rows > FLUSH_ROWS:
                small = squeeze()
                if len(small) > FLUSH_ROWS // 2:
                    yield small[cols]
                    held, rows = [], 0
                else:
                    held, rows = [small], len(small)
        if held:
            yield squeeze()[cols]
    return run


def _staged(df, keys, cols, shrink, final, final_schema):
    schema = df.select(*cols).schema
    part = df.select(*cols).mapInPandas(_partial(keys, cols, shrink), schema)
    salted = part.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(SALTS)).cast("int"))
    mid = salted.groupBy(*keys, "_salt").applyInPandas(lambda pdf: shrink(pdf)[cols], schema)
    return mid.groupBy(*keys).applyInPandas(final, final_schema)


def convex_hull(df: DataFrame, keys: Sequence[str], x: str, y: str, row_id: str) -> DataFrame:
    """``keys, ord, id, x, y``: hull vertices per group in clockwise order.

    The first vertex is the leftmost (lowest on ties).  Groups with fewer than
    three distinct points give all of them.
    """
    keys = list(keys)
    cols = [*keys, row_id, x, y]
    kept = _drop_inner(df.select(*cols), keys, x, y)

    def shrink(pdf):
        pdf = pdf.sort_values(row_id, kind="stable").drop_duplicates([x, y])
        return pdf.iloc[hull_order(pdf[x].to_numpy(float), pdf[y].to_numpy(float))]

    def final(pdf):
        out = shrink(pdf)[cols]
        out = pd.concat([out.iloc[:1], out.iloc[:0:-1]])
        out.insert(len(keys), "ord", np.arange(1, len(out) + 1, dtype=np.int32))
        return out
    fields = kept.select(*keys).schema.fields + [T.StructField("ord", T.IntegerType())] + \
        kept.select(row_id, x, y).schema.fields
    return _staged(kept, keys, cols, shrink, final, T.StructType(fields))


def hull_area(df: DataFrame, keys: Sequence[str], x: str, y: str, row_id: str) -> DataFrame:
    """``keys, area``; groups with fewer than three points are dropped."""
    h = convex_hull(df, keys, x, y, row_id)
    ring = F.array_sort(F.collect_list(F.struct("ord", F.col(x).alias("x"), F.col(y).alias("y"))))
    return (h.groupBy(*keys).agg(ring.alias("coo")).filter(F.size("coo") >= 3)
            .select(*keys, O.area(F.col("coo")).alias("area")))


def hull_volume(df: DataFrame, keys: Sequence[str], axes: Sequence[str]) -> DataFrame:
    """``keys, volume, facets`` over three axes; at least four points.

    A partition sends the vertices of its points' hull, of their planar hull if they are flat, or two ends if they lie on a line.
    """
    keys, axes = list(keys), list(axes)
    cols = [*keys, *axes]

    def shrink(pdf):
        pdf = pdf.drop_duplicates(axes)
        p = pdf[axes].to_numpy(float)
        if len(p) < 3:
            return pdf
        faces = hull_facets(p)
        return pdf.iloc[np.unique(faces) if len(faces) else flat_hull(p) if _simplex(p)[0] is None else np.arange(len(p))]

    def final(pdf):
        pdf = pdf.drop_duplicates(axes).sort_values(axes)
        p = pdf[axes].to_numpy(float)
        faces = hull_facets(p)
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "volume": [facet_volume(p, faces)], "facets": [len(faces)]})
    out = T.StructType(df.select(*keys).schema.fields + [
        T.StructField("volume", T.DoubleType()), T.StructField("facets", T.IntegerType())])
    return _staged(df.select(*cols).dropna(), keys, cols, shrink, final, out).filter(F.col("facets") > 0)
