"""Outline functions on ``coo ARRAY<STRUCT<x:DOUBLE,y:DOUBLE>>`` columns.

One outline is one row, so everything here is a narrow, shuffle-free
projection: no function needs a neighbour row.  Indices are 1-based.  Ties
go to the lowest index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from .base import PI, TWO_PI, dbl, div, fmod, fsum, let, lets, lit, pt, zip_named

# ---- access -------------------------------------------------------------


def nb(coo: Column) -> Column:
    """Number of points."""
    return F.size(coo)


def at(coo: Column, i) -> Column:
    return F.element_at(coo, lit(i).cast("int") if isinstance(i, Column) else F.lit(int(i)))


def xs(coo: Column) -> Column:
    return F.transform(coo, lambda p: p["x"])


def ys(coo: Column) -> Column:
    return F.transform(coo, lambda p: p["y"])


def move(coo: Column, fn) -> Column:
    """Apply ``fn(point) -> (x, y)`` to every point."""
    return F.transform(coo, lambda p: pt(*fn(p)))


def with_next(coo: Column) -> Column:
    """Each point's successor, the last one wrapping to the first."""
    return let(coo, lambda c: F.concat(F.slice(c, 2, F.size(c) - 1), F.slice(c, 1, 1)))


def with_prev(coo: Column) -> Column:
    """Each point's predecessor, the first one wrapping to the last."""
    return let(coo, lambda c: F.concat(F.slice(c, -1, 1), F.slice(c, F.lit(1), F.size(c) - 1)))


def dist(p: Column, q: Column) -> Column:
    return F.hypot(p["x"] - q["x"], p["y"] - q["y"])


def is_shape(coo: Column) -> Column:
    """No missing coordinate."""
    return F.coalesce(
        F.forall(coo, lambda p: p["x"].isNotNull() & p["y"].isNotNull()
                 & ~F.isnan(p["x"]) & ~F.isnan(p["y"])), F.lit(False))


def finite(c: Column) -> Column:
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def is_valid_import(coo: Column) -> Column:
    """At least 3 points, all finite."""
    return F.coalesce((F.size(coo) >= 3)
                      & F.forall(coo, lambda p: finite(p["x"]) & finite(p["y"])), F.lit(False))


# ---- position, size -----------------------------------------------------


def centroid(coo: Column) -> Column:
    """Mean of the vertices."""
    return let(coo, lambda c: pt(fsum(c, lambda p: p["x"]) / F.size(c),
                                 fsum(c, lambda p: p["y"]) / F.size(c)))


def _about(coo: Column, body) -> Column:
    """``body(points, centroid)`` with both bound."""
    return let(coo, lambda c: let(centroid(c), lambda m: body(c, m)))


def center(coo: Column) -> Column:
    return _about(coo, lambda c, m: move(c, lambda p: (p["x"] - m["x"], p["y"] - m["y"])))


def centroid_size(coo: Column) -> Column:
    """Root MEAN squared distance to the centroid."""
    return _about(coo, lambda c, m: F.sqrt(
        fsum(c, lambda p: F.pow(p["x"] - m["x"], F.lit(2.0)) + F.pow(p["y"] - m["y"], F.lit(2.0)))
        / F.size(c)))


def centroid_dist(coo: Column) -> Column:
    return _about(coo, lambda c, m: F.transform(c, lambda p: dist(p, m)))


def translate(coo: Column, x=0.0, y=0.0) -> Column:
    return lets(lambda t: move(coo, lambda p: (p["x"] + t["x"], p["y"] + t["y"])), x=dbl(x), y=dbl(y))


def scale(coo: Column, size=None) -> Column:
    """Divide centred coordinates by ``size`` (default centroid size)."""
    def body(c, m):
        s = centroid_size(c) if size is None else dbl(size)
        return let(s, lambda k: move(c, lambda p: (div(p["x"] - m["x"], k) + m["x"],
                                                   div(p["y"] - m["y"], k) + m["y"])))
    return _about(coo, body)


def scale_x(coo: Column, k=1.0) -> Column:
    return move(coo, lambda p: (p["x"] * dbl(k), p["y"]))


def scale_y(coo: Column, k=1.0) -> Column:
    return move(coo, lambda p: (p["x"], p["y"] * dbl(k)))


def bounding_box(coo: Column) -> Column:
    """Struct ``x0, x1, y0, y1``."""
    return let(coo, lambda c: F.struct(
        F.array_min(xs(c)).alias("x0"), F.array_max(xs(c)).alias("x1"),
        F.array_min(ys(c)).alias("y0"), F.array_max(ys(c)).alias("y1")))


def diff_range(coo: Column) -> Column:
    return let(bounding_box(coo), lambda b: pt(b["x1"] - b["x0"], b["y1"] - b["y0"]))


def range_enlarge(coo: Column, k) -> Column:
    return let(bounding_box(coo), lambda b: F.struct(
        (b["x0"] - dbl(k) * (b["x1"] - b["x0"])).alias("x0"),
        (b["x1"] + dbl(k) * (b["x1"] - b["x0"])).alias("x1"),
        (b["y0"] - dbl(k) * (b["y1"] - b["y0"])).alias("y0"),
        (b["y1"] + dbl(k) * (b["y1"] - b["y0"])).alias("y1")))


def template(coo: Column, size=1.0) -> Column:
    """Fit the longest side into ``size`` and centre the bounding box."""
    def body(c):
        return lets(
            lambda b: lets(
                lambda k: move(c, lambda p: (p["x"] * k["k"] + k["dx"], p["y"] * k["k"] + k["dy"])),
                k=b["k"],
                dx=b["k"] * ((b["b"]["x1"] - b["b"]["x0"]) / 2 - b["b"]["x1"]),
                dy=b["k"] * ((b["b"]["y1"] - b["b"]["y0"]) / 2 - b["b"]["y1"])),
            b=bounding_box(c),
            k=let(diff_range(c), lambda d: F.least(div(dbl(size), d["x"]), div(dbl(size), d["y"]))))
    return let(coo, body)


# ---- rotation, alignment --------------------------------------------------


def rotate(coo: Column, theta) -> Column:
    """Counter-clockwise about the origin."""
    return lets(lambda t: move(coo, lambda p: (p["x"] * t["c"] - p["y"] * t["s"],
                                               p["x"] * t["s"] + p["y"] * t["c"])),
                c=F.cos(dbl(theta)), s=F.sin(dbl(theta)))


def rotate_about(coo: Column, theta, cx, cy) -> Column:
    return lets(lambda t: translate(rotate(translate(coo, -t["cx"], -t["cy"]), t["th"]),
                                    t["cx"], t["cy"]),
                cx=dbl(cx), cy=dbl(cy), th=dbl(theta))


def _turn(ax, ay, bx, by) -> Column:
    """Signed angle from vector a to vector b."""
    return F.atan2(ax * by - ay * bx, ax * bx + ay * by)


def untilt(coo: Column, idx=1) -> Column:
    """Rotate about the centroid so that point ``idx`` is level with it."""
    def body(c, m):
        e = at(c, idx)
        theta = _turn(e["x"] - m["x"], e["y"] - m["y"], e["x"] - m["x"], F.lit(0.0))
        return rotate_about(c, theta, m["x"], m["y"])
    return _about(coo, body)


def moments(coo: Column) -> Column:
    """Struct ``sxx, sxy, syy`` with the n-1 divisor."""
    def body(c, m):
        d = F.size(c) - 1
        return F.struct(
            div(fsum(c, lambda p: F.pow(p["x"] - m["x"], F.lit(2.0))), d).alias("sxx"),
            div(fsum(c, lambda p: (p["x"] - m["x"]) * (p["y"] - m["y"])), d).alias("sxy"),
            div(fsum(c, lambda p: F.pow(p["y"] - m["y"], F.lit(2.0))), d).alias("syy"))
    return _about(coo, body)


def axes_of(m: Column) -> Column:
    """Principal axes of a 2x2 covariance: unit vectors u, v and eigenvalues.

    The largest component of every axis is positive (first one on ties).
    """
    def body(t):
        c, s = F.cos(t), F.sin(t)
        fu = F.when(F.abs(c) >= F.abs(s), F.lit(1.0)).otherwise(F.signum(s))
        fv = F.when(F.abs(s) >= F.abs(c), F.signum(-s)).otherwise(F.lit(1.0))
        return F.struct((c * fu).alias("ux"), (s * fu).alias("uy"),
                        (-s * fv).alias("vx"), (c * fv).alias("vy"))
    return let(m, lambda q: let(
        F.atan2(2 * q["sxy"], q["sxx"] - q["syy"]) * 0.5, body))


def eigenvalues(m: Column) -> Column:
    return let(m, lambda q: lets(
        lambda h: F.struct((h["a"] + h["b"]).alias("l1"), (h["a"] - h["b"]).alias("l2")),
        a=(q["sxx"] + q["syy"]) / 2,
        b=F.hypot((q["sxx"] - q["syy"]) / 2, q["sxy"])))


def align(coo: Column) -> Column:
    """Rotate onto the principal axes (no centring)."""
    return let(coo, lambda c: let(axes_of(moments(c)), lambda a: move(c, lambda p: (
        p["x"] * a["ux"] + p["y"] * a["uy"], p["x"] * a["vx"] + p["y"] * a["vy"]))))


def align_x(coo: Column) -> Column:
    return let(align(coo), lambda c: translate(c, 0.0, -centroid(c)["y"]))


def align_min_radius(coo: Column) -> Column:
    """Start at the vertex closest to the centroid, turned onto the x axis.

    The turn is the one the name states: the first vertex ends on the axis.
    """
    def body(c):
        return let(slide(c, which_min(centroid_dist(c))), lambda s: rotate(
            s, let(at(s, 1), lambda p: -F.atan2(p["y"], p["x"]))))
    return let(coo, body)


def bookstein(coo: Column, l1=1, l2=2) -> Column:
    """Map landmark l1 to (-0.5, 0) and l2 to (0.5, 0)."""
    def body(k):
        ux, uy = k["q"]["x"] - k["p"]["x"], k["q"]["y"] - k["p"]["y"]
        return lets(lambda g: move(k["c"], lambda p: (
            div(g["ux"] * (p["x"] - k["p"]["x"]) + g["uy"] * (p["y"] - k["p"]["y"]), g["d2"]) - 0.5,
            div(g["ux"] * (p["y"] - k["p"]["y"]) - g["uy"] * (p["x"] - k["p"]["x"]), g["d2"]))),
            ux=ux, uy=uy, d2=ux * ux + uy * uy)
    return let(coo, lambda c: lets(body, c=c, p=at(c, l1), q=at(c, l2)))


def baseline(coo: Column, l1, l2, t1=(-0.5, 0.0), t2=(0.5, 0.0)) -> Column:
    """Similarity transform taking landmark l1 to t1 and l2 to t2."""
    tx, ty = t2[0] - t1[0], t2[1] - t1[1]
    tlen = (tx * tx + ty * ty) ** 0.5

    def body(k):
        rx, ry = k["q"]["x"] - k["p"]["x"], k["q"]["y"] - k["p"]["y"]
        return lets(lambda g: translate(
            rotate(move(k["c"], lambda p: (div(p["x"] - k["p"]["x"], g["r"]),
                                           div(p["y"] - k["p"]["y"], g["r"]))), g["t"]),
            t1[0], t1[1]),
            r=F.hypot(rx, ry) / F.lit(tlen),
            t=F.atan2(F.lit(float(ty)), F.lit(float(tx))) - F.atan2(ry, rx))
    return let(coo, lambda c: lets(body, c=c, p=at(c, l1), q=at(c, l2)))


def shear_x(coo: Column, k=1.0) -> Column:
    """(x, y + k x): the fixed naming of the result, see README."""
    return move(coo, lambda p: (p["x"], p["y"] + dbl(k) * p["x"]))


def shear_y(coo: Column, k=1.0) -> Column:
    return move(coo, lambda p: (p["x"] + dbl(k) * p["y"], p["y"]))


def flip_x(coo: Column) -> Column:
    return move(coo, lambda p: (p["x"], -p["y"]))


def flip_y(coo: Column) -> Column:
    return move(coo, lambda p: (-p["x"], p["y"]))


# ---- order along the outline ---------------------------------------------


def _best(values: Column, sign: int) -> Column:
    """1-based index of the smallest (sign=1) or largest (-1) value."""
    return F.array_min(F.transform(values, lambda v, i: F.struct(
        (v * sign).alias("v"), (i + 1).alias("i"))))["i"]


def which_min(values: Column) -> Column:
    return _best(values, 1)


def which_max(values: Column) -> Column:
    return _best(values, -1)


def slide(coo: Column, idx) -> Column:
    """Rotate the point order so that ``idx`` comes first; 0 or NULL: as is."""
    i = lit(idx).cast("int")
    return lets(lambda k: F.when(F.coalesce(k["i"], F.lit(0)) == 0, k["c"]).otherwise(
        F.concat(F.slice(k["c"], F.greatest(F.coalesce(k["i"], F.lit(1)), F.lit(1)), F.size(k["c"])),
                 F.slice(k["c"], F.lit(1), F.greatest(F.coalesce(k["i"], F.lit(1)), F.lit(1)) - 1))),
        c=coo, i=i)


def slide_landmarks(ldk: Column, idx, n: Column) -> Column:
    """Landmark indices after ``slide``; an index of 0 becomes 1."""
    return lets(lambda k: F.transform(ldk, lambda l: F.when(
        F.pmod(l - k["i"], k["n"]) == 0, F.lit(1)).otherwise(F.pmod(l - k["i"], k["n"]))),
        i=lit(idx).cast("int"), n=n.cast("int"))


_SIDES = {"down": ("x", "y", -1), "up": ("x", "y", 1), "left": ("y", "x", -1), "right": ("y", "x", 1),
          "S": ("x", "y", -1), "N": ("x", "y", 1), "W": ("y", "x", -1), "E": ("y", "x", 1)}


def direction_index(coo: Column, direction: str) -> Column:
    """Index of the point nearest to the half axis in ``direction``."""
    near, side, sign = _SIDES[direction]
    cand = F.filter(F.transform(coo, lambda p, i: F.struct(
        F.abs(p[near]).alias("d"), (i + 1).alias("i"), (p[side] * sign).alias("s"))),
        lambda e: e["s"] > 0)
    return F.array_min(cand)["i"]


def slide_direction(coo: Column, direction: str, centred: bool = True) -> Column:
    return let(coo, lambda c: slide(c, direction_index(center(c) if centred else c, direction)))


def steps(coo: Column) -> Column:
    """The n-1 distances between successive points (no closing edge)."""
    return let(coo, lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), dist))


def perimeter(coo: Column) -> Column:
    return fsum(steps(coo))


def running(values: Column) -> Column:
    """Cumulative sum starting at 0."""
    return F.aggregate(values, F.array(F.lit(0.0)),
                       lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v)))


def cumulative_perimeter(coo: Column) -> Column:
    return running(steps(coo))


def median_of(values: Column) -> Column:
    return let(F.array_sort(values), lambda s: lets(
        lambda k: (F.element_at(s, k["lo"]) + F.element_at(s, k["hi"])) / 2,
        lo=F.floor((F.size(s) + 1) / 2).cast("int"),
        hi=F.ceil((F.size(s) + 1) / 2).cast("int")))


def slide_gap(coo: Column, force: bool = False) -> Column:
    """Start after the widest step when it exceeds 5 median steps."""
    def body(k):
        w = which_max(k["g"])
        moved = slide(k["c"], w + 1)
        if force:
            return moved
        return F.when(F.array_max(k["g"]) > 5 * median_of(k["g"]), moved).otherwise(k["c"])
    return let(coo, lambda c: lets(body, c=c, g=steps(c)))


def _zip3(a, b, c, fn):
    """zip of three equally long arrays."""
    return F.zip_with(F.zip_with(a, b, lambda u, v: F.struct(u.alias("u"), v.alias("v"))), c,
                      lambda t, w: fn(t["u"], t["v"], w))


def edge_angles(coo: Column, method: str = "atan2") -> Column:
    """Angle at each vertex from the previous to the next edge vector."""
    def angle(p, q, r):
        ax, ay = q["x"] - p["x"], q["y"] - p["y"]
        bx, by = r["x"] - p["x"], r["y"] - p["y"]
        if method == "acos":
            return F.acos(div(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by)))
        return _turn(ax, ay, bx, by)
    return let(unclose(coo), lambda c: _zip3(c, with_prev(c), with_next(c), angle))


def tangent_angles(coo: Column) -> Column:
    """Step direction relative to the first step, minus the circle's, mod 2 pi."""
    def body(a):
        return F.transform(a, lambda t, i: fmod(
            t - F.element_at(a, 1) - F.lit(TWO_PI) * i / F.size(a), TWO_PI))
    return let(coo, lambda c: let(F.zip_with(
        c, with_prev(c), lambda p, q: F.atan2(p["y"] - q["y"], p["x"] - q["x"])), body))


def smooth(coo: Column, n: int) -> Column:
    """``n`` passes of half the point plus a quarter of either neighbour."""
    out = coo
    for _ in range(n):
        out = let(out, lambda c: _zip3(c, with_next(c), with_prev(c), lambda p, a, b: pt(
            p["x"] / 2 + a["x"] / 4 + b["x"] / 4, p["y"] / 2 + a["y"] / 4 + b["y"] / 4)))
    return out


def smooth_curve(coo: Column, n: int) -> Column:
    """``n`` passes over an open curve; each point sees its updated predecessor."""
    def one(c):
        inner = F.zip_with(F.slice(c, F.lit(2), F.size(c) - 2), F.slice(c, F.lit(3), F.size(c) - 2),
                           lambda p, q: F.struct(p.alias("p"), q.alias("q")))
        return F.concat(F.aggregate(inner, F.slice(c, 1, 1), lambda acc, t: F.concat(acc, F.array(
            let(F.element_at(acc, -1), lambda l: pt(
                l["x"] * 0.25 + t["p"]["x"] * 0.5 + t["q"]["x"] * 0.25,
                l["y"] * 0.25 + t["p"]["y"] * 0.5 + t["q"]["y"] * 0.25))))),
            F.slice(c, -1, 1))
    out = coo
    for _ in range(n):
        out = let(out, one)
    return out


def is_closed(coo: Column) -> Column:
    return let(coo, lambda c: (at(c, 1)["x"] == at(c, -1)["x"]) & (at(c, 1)["y"] == at(c, -1)["y"]))


def close(coo: Column) -> Column:
    return let(coo, lambda c: F.when(is_closed(c), c).otherwise(F.concat(c, F.slice(c, 1, 1))))


def unclose(coo: Column) -> Column:
    return let(coo, lambda c: F.when(
        is_closed(c) & (F.size(c) > 1), F.slice(c, F.lit(1), F.size(c) - 1)).otherwise(c))


def force_close(coo: Column) -> Column:
    """Spread the end gap linearly, then restore the centroid."""
    def body(c):
        a, z = at(c, 1), at(c, -1)
        spread = lets(lambda d: F.transform(c, lambda p, i: pt(
            p["x"] + d["x"] * i / F.greatest(F.size(c) - 1, F.lit(1)), p["y"] + d["y"] * i / F.greatest(F.size(c) - 1, F.lit(1)))),
            x=a["x"] - z["x"], y=a["y"] - z["y"])
        moved = let(spread, lambda s: lets(lambda k: translate(
            s, k["m"]["x"] - k["n"]["x"], k["m"]["y"] - k["n"]["y"]),
            m=centroid(c), n=centroid(s)))
        return F.when(is_closed(c), c).otherwise(moved)
    return let(coo, body)


def interpolate_between(p: Column, q: Column, r) -> Column:
    return pt(p["x"] + dbl(r) * (q["x"] - p["x"]), p["y"] + dbl(r) * (q["y"] - p["y"]))


def with_interpolated(df: DataFrame, coo: Column, n, out: str = "resampled") -> DataFrame:
    """Adds ``n`` points at equal spacing along the closed perimeter."""
    held = kernels.hold(df, "_c", F.struct(close(coo).alias("c"), lit(n).cast("int").alias("n")))
    xy = kernels.equal_steps(F.col("_c.c.x"), F.col("_c.c.y"), F.col("_c.n"))
    return held.withColumn("_k", xy).withColumn(out, F.zip_with("_k.x", "_k.y", pt)).drop("_c", "_k")


def sample(coo: Column, n) -> Column:
    """``n`` regularly spaced points, half-even rounding of the index."""
    return let(coo, lambda c: F.when(F.size(c) >= lit(n), F.transform(
        F.sequence(F.lit(0), lit(n).cast("int") - 1), lambda i: F.element_at(
            c, F.rint(1 + i * (F.size(c) - 1) / lit(n)).cast("int"))))
        .otherwise(F.raise_error(F.lit("fewer coordinates than n, use interpolate"))))


def sample_landmarks(ldk: Column, n, size: Column) -> Column:
    return let(lit(n) / size, lambda r: F.transform(ldk, lambda l: F.ceil(l * r).cast("int")))


def sample_prop(coo: Column, prop) -> Column:
    return let(coo, lambda c: sample(c, F.rint(F.size(c) * dbl(prop)).cast("int")))


def sample_angles(coo: Column, n: int) -> Column:
    """For n equally spaced angles the best aligned point, centred, in order."""
    def body(c):
        arg = F.transform(c, lambda p: F.atan2(p["y"], p["x"]))
        return let(arg, lambda a: F.transform(F.array_sort(F.transform(
            F.sequence(F.lit(0), F.lit(n - 1)), lambda i: which_max(
                F.transform(a, lambda t: F.cos(t - i * F.lit(TWO_PI) / n))))),
            lambda j: F.struct(j.alias("j"), F.element_at(c, j)["x"].alias("x"),
                               F.element_at(c, j)["y"].alias("y"))))
    return let(center(coo), body)


def slice_runs(coo: Column, ids: Column) -> Column:
    """Overlapping runs between sorted indices; the last one reaches the end."""
    def body(k):
        return F.transform(k["ids"], lambda a, i: F.slice(
            k["c"], a, F.coalesce(F.get(k["ids"], i + 1), F.size(k["c"])) - a + 1))
    return lets(body, c=coo, ids=F.array_sort(ids))


def trim(coo: Column, k: int) -> Column:
    return let(coo, lambda c: F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - 2 * k, F.lit(0))))


def trim_top(coo: Column, k: int) -> Column:
    return let(coo, lambda c: F.slice(c, F.lit(k + 1), F.greatest(F.size(c) - k, F.lit(0))))


def trim_bottom(coo: Column, k: int) -> Column:
    return let(coo, lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - k, F.lit(0))))


def reverse(coo: Column) -> Column:
    return F.reverse(coo)


def reverse_landmarks(ldk: Column, n: Column) -> Column:
    return let(n + 1, lambda m: F.transform(ldk, lambda l: m - l))


def extract(coo: Column, ids: Column) -> Column:
    return let(coo, lambda c: F.transform(ids, lambda i: F.element_at(c, i)))


def likely_clockwise(coo: Column) -> Column:
    """Share of positive successive argument differences below one half."""
    def body(a):
        d = F.zip_with(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.size(a) - 1),
                       lambda u, v: F.when(u - v > 0, F.lit(1.0)).otherwise(F.lit(0.0)))
        return let(d, lambda e: div(fsum(e), F.size(e))) < 0.5
    return let(F.transform(coo, lambda p: F.atan2(p["y"], p["x"])), body)


def sd_of(values: Column) -> Column:
    return let(values, lambda v: let(fsum(v) / F.size(v), lambda m: F.sqrt(
        fsum(v, lambda e: F.pow(e - m, F.lit(2.0))) / F.when(F.size(v) > 1, F.size(v) - 1))))


def radius_angles(coo: Column) -> Column:
    """Angle at the centroid between each point and the next one."""
    def body(c, m):
        def ang(p, q):
            ax, ay, bx, by = p["x"] - m["x"], p["y"] - m["y"], q["x"] - m["x"], q["y"] - m["y"]
            return F.acos(F.least(F.greatest(
                div(ax * bx + ay * by, F.hypot(ax, ay) * F.hypot(bx, by)), F.lit(-1.0)), F.lit(1.0)))
        return F.zip_with(c, with_next(c), ang)
    return _about(coo, body)


def is_equally_spaced_radii(coo: Column, thres: float = PI / 90) -> Column:
    return sd_of(radius_angles(coo)) < thres


def displacement(coo: Column) -> Column:
    return let(coo, lambda c: let(at(c, 1), lambda o: move(
        c, lambda p: (p["x"] - o["x"], p["y"] - o["y"]))))


def half(coo: Column, side: str, slidegap: bool = False) -> Column:
    test = {"up": lambda p: p["y"] >= 0, "down": lambda p: p["y"] <= 0,
            "right": lambda p: p["x"] >= 0, "left": lambda p: p["x"] <= 0}[side]
    out = F.filter(coo, test)
    return slide_gap(out) if slidegap else out


# ---- distances, intersections ---------------------------------------------


def nearest(p: Column, coo: Column) -> Column:
    """Struct ``d, i``: distance to and index of the closest point."""
    return let(p, lambda q: F.array_min(F.transform(coo, lambda e, i: F.struct(
        F.hypot(e["x"] - q["x"], e["y"] - q["y"]).alias("d"), (i + 1).alias("i")))))


def with_nearest(df: DataFrame, a: Column, b: Column, out: str = "near") -> DataFrame:
    """Adds for every point of ``a`` the nearest of ``b``: struct of arrays ``d, i``."""
    held = kernels.hold(df, "_n", F.struct(a.alias("a"), b.alias("b")))
    return held.withColumn(out, kernels.nearest(
        F.col("_n.a.x"), F.col("_n.a.y"), F.col("_n.b.x"), F.col("_n.b.y"))).drop("_n")


def matched_distance(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, dist)


def ray_index(coo: Column, angle) -> Column:
    """Vertex nearest to where a ray from the centroid leaves the outline.

    The outermost crossing of the ray with an edge is taken.
    """
    def body(c):
        def cross(p, q, u):
            ex, ey = q["x"] - p["x"], q["y"] - p["y"]
            den = u["x"] * ey - u["y"] * ex
            t = div(p["x"] * ey - p["y"] * ex, den)
            s = div(p["x"] * u["y"] - p["y"] * u["x"], den)
            return F.when((den != 0) & (t >= 0) & (s >= 0) & (s <= 1), t)
        u = pt(F.cos(dbl(angle)), F.sin(dbl(angle)))
        far = let(u, lambda v: let(F.array_max(F.zip_with(
            c, with_next(c), lambda p, q: cross(p, q, v))),
            lambda t: pt(v["x"] * t, v["y"] * t)))
        return nearest(far, c)["i"]
    return let(center(coo), body)


def segment_index(coo: Column, x0, y0, x1, y1, centred: bool = True) -> Column:
    """Vertex nearest to the end of the segment clipped by the outline."""
    def body(c):
        dx, dy = dbl(x1) - dbl(x0), dbl(y1) - dbl(y0)

        def cross(p, q):
            ex, ey = q["x"] - p["x"], q["y"] - p["y"]
            den = dx * ey - dy * ex
            px, py = p["x"] - dbl(x0), p["y"] - dbl(y0)
            t = div(px * ey - py * ex, den)
            s = div(px * dy - py * dx, den)
            return F.when((den != 0) & (t >= 0) & (t <= 1) & (s >= 0) & (s <= 1), t)
        end = let(F.array_max(F.zip_with(c, with_next(c), cross)), lambda t: pt(
            dbl(x0) + dx * t, dbl(y0) + dy * t))
        return F.when(end["x"].isNotNull(), nearest(end, c)["i"])
    return let(center(coo) if centred else coo, body)


def to_polar(coo: Column) -> Column:
    return F.transform(coo, lambda p: F.struct(
        F.hypot(p["x"], p["y"]).alias("mod"), F.atan2(p["y"], p["x"]).alias("arg")))


def from_polar(pol: Column) -> Column:
    return F.transform(pol, lambda p: pt(p["mod"] * F.cos(p["arg"]), p["mod"] * F.sin(p["arg"])))


# ---- descriptors ------------------------------------------------------------


def area(coo: Column) -> Column:
    """Closed shoelace, absolute."""
    return let(coo, lambda c: F.abs(fsum(F.zip_with(
        c, with_next(c), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]))) / 2)


def length_width(coo: Column) -> Column:
    """Struct ``length, width``: ranges along the principal axes."""
    return let(diff_range(align(coo)), lambda d: F.struct(
        d["x"].alias("length"), d["y"].alias("width")))


def circularity(coo: Column) -> Column:
    return let(coo, lambda c: div(F.pow(perimeter(c), F.lit(2.0)), area(c)))


def circularity_norm(coo: Column) -> Column:
    return circularity(coo) / (4 * PI)


def circularity_haralick(coo: Column) -> Column:
    return let(centroid_dist(coo), lambda d: div(fsum(d) / F.size(d), sd_of(d)))


def eccentricity_eigen(coo: Column) -> Column:
    return let(eigenvalues(moments(coo)), lambda e: div(e["l2"], e["l1"]))


def eccentricity_box(coo: Column) -> Column:
    return let(length_width(coo), lambda d: div(d["width"], d["length"]))


def elongation(coo: Column) -> Column:
    return F.lit(1.0) - eccentricity_box(coo)


def rectangularity(coo: Column) -> Column:
    return let(coo, lambda c: let(length_width(c), lambda d: div(area(c), d["length"] * d["width"])))


def with_rectilinearity(df: DataFrame, coo: Column, out: str = "rectilinearity") -> DataFrame:
    """Smallest rotated city-block perimeter over 4n candidate turns.

    |cos|+|sin| of the turned edge weighs each edge; vertex angles stand for
    edge directions.
    """
    edges = let(unclose(coo), lambda c: zip_named(l=F.zip_with(c, with_next(c), dist), t=edge_angles(c)))
    least = kernels.least_rotated_perimeter(F.col("_e.l"), F.col("_e.t"), [PI / 2, PI, 3 * PI / 2, TWO_PI])
    return kernels.hold(df, "_e", edges).withColumn("_p", least).withColumn(
        out, F.lit(4 / (4 - PI)) * (div(fsum(F.col("_e.l")), F.col("_p")) - PI / 4)).drop("_e", "_p")


# ---- chain code ----------------------------------------------------------


def chain_code(pix: Column) -> Column:
    """Freeman codes 0-7 of unit pixel steps; anything else raises."""
    def code(p, q):
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        ok = (F.greatest(F.abs(dx), F.abs(dy)) == 1)
        turn = F.round(F.atan2(dy.cast("double"), dx.cast("double")) / (PI / 4)).cast("int")
        return F.when(ok, F.pmod(turn, F.lit(8))).otherwise(
            F.raise_error(F.lit("successive pixels must differ by one step")).cast("int"))
    return let(pix, lambda c: F.zip_with(
        F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), code))


def chain_decode(codes: Column) -> Column:
    """Pixel positions as running sums of the code steps."""
    def step(c):
        return F.struct(F.rint(F.cos(c * F.lit(PI / 4)) * 1.0).cast("int").alias("x"),
                        F.rint(F.sin(c * F.lit(PI / 4)) * 1.0).cast("int").alias("y"))
    return F.slice(F.aggregate(F.transform(codes, step), F.array(F.struct(
        F.lit(0).alias("x"), F.lit(0).alias("y"))), lambda acc, s: F.concat(acc, F.array(
            let(F.element_at(acc, -1), lambda l: F.struct(
                (l["x"] + s["x"]).alias("x"), (l["y"] + s["y"]).alias("y")))))),
        F.lit(2), F.greatest(F.size(codes), F.lit(0)))
