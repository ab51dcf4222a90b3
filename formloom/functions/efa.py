"""Elliptic Fourier analysis as array expressions.

``harm ARRAY<STRUCT<a,b,c,d>>`` holds one entry per harmonic, ``coe
ARRAY<DOUBLE>`` the same numbers as ``a1..an b1..bn c1..cn d1..dn``.  Forward
and inverse transforms stay inside one row, so a set of any size is a single
map stage; both are products of points and harmonics and run as batch kernels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels
from . import outline as O
from .base import PI, dbl, div, fmod, fsum, let, lets, lit, pt

LETTERS = ("a", "b", "c", "d")


def abcd(a, b, c, d) -> Column:
    return F.struct(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"))


def with_forward(df: DataFrame, nb_h, coo="coo", out: str = "ef", smooth_it: int = 0) -> DataFrame:
    """Adds struct ``harm, ao, co``; ``nb_h`` is capped at half the point count.

    ``coo`` is a column name or an outline expression.
    """
    shape = O.unclose(coo if isinstance(coo, Column) else F.col(coo))
    if smooth_it:
        shape = O.smooth(shape, smooth_it)
    raw = kernels.fourier(F.col("_s.x"), F.col("_s.y"), lit(nb_h).cast("int"))
    k = F.col("_k")
    return (kernels.hold(df, "_s", shape).withColumn("_k", raw).drop("_s").withColumn(out, F.struct(
        harmonics(k["a"], k["b"], k["c"], k["d"]).alias("harm"),
        k["ao"].alias("ao"), k["co"].alias("co"))).drop("_k"))


def harmonics(a, b, c, d) -> Column:
    """Array of ``a, b, c, d`` structs from four arrays."""
    return F.transform(a, lambda v, i: abcd(v, F.get(b, i), F.get(c, i), F.get(d, i)))


def normalise(ef: Column, start: bool = False) -> Column:
    """First-ellipse normalisation; adds ``size, theta, psi``.

    With ``start`` the phase is kept (theta 0) and only size and rotation go.
    """
    def body(k):
        h1 = F.element_at(k["harm"], 1)
        a, b, c, d = (h1[x] for x in LETTERS)
        raw = F.lit(0.5) * fmod(F.atan(
            div(2 * (a * b + c * d), a * a + c * c - b * b - d * d)), PI)

        def settle(t):
            v1 = F.pow(a * F.cos(t) + b * F.sin(t), F.lit(2.0)) + F.pow(c * F.cos(t) + d * F.sin(t), F.lit(2.0))
            v2 = F.pow(b * F.cos(t) - a * F.sin(t), F.lit(2.0)) + F.pow(d * F.cos(t) - c * F.sin(t), F.lit(2.0))
            return fmod(t + F.when(v1 < v2, F.lit(PI / 2)).otherwise(F.lit(0.0)) + PI / 2, PI) - PI / 2

        def shape(t):
            aa = a * F.cos(t) + b * F.sin(t)
            cc = c * F.cos(t) + d * F.sin(t)
            return F.struct(
                F.hypot(aa, cc).alias("size"),
                (F.lit(0.0) if start else t).alias("theta"),
                (fmod(F.atan(div(cc, aa)), PI) + F.when(aa < 0, F.lit(PI)).otherwise(F.lit(0.0))).alias("psi"))
        return let(let(let(raw, settle), shape), lambda s: F.struct(
            _turn(k["harm"], s["theta"], s["psi"], div(F.lit(1.0), s["size"]), 1).alias("harm"),
            s["size"].alias("size"), s["theta"].alias("theta"), s["psi"].alias("psi"),
            k["ao"].alias("ao"), k["co"].alias("co")))
    return let(ef, body)


def _turn(harm, theta, psi, factor, sign) -> Column:
    """factor * R(-sign psi) * M_i * R(sign i theta) for every harmonic."""
    def one(m, i, g):
        ct, st = F.cos((i + 1) * g["t"]), F.sin((i + 1) * g["t"]) * sign
        phased = abcd(m["a"] * ct + m["b"] * st, m["b"] * ct - m["a"] * st,
                      m["c"] * ct + m["d"] * st, m["d"] * ct - m["c"] * st)
        return let(phased, lambda q: abcd(
            g["f"] * (g["c"] * q["a"] + g["s"] * q["c"]), g["f"] * (g["c"] * q["b"] + g["s"] * q["d"]),
            g["f"] * (g["c"] * q["c"] - g["s"] * q["a"]), g["f"] * (g["c"] * q["d"] - g["s"] * q["b"])))
    return lets(lambda g: F.transform(harm, lambda m, i: one(m, i, g)),
                t=theta, f=factor, c=F.cos(psi), s=F.sin(psi) * sign)


def denormalise(norm: Column) -> Column:
    """Undo ``normalise``: inverse rotation, phase and scale."""
    return let(norm, lambda k: F.struct(
        _turn(k["harm"], k["theta"], k["psi"], k["size"], -1).alias("harm"),
        k["ao"].alias("ao"), k["co"].alias("co")))


def make_positive(harm: Column) -> Column:
    """Negate everything when the first coefficient is negative."""
    return let(harm, lambda g: let(
        F.when(F.element_at(g, 1)["a"] < 0, F.lit(-1.0)).otherwise(F.lit(1.0)),
        lambda s: F.transform(g, lambda m: abcd(*[m[x] * s for x in LETTERS]))))


def to_coe(harm: Column) -> Column:
    """Dense vector, values below 1e-12 set to 0."""
    flat = let(harm, lambda g: F.concat(*[g.getField(x) for x in LETTERS]))
    return F.transform(flat, lambda v: F.when(F.abs(v) < 1e-12, F.lit(0.0)).otherwise(v))


def from_coe(coe: Column) -> Column:
    return let(coe, lambda v: let(F.floor(F.size(v) / 4).cast("int"), lambda n: F.transform(
        F.sequence(F.lit(1), n), lambda h: abcd(
            F.element_at(v, h), F.element_at(v, n + h),
            F.element_at(v, 2 * n + h), F.element_at(v, 3 * n + h)))))


def with_inverse(df: DataFrame, harm="harm", ao=0.0, co=0.0, nb_h=None, nb_pts: int = 120,
                 out: str = "shape") -> DataFrame:
    """Adds the outline of ``nb_pts`` points from the first ``nb_h`` harmonics."""
    h = harm if isinstance(harm, Column) else F.col(harm)
    h = h if nb_h is None else F.slice(h, F.lit(1), lit(nb_h))
    xy = kernels.inverse_fourier(*[F.col(f"_g.{x}") for x in LETTERS], dbl(ao), dbl(co), nb_pts)
    return (kernels.hold(df, "_g", h).withColumn("_k", xy).drop("_g")
            .withColumn(out, F.zip_with("_k.x", "_k.y", pt)).drop("_k"))


def power(harm: Column) -> Column:
    """Harmonic power."""
    return F.transform(harm, lambda m: (
        m["a"] * m["a"] + m["b"] * m["b"] + m["c"] * m["c"] + m["d"] * m["d"]) / 2)


def cumulative_power(harm: Column, drop: int = 1) -> Column:
    """Cumulative percentage of power from harmonic ``drop + 1`` on."""
    def body(p):
        return let(fsum(p), lambda total: F.transform(
            F.slice(O.running(p), F.lit(2), F.size(p)), lambda c: div(c, total) * 100))
    return let(power(harm), lambda p: let(
        F.slice(p, F.lit(drop + 1), F.greatest(F.size(p) - drop, F.lit(0))), body))


def symmetry(coe: Column) -> Column:
    """Struct ``AD, BC, amp, sym``."""
    return let(from_coe(coe), lambda g: lets(lambda k: F.struct(
        k["ad"].alias("AD"), k["bc"].alias("BC"), (k["ad"] + k["bc"]).alias("amp"),
        div(k["ad"], k["ad"] + k["bc"]).alias("sym")),
        ad=fsum(g, lambda m: F.abs(m["a"]) + F.abs(m["d"])),
        bc=fsum(g, lambda m: F.abs(m["b"]) + F.abs(m["c"]))))


def remove_asymmetry(harm: Column) -> Column:
    return F.transform(harm, lambda m: abcd(m["a"], F.lit(0.0), F.lit(0.0), m["d"]))


def remove_symmetry(harm: Column) -> Column:
    return F.transform(harm, lambda m: abcd(F.lit(0.0), m["b"], m["c"], F.lit(0.0)))


def select_harmonics(coe: Column, retain: int, drop: int, nb_h: int, cph: int = 4) -> Column:
    """Positions drop+1..retain of each of the ``cph`` blocks."""
    return F.concat(*[F.slice(coe, 1 + drop + i * nb_h, retain - drop) for i in range(cph)])


def split_blocks(coe: Column, nb_h: int, cph: int = 4) -> Column:
    return F.struct(*[F.slice(coe, 1 + i * nb_h, nb_h).alias(n) for i, n in enumerate(
        ("an", "bn", "cn", "dn")[:cph])])


def normalise_shape(coo: Column, start_point: str, caliper=None) -> Column:
    """Centre, scale, optionally lay on the longest chord, choose the start.

    ``caliper`` is the struct of ``operators.hull.with_caliper`` (its two
    indices do not change under centring and scaling).
    """
    c = O.scale(O.center(coo))
    if caliper is not None:
        c = O.bookstein(c, caliper["i"], caliper["j"])
    return O.slide_direction(c, start_point, centred=True)


# ---- sets -------------------------------------------------------------------


def efourier(outlines: DataFrame, nb_h: int, smooth_it: int = 0, norm: bool = True,
             start: bool = False, cap: bool = True) -> DataFrame:
    """Coefficients of a set: keeps all columns but ``coo``, adds ``coe``.

    Every outline gets the same number of harmonics, at most
    floor(min(points)/2)-1 over the whole set: one scalar aggregate.
    """
    h = F.lit(nb_h)
    if cap:
        h = F.least(h, outlines.agg((F.floor(F.min(F.size("coo")) / 2) - 1).cast("int").alias("q")).scalar())
    keep = [c for c in outlines.columns if c != "coo"]
    ef = with_forward(outlines.withColumn("_h", h), F.col("_h"), smooth_it=smooth_it)
    harm = (make_positive(normalise(F.col("ef"), start)["harm"]) if norm else F.col("ef.harm"))
    return ef.select(*keep, to_coe(harm).alias("coe"))


def long_coefficients(coefs: DataFrame, key: str = "id") -> DataFrame:
    """``(key, letter, h, value)``."""
    def rows(v):
        n = (F.size(v) / 4).cast("int")
        return let(n, lambda n: F.transform(v, lambda e, i: F.struct(
            F.element_at(F.array(*[F.lit(x) for x in "ABCD"]), F.floor(i / n).cast("int") + 1).alias("letter"),
            (i % n + 1).alias("h"), e.alias("value"))))
    return coefs.select(key, F.explode(let(F.col("coe"), rows)).alias("r")).select(key, "r.*")
