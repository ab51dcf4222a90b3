"""Confidence ellipses of point groups from their moments."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import outline as O
from ..functions.base import TWO_PI, div, let, pt
from ..session import cut, small_side
from .tables import covariance


def f_quantile_2(level: float, m):
    """Quantile of the F distribution with 2 and ``m`` degrees of freedom."""
    return m / 2 * (F.pow(F.lit(1 - level), F.lit(-2.0) / m) - 1)


def _rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("ell").alias("_s", "p")).select(
        *keys, (F.col("_s") + 1).cast("int").alias("seq"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def confidence_ellipse(df: DataFrame, keys: Sequence[str], x: str, y: str, conf: float = 0.95,
                       nb_pts: int = 60) -> DataFrame:
    """``keys, seq, x, y``: normal-quantile radius, axes from sd and correlation."""
    rad = NormalDist().inv_cdf(1 - (1 - conf) / 2)
    m = covariance(df, keys, x, y)
    a, b = F.sqrt(F.col("sxx") * (1 + F.col("r")) / 2), F.sqrt(F.col("sxx") * (1 - F.col("r")) / 2)
    c, d = F.sqrt(F.col("syy") * (1 + F.col("r")) / 2), F.sqrt(F.col("syy") * (1 - F.col("r")) / 2)
    k = m.select(*keys, F.struct("mx", "my", a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d")).alias("k"))
    ell = let(F.col("k"), lambda k: F.transform(F.sequence(F.lit(0), F.lit(nb_pts - 1)), lambda i: let(
        i * F.lit(TWO_PI) / nb_pts, lambda t: pt(
            k["mx"] + rad * (k["a"] * F.cos(t) - k["b"] * F.sin(t)),
            k["my"] + rad * (k["c"] * F.cos(t) + k["d"] * F.sin(t))))))
    return _rows(k.withColumn("ell", ell), list(keys))


def _from_moments(m: DataFrame, keys: Sequence[str], radius, segments: int) -> DataFrame:
    """Unit circle through the Cholesky factor of (sxx, sxy, syy)."""
    l11 = F.sqrt("sxx")
    l12 = div(F.col("sxy"), l11)
    l22 = F.sqrt(F.greatest(F.col("syy") - l12 * l12, F.lit(0.0)))
    k = m.select(*keys, F.struct("mx", "my", l11.alias("a"), l12.alias("b"), l22.alias("d"),
                                 radius.alias("r")).alias("k"))
    ell = let(F.col("k"), lambda k: F.transform(F.sequence(F.lit(0), F.lit(segments)), lambda i: let(
        i * F.lit(TWO_PI) / segments, lambda t: pt(
            k["mx"] + k["r"] * k["a"] * F.cos(t),
            k["my"] + k["r"] * (k["b"] * F.cos(t) + k["d"] * F.sin(t))))))
    return _rows(k.withColumn("ell", ell), list(keys))


def group_ellipse(df: DataFrame, keys: Sequence[str], x: str, y: str, kind: str = "norm", level: float = 0.95,
                  segments: int = 51) -> DataFrame:
    """``keys, seq, x, y`` for ``norm``, ``t`` (robust covariance) or ``euclid``.

    Groups with fewer than four points give nothing.
    """
    keys = list(keys)
    m = robust_moments(df, keys, x, y) if kind == "t" else covariance(df, keys, x, y)
    m = m.filter(F.col("n") - 1 >= 3)
    if kind == "euclid":
        s = F.least("sxx", "syy")
        m = m.select(*keys, "n", "mx", "my", s.alias("sxx"), F.lit(0.0).alias("sxy"), s.alias("syy"))
        return _from_moments(m, keys, div(F.lit(level), F.sqrt("sxx")), segments)
    return _from_moments(m, keys, F.sqrt(2 * f_quantile_2(level, F.col("n") - 1)), segments)


def cluster_ellipse(df: DataFrame, cluster: str, x: str, y: str, level: float = 0.95, segments: int = 100) -> DataFrame:
    """Chi-square ellipse of every cluster with more than two points."""
    m = covariance(df, [cluster], x, y).filter("n > 2")
    return _from_moments(m, [cluster], F.lit(math.sqrt(-2 * math.log(1 - level))), segments)


def ellipse_axes(ell: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, end, seq, x, y``: the points at both ends of both axes.

    An ellipse is one short outline, so it is folded back into one row.
    """
    keys = list(keys)
    one = ell.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))).alias("_l")).select(
        *keys, F.transform("_l", lambda p: pt(p["x"], p["y"])).alias("coo"))
    aligned = one.withColumn("_a", O.align(F.col("coo")))
    ends = F.array(*[F.struct(F.lit(n).alias("end"), i.alias("seq")) for n, i in (
        ("x_min", O.which_min(F.col("_a.x"))), ("x_max", O.which_max(F.col("_a.x"))),
        ("y_min", O.which_min(F.col("_a.y"))), ("y_max", O.which_max(F.col("_a.y"))))])
    out = aligned.select(*keys, "coo", F.explode(ends).alias("e"))
    p = F.element_at("coo", F.col("e.seq"))
    return out.select(*keys, "e.end", "e.seq", p["x"].alias("x"), p["y"].alias("y"))


def robust_moments(df: DataFrame, keys: Sequence[str], x: str, y: str, nu: float = 5.0, tol: float = 0.01,
                   rounds: int = 25) -> DataFrame:
    """Mean and covariance of a bivariate t distribution, by reweighting.

    Each round is one aggregate over the data given the last round's few
    numbers per group, which are written to the shared folder.
    """
    keys = list(keys)
    start = covariance(df, keys, x, y)
    par = cut(start.select(*keys, "n", F.col("mx").alias("lx"), F.col("my").alias("ly"), *[
        F.lit(v).cast("double").alias(c) for c, v in (("a", None), ("b", None), ("c", None), ("px", 0), ("py", 0))]))
    one = F.lit(1.0 + 2.0 / nu)

    def distance(u, v, a, b, c):
        det = a * c - b * b
        return (c * u * u - 2 * b * u * v + a * v * v) / F.when(det > 0, det)

    def joined(p):
        return df.join(small_side(p), keys) if keys else df.withColumn("_p", p.select(F.struct("*")).scalar()).select("*", "_p.*")

    w = F.coalesce((nu + 2) / (nu + distance(
        F.col(x) - F.col("px"), F.col(y) - F.col("py"), F.col("a"), F.col("b"), F.col("c"))), one)
    for _ in range(rounds):
        # scatter about the current centre under the current weights
        u, v = F.col(x) - F.col("lx"), F.col(y) - F.col("ly")
        scatter = joined(par).groupBy(*keys).agg(
            (F.sum(w * u * u) / F.sum(w)).alias("a2"), (F.sum(w * u * v) / F.sum(w)).alias("b2"),
            (F.sum(w * v * v) / F.sum(w)).alias("c2"))
        both = par.join(scatter, keys) if keys else par.withColumn("_s", scatter.select(F.struct("*")).scalar()).select("*", "_s.*").drop("_s")
        nxt = (nu + 2) / (nu + distance(u, v, F.col("a2"), F.col("b2"), F.col("c2")))
        moved = joined(both).groupBy(*keys).agg(
            F.max("n").alias("n"), (F.sum(nxt * F.col(x)) / F.sum(nxt)).alias("nx"),
            (F.sum(nxt * F.col(y)) / F.sum(nxt)).alias("ny"), F.max(F.abs(nxt - w)).alias("change"),
            F.max("lx").alias("px"), F.max("ly").alias("py"), F.max("a2").alias("a"), F.max("b2").alias("b"),
            F.max("c2").alias("c"))
        par = cut(moved.select(*keys, "n", F.col("nx").alias("lx"), F.col("ny").alias("ly"), "a", "b", "c", "px", "py", "change"))
        if par.filter(F.col("change") >= tol).limit(1).count() == 0:
            break
    u, v = F.col(x) - F.col("px"), F.col(y) - F.col("py")
    return joined(par).groupBy(*keys).agg(
        F.max("n").alias("n"), F.max("lx").alias("mx"), F.max("ly").alias("my"),
        (F.sum(w * u * u) / F.max("n")).alias("sxx"), (F.sum(w * u * v) / F.max("n")).alias("sxy"),
        (F.sum(w * v * v) / F.max("n")).alias("syy"))
