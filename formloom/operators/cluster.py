"""Clusters of two-dimensional (or wider) positions and the choice of k."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.base import div
from ..session import cut
from .kmeans import finite, fit_many, mean_silhouettes, nearest, points_of


def standardise(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-scores with the n-1 deviation, from one aggregate."""
    s = df.agg(F.struct(*[f for c in cols for f in (F.avg(c).alias(f"m_{c}"), F.stddev_samp(c).alias(f"s_{c}"))]).alias("s")).scalar()
    t = df.withColumn("_s", s)
    for c in cols:
        t = t.withColumn(c, div(F.col(c) - F.col(f"_s.m_{c}"), F.col(f"_s.s_{c}")))
    return t.drop("_s")


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, nstart: int = 20, seed: int = 1, id_col: str | None = None) -> DataFrame:
    """Adds ``cluster`` (1..k by rising centres) of the best of ``nstart`` starts; NULL for a row without finite columns."""
    best = fit_many(cut(points_of(df, cols, id_col)), len(cols), [k], nstart, seed)
    return df.withColumn("cluster", nearest(cols, best[0, k].centres))


# ---- spread within and between clusters -------------------------------------------------------


def cluster_sums(df: DataFrame, cols: Sequence[str], cluster: str) -> DataFrame:
    """``c, n, s, q`` per cluster: rows, sums of the columns and sum of squares, from one aggregate."""
    cols = list(cols)
    return df.groupBy(F.col(cluster).alias("c")).agg(
        F.count("*").alias("n"), F.array(*[F.sum(c) for c in cols]).alias("s"),
        F.sum(sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))).alias("q"))


def silhouette(df: DataFrame, cols: Sequence[str], cluster: str, id_col: str) -> DataFrame:
    """``id, cluster, width``: silhouette over squared distances; 0 for a cluster of one.

    The mean squared distance of a row to a cluster follows from the cluster's
    sums, so the work is rows times clusters and only one line per cluster is
    sent to the tasks.  Columns are centred first, which keeps the sums exact.
    """
    cols = list(cols)
    means = df.agg(F.struct(*[F.avg(c).alias(c) for c in cols])).scalar()
    rows = df.select(id_col, F.col(cluster).alias("cluster"), *cols).withColumn("_m", means)
    rows = rows.select(id_col, "cluster", *[(F.col(c) - F.col(f"_m.{c}")).alias(c) for c in cols])
    stats = cluster_sums(rows, cols, "cluster").agg(F.collect_list(F.struct("c", "n", "s", "q"))).scalar()
    square = sum((F.col(c) * F.col(c) for c in cols), F.lit(0.0))

    def total(k):
        dot = sum((F.col(c) * F.get(k["s"], F.lit(i)) for i, c in enumerate(cols)), F.lit(0.0))
        return F.greatest(k["n"] * square - 2 * dot + k["q"], F.lit(0.0))
    own = F.get(F.transform(F.filter("_k", lambda k: k["c"] == F.col("cluster")), lambda k: F.when(
        k["n"] > 1, total(k) / F.greatest(k["n"] - 1, F.lit(1)))), F.lit(0))
    other = F.array_min(F.transform(F.filter("_k", lambda k: k["c"] != F.col("cluster")), lambda k: total(k) / k["n"]))
    w = rows.withColumn("_k", stats).select(id_col, "cluster", own.alias("a"), other.alias("b"))
    return w.select(id_col, "cluster", F.when(F.col("a").isNull(), F.lit(0.0)).otherwise(
        div(F.col("b") - F.col("a"), F.greatest("a", "b"))).alias("width"))


def dispersion(df: DataFrame, cols: Sequence[str], cluster: str) -> float:
    """Half the sum over clusters of pairwise squared distances over cluster size: half the sum of squares within."""
    within = sum((F.var_pop(c) * F.count(c) for c in cols), F.lit(0.0))
    return float(df.groupBy(cluster).agg(within.alias("w")).agg((F.sum("w") / 2).alias("w")).first().w)


# ---- choice of k ------------------------------------------------------------------------------


def wcss_curve(df: DataFrame, cols: Sequence[str], max_k: int = 10, min_k: int = 1, nstart: int = 25,
               seed: int = 1) -> DataFrame:
    """``k, wcss``: within-cluster sum of squares of the best start of each k, all moved together."""
    best = fit_many(cut(points_of(df, cols)), len(cols), range(min_k, max_k + 1), nstart, seed)
    return _curve(df, best, range(min_k, max_k + 1))


def _curve(df: DataFrame, best: dict, ks: Sequence[int]) -> DataFrame:
    return df.sparkSession.createDataFrame([(k, best[0, k].cost) for k in ks], "k int, wcss double")


def elbow(curve: DataFrame) -> DataFrame:
    """One row ``k``: farthest from the chord of the normalised curve (3 points or more).

    The curve has one row per k, so its ends and ranges are small aggregates.
    """
    s = curve.agg(F.struct(
        F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("wcss").alias("w0"), F.max("wcss").alias("w1"),
        F.min_by("wcss", "k").alias("a"), F.max_by("wcss", "k").alias("z"), F.count("*").alias("n")).alias("s")).scalar()
    t = curve.withColumn("_s", s)
    w = lambda v: div(v - F.col("_s.w0"), F.col("_s.w1") - F.col("_s.w0"))
    x, y, y0, y1 = div(F.col("k") - F.col("_s.k0"), F.col("_s.k1") - F.col("_s.k0")), w(F.col("wcss")), w(F.col("_s.a")), w(F.col("_s.z"))
    d = F.abs((y1 - y0) * x - y + y0) / F.sqrt((y1 - y0) * (y1 - y0) + 1)
    return t.filter("_s.n >= 3").agg(F.min_by("k", F.struct((-d).alias("d"), F.col("k").alias("k"))).alias("k"))


def best_silhouette(df: DataFrame, cols: Sequence[str], id_col: str, max_k: int, nstart: int = 25, seed: int = 1) -> DataFrame:
    """``k, silhouette`` for k = 2..max_k; the best is the largest (lowest k on ties)."""
    points = cut(points_of(df, cols, id_col))
    return _widths(points, fit_many(points, len(cols), range(2, max_k + 1), nstart, seed), max_k)


def _widths(points: DataFrame, best: dict, max_k: int) -> DataFrame:
    found = mean_silhouettes(points, [best[0, k] for k in range(2, max_k + 1)]) if max_k > 1 else {}
    return points.sparkSession.createDataFrame(sorted(found.items()), "k int, silhouette double")


def reference_box(df: DataFrame, cols: Sequence[str]) -> tuple:
    """Mean, principal axes and range along each axis."""
    from .pca import eigen, moments
    _, mean, cov = moments(df.select(F.array(*cols).alias("v")), "v")
    rot, _ = eigen(cov, len(cols))
    proj = [sum(((F.col(c) - float(mean[i])) * float(rot[i, j]) for i, c in enumerate(cols)), F.lit(0.0)) for j in range(len(cols))]
    box = df.agg(*[f for j, e in enumerate(proj) for f in (F.min(e).alias(f"a{j}"), F.max(e).alias(f"z{j}"))]).first()
    return mean, rot, [(box[f"a{j}"], box[f"z{j}"]) for j in range(len(cols))]


def with_references(df: DataFrame, cols: Sequence[str], id_col: str, references: int, seed: int) -> DataFrame:
    """``id, v``: the row's own position and, for every reference set, one drawn uniformly in the box of the principal axes.

    The draw of a row is a function of (seed, set, axis, id), so a set has as many rows as the data and no row is moved.
    """
    rows = df.filter(finite(cols)).select(id_col, *[F.col(c).cast("double").alias(c) for c in cols])
    mean, rot, box = reference_box(rows, cols)

    def place(b):
        u = [F.lit(a) + draws.uniform(seed, b, j, F.col(id_col)) * (z - a) for j, (a, z) in enumerate(box)]
        return F.array(*[sum((u[j] * float(rot[i, j]) for j in range(len(cols))), F.lit(float(mean[i]))) for i in range(len(cols))])
    drawn = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(references)), place)) if references else F.array().cast("array<double>")
    return rows.select(F.col(id_col).alias("id"), F.concat(F.array(*cols), drawn).alias("v"))


def gap_statistic(df: DataFrame, cols: Sequence[str], id_col: str, max_k: int = 10, references: int = 50,
                  nstart: int = 25, seed: int = 1) -> DataFrame:
    """``k, log_w, expected, gap, se``: every k of the data and of all reference sets is fitted by the same passes."""
    points = cut(with_references(df, cols, id_col, references, seed))
    return _gaps(points, fit_many(points, len(cols), range(1, max_k + 1), nstart, seed), max_k, references)


def _gaps(points: DataFrame, best: dict, max_k: int, references: int) -> DataFrame:
    log_w = np.array([[math.log(max(best[b, k].cost / 2, 1e-300)) for k in range(1, max_k + 1)] for b in range(references + 1)])
    mine, ref = log_w[0], log_w[1:]
    sd = ref.std(axis=0, ddof=1) if references > 1 else np.zeros(max_k)
    rows = [(k + 1, float(mine[k]), float(ref[:, k].mean()), float(ref[:, k].mean() - mine[k]),
             float(math.sqrt(1 + 1 / references) * sd[k])) for k in range(max_k)]
    return points.sparkSession.createDataFrame(rows, "k int, log_w double, expected double, gap double, se double")


def first_se_max(gaps: DataFrame) -> DataFrame:
    """One row ``k``: the first k not below the first local maximum less its SE.

    The table has one row per k.
    """
    from pyspark.sql import Window
    w = Window.orderBy("k")
    t = gaps.select("k", "gap", "se", F.lead("gap").over(w).alias("_n"))
    top = t.filter(F.col("_n").isNull() | (F.col("_n") < F.col("gap"))).agg(
        F.min_by(F.struct("k", "gap", "se"), "k").alias("t")).scalar()
    return t.withColumn("_t", top).filter(
        (F.col("k") <= F.col("_t.k")) & (F.col("gap") >= F.col("_t.gap") - F.col("_t.se"))).agg(F.min("k").alias("k"))


def choose_k(curve: DataFrame | None = None, widths: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """``method, k`` from a WCSS curve, mean silhouettes and a gap table."""
    parts = []
    if curve is not None:
        parts.append(elbow(curve).select(F.lit("elbow").alias("method"), F.col("k").cast("int").alias("k")))
    if widths is not None:
        parts.append(widths.filter("k > 1").agg(F.max_by("k", F.struct("silhouette", -F.col("k"))).alias("k")).select(
            F.lit("silhouette").alias("method"), F.col("k").cast("int").alias("k")))
    if gaps is not None:
        parts.append(first_se_max(gaps).select(F.lit("gap").alias("method"), F.col("k").cast("int").alias("k")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def optimal_k(df: DataFrame, cols: Sequence[str], id_col: str, methods: Sequence[str] = ("elbow", "silhouette", "gap"),
              max_k: int = 10, nstart: int = 25, references: int = 50, seed: int = 1) -> DataFrame:
    """``method, k`` of every chosen method; the methods share one set of fits."""
    references = references if "gap" in methods else 0
    points = cut(with_references(df, cols, id_col, references, seed))
    best = fit_many(points, len(cols), range(1, max_k + 1), nstart, seed)
    return choose_k(
        _curve(df, best, range(1, max_k + 1)) if "elbow" in methods else None,
        _widths(points, best, max_k) if "silhouette" in methods else None,
        _gaps(points, best, max_k, references) if "gap" in methods else None)
