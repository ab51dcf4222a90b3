"""Resampled PCA models compared with a reference model.

A run is a (fraction, repeat) task.  Rows are sampled per run by their hash, the
moments of all runs are summed in one pass, and only p x p matrices are solved
inside tasks (p at most 400), so a run of any size costs one small group.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import efa as E
from ..functions import kernels
from ..functions import outline as O
from ..functions.base import div, let, pt
from ..session import cut, small_side
from . import pca as P
from .hull import convex_hull
from .ranks import hash_cutoffs, quantiles
from .tables import bin_of, column_pairs, fraction_schedule

METRICS = ("subspace_similarity", "axis_shift_mean_deg", "axis_shift_max_deg", "axis_shift_mean_similarity",
           "occupancy_grid_iou", "occupancy_hull_iou", "occupancy_similarity", "occupancy_similarity_strict")


# ---- summaries -------------------------------------------------------------------


def summarize_runs(runs: DataFrame, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Mean, median, sd, se and 2.5/97.5 % quantiles per fraction and metric."""
    present = [m for m in metrics if m in runs.columns]
    long = runs.unpivot(["fraction", "realized_n"], present, "metric_type", "value").filter(O.finite(F.col("value")))
    keys = ["fraction", "realized_n", "metric_type"]
    stats = [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
             (F.stddev_samp("value") / F.sqrt(F.count("*"))).alias("se")]
    q = quantiles(long, keys, "value", [0.025, 0.5, 0.975], ["q025", "median", "q975"], stats)
    asked = runs.select("fraction", "realized_n").distinct().withColumn(
        "metric_type", F.explode(F.array(*[F.lit(m) for m in present])))
    return asked.join(q, keys, "left").select(
        *keys, "mean", "median", "sd", "se", "q025", "q975")


def convergence_curve(summary: DataFrame, metrics: Sequence[str], x_axis: str = "fraction") -> DataFrame:
    """Rows of the chosen metrics with their x value and quantile band."""
    x = F.col("fraction") if x_axis == "fraction" else F.col("realized_n").cast("double")
    return summary.filter(F.col("metric_type").isin(*metrics)).select(
        "metric_type", x.alias("x"), "mean", "q025", "q975")


def axis_summary(runs: DataFrame, max_axes: int, value_type: str = "deg") -> DataFrame:
    """Mean and quantiles of every axis' shift per fraction."""
    cols = [f"axis_pc{i}_{value_type}" for i in range(1, max_axes + 1) if f"axis_pc{i}_{value_type}" in runs.columns]
    long = runs.unpivot(["fraction", "realized_n"], cols, "name", "value").filter(O.finite(F.col("value")))
    long = long.withColumn("axis", F.regexp_extract("name", r"pc([0-9]+)", 1).cast("int"))
    keys = ["fraction", "realized_n", "axis"]
    return quantiles(long, keys, "value", [0.025, 0.975], ["q025", "q975"], [F.avg("value").alias("mean")])


# ---- comparisons ------------------------------------------------------------------


def subspace_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Mean cosine of the principal angles between two sets of axes."""
    if a.shape[1] < 1:
        return float("nan")
    qa, qb = np.linalg.qr(a)[0], np.linalg.qr(b)[0]
    return float(np.clip(np.linalg.svd(qa.T @ qb, compute_uv=False), 0, 1).mean())


def axis_shift(rotations: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, pc, similarity, angle_deg``: absolute cosine of matching axes."""
    keys = list(keys)
    ref = reference.select("pos", "pc", F.col("loading").alias("_b"))
    j = rotations.join(ref, ["pos", "pc"]).groupBy(*keys, "pc").agg(
        F.sum(F.col("loading") * F.col("_b")).alias("_d"), F.sum(F.col("loading") * F.col("loading")).alias("_m"),
        F.sum(F.col("_b") * F.col("_b")).alias("_n"))
    sim = F.least(F.abs(div(F.col("_d"), F.sqrt(F.col("_m") * F.col("_n")))), F.lit(1.0))
    return j.select(*keys, "pc", sim.alias("similarity"), F.degrees(F.acos(sim)).alias("angle_deg"))


def _rings(df: DataFrame, keys: Sequence[str], row_id: str, out: str) -> DataFrame:
    """``keys, <out>``: counter-clockwise hull polygon (array of points) per key."""
    h = convex_hull(df, keys, "x", "y", row_id)
    ring = F.reverse(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))))
    return h.groupBy(*keys).agg(F.transform(ring, lambda p: pt(p["x"].cast("double"), p["y"].cast("double"))).alias(out))


RING = "array<struct<x:double,y:double>>"


def clipped(subject: Column, clip: Column) -> Column:
    """The part of a convex ring inside another, both counter-clockwise: a fold over the edges of ``clip``.

    Every edge keeps the points on its left and adds the crossings of the ring with its line.
    """
    def half(ring, e):
        def side(p):
            return (e["b"]["x"] - e["a"]["x"]) * (p["y"] - e["a"]["y"]) - (e["b"]["y"] - e["a"]["y"]) * (p["x"] - e["a"]["x"])

        def kept(p, q):
            def points(v):
                s, t = v["s"], v["t"]
                cross = let(div(s, s - t), lambda f: pt(p["x"] + (q["x"] - p["x"]) * f, p["y"] + (q["y"] - p["y"]) * f))
                return F.array_compact(F.array(F.when(s >= 0, pt(p["x"], p["y"])), F.when(((s > 0) & (t < 0)) | ((s < 0) & (t > 0)), cross)))
            return let(F.struct(side(p).alias("s"), side(q).alias("t")), points)
        following = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))  # nothing may be left
        return F.flatten(F.zip_with(ring, following, kept)).cast(RING)
    edges = F.zip_with(clip, O.with_next(clip), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.aggregate(edges, subject.cast(RING), half)


def overlap(a: Column, b: Column) -> Column:
    """Area of the intersection over the union of two convex rings; NULL for a ring without area."""
    def area(r):
        return F.when(F.size(r) >= 3, O.area(r)).otherwise(F.lit(0.0))

    def share(v):
        union = v["a"] + v["b"] - v["c"]
        return F.when((v["a"] > 0) & (v["b"] > 0) & (union > 0), v["c"] / union)
    return let(F.struct(area(a).alias("a"), area(b).alias("b"), let(clipped(a, b), area).alias("c")), share)


def hull_iou_of(a: DataFrame, b: DataFrame, keys: Sequence[str], row_id: str) -> DataFrame:
    """``keys, iou`` of the convex hulls of two ``x, y`` sets per key.

    The hulls are reduced in parallel first; a row then clips two small polygons.
    """
    keys = list(keys)
    both = _rings(a, keys, row_id, "_a").join(_rings(b, keys, row_id, "_b"), keys)
    return both.select(*keys, overlap(F.col("_a"), F.col("_b")).alias("iou"))


def occupancy(runs: DataFrame, reference: DataFrame, keys: Sequence[str], pcs: Sequence[str],
              resolution: int = 60) -> DataFrame:
    """``keys, grid_iou, hull_iou, combined_available, combined_strict``.

    Means over all PC pairs; ``runs`` and ``reference`` hold wide scores with an
    ``id``; the reference is compared with every run.
    """
    keys = list(keys)
    mine = column_pairs(runs, pcs, [*keys, "id"], all_pairs=True)
    ref = column_pairs(reference, pcs, ["id"], all_pairs=True)
    hulls = _rings(mine, [*keys, "pair"], "id", "_a").join(_rings(ref, ["pair"], "id", "_b"), "pair").withColumn("iou", overlap(F.col("_a"), F.col("_b")))
    out = _grid_overlap(mine, ref, keys, resolution).join(
        hulls.select(*keys, "pair", F.col("iou").alias("h")), [*keys, "pair"], "full").groupBy(*keys).agg(
        F.avg("iou").alias("grid_iou"), F.avg("h").alias("hull_iou"))
    g, h = F.col("grid_iou"), F.col("hull_iou")
    return out.select(*keys, "grid_iou", "hull_iou",
                      F.coalesce((g + h) / 2, g, h).alias("combined_available"), ((g + h) / 2).alias("combined_strict"))


def _grid_overlap(mine: DataFrame, ref: DataFrame, keys: Sequence[str], resolution: int) -> DataFrame:
    """``keys, pair, iou`` of occupied cells under bounds common to a run and the reference.

    Runs with the same bounds share one set of reference cells; when runs are
    drawn from the reference that is a single set per pair.  Reference rows
    fold to cells on the map side.
    """
    def ends(df, by):
        return df.groupBy(*by).agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    b = ends(ref, ["pair"]).select("pair", *[F.col(c).alias(f"_{c}") for c in ("x0", "x1", "y0", "y1")])
    bounds = ends(mine, [*keys, "pair"]).join(b, "pair").select(
        *keys, "pair", F.least("x0", "_x0").alias("_x0"), F.greatest("x1", "_x1").alias("_x1"),
        F.least("y0", "_y0").alias("_y0"), F.greatest("y1", "_y1").alias("_y1")).withColumn(
        "_g", F.xxhash64("_x0", "_x1", "_y0", "_y1"))
    bounds = small_side(bounds.filter((F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))))
    i = bin_of("x", "_x0", "_x1", resolution).alias("_i")
    j = bin_of("y", "_y0", "_y1", resolution).alias("_j")
    own = mine.join(bounds, [*keys, "pair"]).select(*keys, "pair", "_g", i, j).distinct()
    shared = bounds.select("pair", "_g", "_x0", "_x1", "_y0", "_y1").distinct()
    theirs = ref.join(small_side(shared), "pair").select("pair", "_g", i, j).distinct()
    size = theirs.groupBy("pair", "_g").agg(F.count("*").alias("_r"))
    hits = own.join(theirs.withColumn("_hit", F.lit(1)), ["pair", "_g", "_i", "_j"], "left").groupBy(*keys, "pair", "_g").agg(
        F.count("*").alias("_n"), F.count("_hit").alias("_both"))
    return hits.join(size, ["pair", "_g"]).select(
        *keys, "pair", (F.col("_both") / (F.col("_n") + F.col("_r") - F.col("_both"))).alias("iou"))


# ---- runs -------------------------------------------------------------------------


def tasks(n_total: DataFrame, fractions: Sequence[float], n_repeats: int) -> DataFrame:
    """``fraction, realized_n, repeat_id``."""
    return fraction_schedule(n_total, fractions).withColumn(
        "repeat_id", F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))


def draw_samples(rows: DataFrame, task_table: DataFrame, seed: int, key: str = "id") -> DataFrame:
    """``fraction, realized_n, repeat_id`` and the columns of ``rows``, drawn without replacement.

    The rank of a row in a run is its hash.  One pass over the keys finds each
    run's cutoff hash; then rows are only filtered, so coefficients or outlines
    are never shuffled.  The run list is a bounded parameter table.
    """
    def hexes():
        return F.md5(F.concat_ws(":", F.lit(str(seed)), F.round(F.col("fraction") * 100000).cast("bigint").cast("string"),
                                 F.col("repeat_id").cast("string"), F.col(key).cast("string")).cast("binary"))
    runs = ["fraction", "realized_n", "repeat_id"]
    listed = task_table.agg(F.collect_list(F.struct(*runs)).alias("t")).scalar()
    marked = rows.select(key, F.explode(listed).alias("t")).select(key, "t.*").withColumn("_hash", hexes())
    cut_at = cut(hash_cutoffs(marked, runs, "_hash", "realized_n"))
    asked = cut_at.agg(F.collect_list(F.struct(*runs, "cutoff")).alias("t")).scalar()
    return rows.withColumn("_t", F.explode(asked)).select(*runs_of("_t", runs), "_t.cutoff", *rows.columns).filter(
        hexes() <= F.col("cutoff")).drop("cutoff")


def runs_of(col: str, names: Sequence[str]):
    return [F.col(f"{col}.{n}").alias(n) for n in names]


def run_moments(rows: DataFrame, keys: Sequence[str], v: str, p: int) -> DataFrame:
    """``keys, part, n, total ARRAY, cross ARRAY``: partial sums per task, key and salt.

    A task keeps one p-vector and one p x p matrix per run, up to 64 MB of
    them at a time, so what is shuffled depends on runs and tasks, not on rows.
    """
    keys = list(keys)
    fields = rows.select(*keys).schema.fields
    schema = T.StructType(fields + [T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.DoubleType())),
                                    T.StructField("cross", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush():
            out = pd.DataFrame([(*k, n, s, c.ravel()) for k, (n, s, c) in held.items()], columns=[*keys, "n", "total", "cross"])
            held.clear()
            return out
        for pdf in batches:
            for key, g in pdf.groupby(keys, sort=False):
                m = np.stack(g[v].to_list())
                part = (len(m), m.sum(axis=0), m.T @ m)
                held[key] = tuple(a + b for a, b in zip(held[key], part)) if key in held else part
                if 8 * m.shape[1] ** 2 * len(held) > 64 << 20:
                    yield flush()
        if held:
            yield flush()
    return rows.select(*keys, v).mapInPandas(run, schema)


def run_models(partials: DataFrame, keys: Sequence[str], p: int, max_axes: int, ref: np.ndarray) -> DataFrame:
    """One row per run: similarity to the reference axes and its model arrays."""
    keys = list(keys)
    ref = np.asarray(ref, float)
    schema = T.StructType(partials.select(*keys).schema.fields + [
        T.StructField(c, T.DoubleType()) for c in (
            "subspace_similarity", "axis_shift_mean_deg", "axis_shift_max_deg", "axis_shift_mean_similarity")] + [
        T.StructField(f"axis_pc{i}_{t}", T.DoubleType()) for i in range(1, max_axes + 1) for t in ("deg", "sim")] + [
        T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("center", "rotation", "sdev")])

    def solve(pdf):
        n = int(pdf["n"].sum())
        s = np.sum(np.stack(pdf["total"].to_list()), axis=0)
        c = np.sum(np.stack(pdf["cross"].to_list()), axis=0).reshape(p, p)
        mean = s / n
        rot, sdev = P.eigen((c - n * np.outer(mean, mean)) / max(n - 1, 1), min(n, p))
        k = min(max_axes, rot.shape[1], ref.shape[1])
        sim = np.clip(np.abs((rot[:, :k] * ref[:, :k]).sum(axis=0)), 0, 1)
        deg = np.degrees(np.arccos(sim))
        per = np.full((2, max_axes), np.nan)
        per[0, :k], per[1, :k] = deg, sim
        vals = [subspace_similarity(rot[:, :k], ref[:, :k]), deg.mean(), deg.max(), sim.mean(), *per.T.ravel()]
        return pd.DataFrame([[*[pdf[x].iloc[0] for x in keys], *vals, mean, rot[:, :k].ravel(), sdev[:k]]],
                            columns=[f.name for f in schema.fields])

    def fold(pdf):
        out = pdf[keys].iloc[:1].copy()
        out["n"] = int(pdf["n"].sum())
        out["total"] = [np.sum(np.stack(pdf["total"].to_list()), axis=0)]
        out["cross"] = [np.sum(np.stack(pdf["cross"].to_list()), axis=0)]
        return out
    # partial sums meet in two steps, so no task reads one run's partials of all tasks at once
    salted = partials.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32)))
    mid = salted.groupBy(*keys, "_salt").applyInPandas(fold, partials.schema)
    return mid.groupBy(*keys).applyInPandas(solve, schema)


def stability(outlines: DataFrame, fractions: Sequence[float], n_repeats: int, nb_h: int = 12, max_pcs: int = 4,
              resolution: int = 60, seed: int = 1, mode: str = "fast", reference_mode: str = "all",
              start_point: str = "left", norm: bool = True) -> tuple[DataFrame, DataFrame, P.Basis]:
    """Runs table, run models (``pos, pc, loading`` per run) and the reference.

    ``fast`` computes coefficients once; ``strict`` recomputes them from the
    outlines drawn for every run.  Normalisation looks at one outline at a
    time, so both give the same numbers unless the harmonic cap differs.
    """
    keys = ["fraction", "realized_n", "repeat_id"]
    ready = outlines.select("id", E.normalise_shape(F.col("coo"), start_point).alias("coo"))
    coefs = E.efourier(ready, nb_h, norm=norm, start=True)
    task_table = tasks(coefs.agg(F.count("*").alias("n")), fractions, n_repeats)
    if mode == "strict":
        rows = E.efourier(draw_samples(ready, task_table, seed), nb_h, norm=norm, start=True)
    else:
        rows = draw_samples(coefs, task_table, seed)
    if reference_mode == "all":
        ref_rows = coefs
    else:
        top = task_table.agg(F.max("fraction").alias("f")).scalar()
        ref_rows = rows.filter((F.col("fraction") == top) & (F.col("repeat_id") == 1)).select("id", "coe")
    ref = P.fit(ref_rows)
    p, k = len(ref.center), min(max_pcs, ref.rotation.shape[1])
    ref = P.Basis(ref.center, ref.rotation[:, :k], ref.sdev[:k])
    models = run_models(run_moments(rows, keys, "coe", p), keys, p, max_pcs, ref.rotation)
    pcs = [f"PC{i}" for i in range(1, k + 1)]

    def wide(df, *keep):
        return P.project(df, ref).select(*keep, "id", *[F.element_at("scores", i + 1).alias(c) for i, c in enumerate(pcs)])
    metrics = models.drop("center", "rotation", "sdev")
    if k >= 2:
        occ = occupancy(wide(rows, *keys), wide(ref_rows), keys, pcs, resolution).select(
            *keys, F.col("grid_iou").alias("occupancy_grid_iou"), F.col("hull_iou").alias("occupancy_hull_iou"),
            F.col("combined_available").alias("occupancy_similarity"),
            F.col("combined_strict").alias("occupancy_similarity_strict"))
        metrics = metrics.join(occ, keys, "left")
    return metrics, models.select(*keys, "center", "rotation", "sdev"), ref


def mean_shapes(coefs: DataFrame, keys: Sequence[str], nb_pts: int = 120, v: str = "coe") -> DataFrame:
    """``keys, shape``: inverse Fourier outline of every run's mean coefficients."""
    keys = list(keys)
    long = coefs.select(*keys, F.posexplode(v).alias("_p", "_v")).groupBy(*keys, "_p").agg(F.avg("_v").alias("_v"))
    mean = long.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_v"))), lambda e: e["_v"]).alias("coe"))
    built = E.with_inverse(mean, E.from_coe(F.col("coe")), nb_pts=nb_pts)
    return built.select(*keys, O.close(O.center(F.col("shape"))).alias("shape"))


def replicate_shapes(models: DataFrame, keys: Sequence[str], axes: Sequence[int], sds: Sequence[float],
                     nb_pts: int = 120) -> DataFrame:
    """``keys, pc, sd, shape``: +-SD shapes of every run's model; 0 is always there."""
    keys = list(keys)
    asked = F.array(*[F.struct(F.lit(int(a)).alias("pc"), F.lit(float(s)).alias("sd"))
                      for a in axes for s in sorted({0.0, *map(float, sds)})])
    rows = models.withColumn("_q", F.explode(asked)).select("*", "_q.pc", "_q.sd").drop("_q").filter(F.col("pc") <= F.size("sdev"))
    k = F.size("sdev")
    coe = F.transform("center", lambda c, i: c + F.col("sd") * F.element_at("sdev", F.col("pc")) * F.element_at(
        "rotation", i * k + F.col("pc")))
    built = E.with_inverse(rows.withColumn("_coe", coe), E.from_coe(F.col("_coe")), nb_pts=nb_pts)
    return built.select(*keys, "pc", "sd", O.close(O.center(F.col("shape"))).alias("shape"))
