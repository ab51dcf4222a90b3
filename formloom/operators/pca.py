"""Principal components of coefficient tables, projection and reconstruction.

The p x p covariance (p at most 400: four coefficients for up to 100
harmonics) is the only thing that reaches the driver.  It is built by tree
aggregation in the JVM; projection and reconstruction are map stages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import efa as E
from ..functions import kernels
from ..functions import outline as O
from ..functions.base import TWO_PI, div, let, lets, pt
from ..session import small_side
from ..sources.model import Model
from .ranks import quantiles


@dataclass
class Basis:
    """Local model: ``center`` (p), ``rotation`` (p x k), ``sdev`` (k)."""

    center: np.ndarray
    rotation: np.ndarray
    sdev: np.ndarray
    scale: np.ndarray | None = None

    @property
    def shares(self) -> np.ndarray:
        v = self.sdev ** 2
        return v / v.sum()


def merge_moments(parts) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Count, mean and sum of centred products of the union of disjoint sets of rows."""
    n, mean, m2 = 0, None, None
    for k, m, q in parts:
        if not k:
            continue
        if not n:
            n, mean, m2 = k, m.copy(), q.copy()
            continue
        d = m - mean
        m2 += q + np.outer(d, d) * (n * k / (n + k))
        mean += d * (k / (n + k))
        n += k
    return (n, mean, m2) if n else None


FOLDS = 16


def moments(df: DataFrame, v: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, mean and covariance (n-1) of an array column, in one pass.

    Every task folds its rows to centred moments; those are merged in ``FOLDS`` groups
    and then on the driver, so the rows are scanned once and p x p matrices are all that moves.
    """
    schema = "fold int, n long, mean array<double>, m2 array<double>"
    arrow = pa.schema([("fold", pa.int32()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m2", pa.list_(pa.float64()))])

    def row(fold, got):
        n, mean, m2 = got
        return [pa.array([fold], pa.int32()), pa.array([n], pa.int64()), pa.array([mean], pa.list_(pa.float64())), pa.array([m2.ravel()], pa.list_(pa.float64()))]

    def parts(table):
        for n, mean, m2 in zip(table["n"].to_pylist(), table["mean"].to_pylist(), table["m2"].to_pylist()):
            yield n, np.array(mean), np.array(m2).reshape(len(mean), -1)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for b in batches:
                rows = b.column(0).drop_null()
                if len(rows):
                    x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
                    mean = x.mean(axis=0)
                    x = x - mean
                    yield len(x), mean, x.T @ x
        got = merge_moments(each())
        if got:
            yield pa.RecordBatch.from_arrays(row(TaskContext.get().partitionId() % FOLDS, got), schema=arrow)

    def merge(t: pa.Table) -> pa.Table:
        return pa.table(row(t["fold"][0].as_py(), merge_moments(parts(t.sort_by("n")))), schema=arrow)
    folds = df.select(F.col(v).cast("array<double>").alias("v")).mapInArrow(fold, schema).groupBy("fold").applyInArrow(merge, schema)
    got = merge_moments(parts(folds.toArrow().sort_by("fold")))  # one row per fold
    if not got or not len(got[1]):
        raise ValueError("rows with coefficients are needed")
    n, mean, m2 = got
    return n, mean, m2 / max(n - 1, 1)


def positive_axes(rotation: np.ndarray) -> np.ndarray:
    """Flip each axis so that its largest loading (first on ties) is positive."""
    top = np.abs(np.round(rotation, 12)).argmax(axis=0)
    sign = np.sign(rotation[top, np.arange(rotation.shape[1])])
    return rotation * np.where(sign == 0, 1, sign)


def eigen(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and standard deviations of the first ``k`` axes."""
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1][:k]
    return positive_axes(vec[:, order]), np.sqrt(np.maximum(val[order], 0))


def fit(df: DataFrame, v: str = "coe", center: bool = True, scale: bool = False) -> Basis:
    """PCA with the n-1 divisor and min(n, p) axes."""
    n, mean, cov = moments(df, v)
    if not center:
        cov = cov + np.outer(mean, mean) * (n / (n - 1))
    factor = None
    if scale:
        factor = np.sqrt(np.diag(cov))
        if (factor == 0).any():
            raise ValueError("cannot scale a constant column to unit variance")
        cov = cov / np.outer(factor, factor)
    rot, sdev = eigen(cov, min(n, len(cov)))
    return Basis(mean if center else np.zeros(len(mean)), rot, sdev, factor)


def cosine_basis(p: int, k: int) -> np.ndarray:
    """An orthonormal rotation that needs no data: cosines of rising frequency."""
    i, j = np.arange(1, p + 1)[:, None], np.arange(1, k + 1)[None, :]
    return np.sqrt(2 / p) * np.cos(np.pi * (i - 0.5) * j / p)


def table_model(df: DataFrame, k: int, v: str = "coe") -> Basis:
    """Model on the cosine axes: center and sdev of the data's projections."""
    _, mean, cov = moments(df, v)
    rot = cosine_basis(len(mean), k)
    return Basis(mean, rot, np.sqrt(np.diag(rot.T @ cov @ rot)))


# ---- models as tables ----------------------------------------------------------------


def to_tables(spark: SparkSession, basis: Basis, nb_h: int | None = None, meta: dict | None = None) -> Model:
    p, k = basis.rotation.shape
    nb_h = nb_h or p // 4
    names = [f"{letter}{h}" for letter in "ABCD" for h in range(1, nb_h + 1)] if 4 * nb_h == p else [
        f"V{i + 1}" for i in range(p)]
    rot = pd.DataFrame({
        "coefficient": np.repeat(names, k), "pos": np.repeat(np.arange(1, p + 1, dtype=np.int32), k),
        "pc": np.tile(np.arange(1, k + 1, dtype=np.int32), p), "loading": basis.rotation.ravel()})
    cen = pd.DataFrame({"coefficient": names, "pos": np.arange(1, p + 1, dtype=np.int32), "value": basis.center})
    sd = pd.DataFrame({"pc": np.arange(1, k + 1, dtype=np.int32), "sdev": basis.sdev,
                       "variance_pct": 100 * basis.shares})
    info = {"harmonics": nb_h, **(meta or {})}
    kv = pd.DataFrame({"key": list(info), "value": [str(x) for x in info.values()]})
    return Model(*[spark.createDataFrame(t) for t in (rot, cen, sd, kv)])


def from_tables(model: Model) -> Basis:
    """Local arrays of a model; its size does not depend on the specimens."""
    cen, sd = model.center.orderBy("pos").toPandas(), model.sdev.orderBy("pc").toPandas()
    rot = model.rotation.orderBy("pos", "pc").toPandas()
    k = rot["pc"].nunique()
    return Basis(cen["value"].to_numpy(), rot["loading"].to_numpy().reshape(len(cen), k), sd["sdev"].to_numpy()[:k])


# ---- projection ---------------------------------------------------------------------


def project(df: DataFrame, basis: Basis, v: str = "coe", out: str = "scores") -> DataFrame:
    """Adds scores centred by the MODEL's mean."""
    p, k = basis.rotation.shape
    rot = basis.rotation if basis.scale is None else basis.rotation / basis.scale[:, None]
    return kernels.hold(df, v, F.col(v)).withColumn(out, kernels.affine(F.col(v), basis.center, rot, np.zeros(k)))


def reproject(df: DataFrame, basis: Basis, v: str = "coe", out: str = "scores") -> DataFrame:
    """Adds scores of new data centred by the NEW data's mean."""
    mean = moments(df, v)[1]
    return project(df, Basis(mean, basis.rotation, basis.sdev, basis.scale), v, out)


def long_scores(df: DataFrame, key: str = "id", scores: str = "scores") -> DataFrame:
    return df.select(key, F.posexplode(scores).alias("_p", "score")).select(
        key, (F.col("_p") + 1).cast("int").alias("pc"), "score")


def flip_axes(model: Model, scores: DataFrame, axes: Sequence[int]) -> tuple[Model, DataFrame]:
    """Negate loadings and (long) scores of the given axes."""
    def turned(df, c):
        return df.withColumn(c, F.when(F.col("pc").isin(*axes), -F.col(c)).otherwise(F.col(c)))
    return (Model(turned(model.rotation, "loading"), model.center, model.sdev, model.meta), turned(scores, "score"))


# ---- variance -----------------------------------------------------------------------


def scree(sdev: DataFrame) -> DataFrame:
    """``axis, proportion, cumsum``; one row per axis."""
    from pyspark.sql import Window
    total = sdev.agg(F.sum(F.col("sdev") * F.col("sdev")).alias("t")).scalar()
    share = div(F.col("sdev") * F.col("sdev"), total)
    w = Window.orderBy("axis").rowsBetween(Window.unboundedPreceding, 0)
    return sdev.select(F.col("pc").alias("axis"), share.alias("proportion")).withColumn(
        "cumsum", F.sum("proportion").over(w))


def scree_min(scree_table: DataFrame, prop: float) -> DataFrame:
    """One row ``axes``: axes needed for the share, else all."""
    return scree_table.agg(F.coalesce(
        F.min(F.when(F.col("cumsum") >= prop, F.col("axis"))), F.count("*").cast("int")).alias("axes"))


def scree_plot(scree_table: DataFrame, prop: float = 0.99) -> DataFrame:
    return scree_table.filter(F.col("axis") <= scree_min(scree_table, prop).scalar())


# ---- outliers -----------------------------------------------------------------------


def _density(v, mid, sd):
    z = (v - mid) / F.when(sd > 0, sd)
    return F.when(sd > 0, F.exp(-z * z / 2) / (sd * TWO_PI ** 0.5))


def outliers(scores: DataFrame, conf: float = 1e-3, nax: float | None = 0.99, middle: str = "median",
             key: str = "id") -> DataFrame:
    """Ids whose normal density is below ``conf`` on any of the first axes.

    ``scores`` is long (key, pc, score).  ``nax`` is a number of axes or, below
    1, the share of the variance that the axes reach; None takes all.
    """
    if nax is not None and nax < 1:
        sdev = small_side(scores.groupBy("pc").agg(F.stddev_samp("score").alias("sdev")))
        nax = scree_min(scree(sdev), nax).first().axes
    s = scores if nax is None else scores.filter(F.col("pc") <= int(nax))
    sd = F.stddev_samp("score").alias("_sd")
    if middle == "median":
        stats = quantiles(s, ["pc"], "score", [0.5], ["_mid"], [sd])
    else:
        stats = s.groupBy("pc").agg(sd, F.avg("score").alias("_mid"))
    return s.join(small_side(stats), "pc").filter(
        _density(F.col("score"), F.col("_mid"), F.col("_sd")) < conf).select(key).distinct()


def landmark_outliers(points: DataFrame, conf: float = 1e-3) -> DataFrame:
    """``id, seq, coordinate``: coordinates unlikely given the same landmark elsewhere."""
    long = points.unpivot(["id", "seq"], ["x", "y"], "coordinate", "value")
    stats = long.groupBy("seq", "coordinate").agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"))
    return long.join(small_side(stats), ["seq", "coordinate"]).filter(
        _density(F.col("value"), F.col("_m"), F.col("_s")) < conf).select("id", "seq", "coordinate")


# ---- reconstruction ------------------------------------------------------------------


def coefficients_at(requests: DataFrame, basis: Basis, scores: str = "scores", kind: str = "sd",
                    amplitude: float = 1.0, out: str = "coe") -> DataFrame:
    """Adds ``center + rotation x scores``; SD units are multiplied by sdev.

    Short score vectors are padded with zeros, long ones cut.
    """
    m = basis.rotation.T * amplitude
    if kind == "sd":
        m = basis.sdev[:, None] * m
    held = kernels.hold(requests, scores, F.col(scores))
    return held.withColumn(out, kernels.affine(F.col(scores), np.zeros(len(m)), m, basis.center))


def reconstruct(requests: DataFrame, basis: Basis, scores: str = "scores", kind: str = "sd",
                nb_h: int | None = None, nb_pts: int = 120, amplitude: float = 1.0) -> DataFrame:
    """Adds ``shape``: inverse Fourier outline of every request."""
    at = coefficients_at(requests, basis, scores, kind, amplitude, "_coe")
    return E.with_inverse(at, E.from_coe(F.col("_coe")), nb_h=nb_h, nb_pts=nb_pts).drop("_coe")


def shapes_at(positions: DataFrame, basis: Basis, axes: tuple[int, int], amplitude: float = 1.0,
              nb_pts: int = 60) -> DataFrame:
    """Outlines at ``x, y`` on two axes, moved so that their centroid is there."""
    part = Basis(basis.center, basis.rotation[:, [axes[0] - 1, axes[1] - 1]], basis.sdev)
    req = positions.withColumn("_sc", F.array("x", "y"))
    built = reconstruct(req, part, "_sc", "absolute", nb_pts=nb_pts, amplitude=amplitude).drop("_sc")
    return built.withColumn("shape", let(F.col("shape"), lambda c: lets(
        lambda k: O.translate(c, k["x"] - k["m"]["x"], k["y"] - k["m"]["y"]),
        x=F.col("x"), y=F.col("y"), m=O.centroid(c))))


def landmarks_at(positions: DataFrame, basis: Basis, axes: tuple[int, int], amplitude: float = 1.0) -> DataFrame:
    """Landmark sets at ``x, y``: the vector holds all x, then all y."""
    part = Basis(basis.center, basis.rotation[:, [axes[0] - 1, axes[1] - 1]], basis.sdev)
    at = coefficients_at(positions.withColumn("_sc", F.array("x", "y")), part, "_sc", "absolute", amplitude, "_v")
    half = (F.size("_v") / 2).cast("int")
    return at.withColumn("shape", F.zip_with(F.slice("_v", F.lit(1), half), F.slice("_v", half + 1, half), pt)).drop(
        "_v", "_sc")


def sweep(base: DataFrame, scores: str, axis: int, lo: float, hi: float, steps: int) -> DataFrame:
    """One request per step: PC ``axis`` set to evenly spaced values."""
    step = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    rows = base.select("*", step).withColumn("value", F.lit(float(lo)) + F.col("step") * ((hi - lo) / max(steps - 1, 1)))
    n = F.greatest(F.size(scores), F.lit(axis))
    return rows.withColumn(scores, let(F.struct(F.col(scores).alias("s"), F.col("value").alias("v")), lambda k: F.transform(
        F.sequence(F.lit(1), n), lambda i: F.when(i == axis, k["v"]).otherwise(
            F.coalesce(F.get(k["s"], i - 1), F.lit(0.0))))))


def contribution_requests(spark: SparkSession, axes: Sequence[int], sds: Sequence[float]) -> DataFrame:
    """``pc, sd, scores``: every axis at every number of SDs, others 0."""
    rows = [(int(a), float(s), [float(s) if i + 1 == a else 0.0 for i in range(max(axes))])
            for a in axes for s in sds]
    return spark.createDataFrame(rows, "pc int, sd double, scores array<double>")


def contributions(spark: SparkSession, basis: Basis, axes: Sequence[int], sds: Sequence[float],
                  nb_pts: int = 120) -> DataFrame:
    """``pc, sd, shape``: centred and closed outlines."""
    built = reconstruct(contribution_requests(spark, axes, sds), basis, kind="sd", nb_pts=nb_pts)
    return built.select("pc", "sd", O.close(O.center(F.col("shape"))).alias("shape"))


# ---- morphospace ---------------------------------------------------------------------


def _spaced(lo: Column, hi: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo + (hi - lo) * i / max(n - 1, 1))


def positions(scores: DataFrame, x: str, y: str, kind: str = "range", nb: int = 12, nr: int = 6, nc: int = 5,
              radius: float | None = None, conf: float = 0.5, window: Sequence[float] | None = None) -> DataFrame:
    """``x, y`` of the shapes to draw: range, circle, confell, xy, axes or full.

    ``window`` (x0, x1, y0, y1) replaces the plot window for axes and full.
    """
    if kind == "xy":
        return scores.select(F.col(x).alias("x"), F.col(y).alias("y"))
    if kind == "confell":
        from .ellipse import confidence_ellipse
        return confidence_ellipse(scores, [], x, y, conf, nb).select("x", "y")
    if kind in ("axes", "full"):
        x0, x1, y0, y1 = (float(w) for w in window)
        base = scores.sparkSession.range(1)
        if kind == "axes":
            across = base.select(F.explode(_spaced(F.lit(x0 * 0.9), F.lit(x1 * 0.9), nc)).alias("x"), F.lit(0.0).alias("y"))
            up = base.select(F.lit(0.0).alias("x"), F.explode(_spaced(F.lit(y0 * 0.9), F.lit(y1 * 0.9), nr)).alias("y"))
            return across.unionByName(up).distinct()
        w = max(x1 - x0, y1 - y0) * 0.45
        return base.select(F.explode(_spaced(F.lit(-w), F.lit(w), nr)).alias("x")).select(
            "x", F.explode(_spaced(F.lit(-w), F.lit(w), nc)).alias("y"))
    if kind == "circle":
        mean = scores.agg(F.struct(F.avg(x).alias("x"), F.avg(y).alias("y")).alias("m")).scalar()
        r = F.lit(float(radius)) if radius is not None else scores.withColumn("_m", mean).agg(F.sqrt(F.avg(
            F.pow(F.col(x) - F.col("_m.x"), F.lit(2.0)) + F.pow(F.col(y) - F.col("_m.y"), F.lit(2.0)))).alias("r")).scalar()
        return scores.sparkSession.range(1).select(r.alias("r"), F.explode(F.sequence(F.lit(0), F.lit(nb - 1))).alias("k")).select(
            (F.col("r") * F.cos(F.col("k") * F.lit(TWO_PI) / nb)).alias("x"),
            (F.col("r") * F.sin(F.col("k") * F.lit(TWO_PI) / nb)).alias("y"))
    b = scores.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    return b.select("*", F.explode(_spaced(F.col("x0"), F.col("x1"), nr)).alias("x")).select(
        "x", F.explode(_spaced(F.col("y0"), F.col("y1"), nc)).alias("y"))


def morphospace(positions_table: DataFrame, basis: Basis, axes: tuple[int, int], size: float = 1.0,
                amplitude: float = 1.0, nb_pts: int = 60, shown: int = 30, method: str = "efourier") -> DataFrame:
    """``x, y, shape``: template, centre, close and sample shapes at positions."""
    if method == "procrustes":
        built = landmarks_at(positions_table, basis, axes, amplitude)
        shape = O.center(O.template(F.col("shape"), size))
    else:
        built = shapes_at(positions_table, basis, axes, amplitude, nb_pts)
        shape = O.sample(O.close(O.center(O.template(F.col("shape"), size))), shown)
    placed = built.withColumn("_t", shape)
    return placed.withColumn("shape", O.translate(F.col("_t"), F.col("x"), F.col("y"))).drop("_t")
