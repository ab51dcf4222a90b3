"""Set-level Fourier operators: calibrations over all outlines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import efa as E
from ..functions import outline as O
from ..functions.base import div
from .ranks import quantiles


def power_profile(outlines: DataFrame, nb_h: int, drop: int = 1,
                  keys: Sequence[str] = (), norm: bool = False) -> DataFrame:
    """``keys, h, med``: median cumulative power (%) per harmonic over shapes."""
    ef = E.with_forward(outlines, nb_h)
    harm = E.normalise(F.col("ef"))["harm"] if norm else F.col("ef.harm")
    rows = ef.select(*keys, F.posexplode(E.cumulative_power(harm, drop)).alias("_p", "value"))
    rows = rows.select(*keys, (F.col("_p") + 1 + drop).cast("int").alias("h"), "value")
    return quantiles(rows, [*keys, "h"], "value", [0.5], ["med"])


def power_calibration(profile: DataFrame, thresholds: Sequence[float] = (90, 95, 99, 99.9)) -> DataFrame:
    """``threshold, minh``: first harmonic whose median exceeds the threshold."""
    picked = profile.agg(*[F.min(F.when(F.col("med") > t, F.col("h"))).alias(f"t{i}")
                           for i, t in enumerate(thresholds)])
    return picked.select(F.explode(F.array(*[F.struct(
        F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("minh"))
        for i, t in enumerate(thresholds)])).alias("r")).select("r.*")


def _at_ranks(ef: DataFrame, ranks: Sequence[int], nb_pts: int) -> DataFrame:
    """One row per (outline, rank) with the rebuilt ``shape``."""
    rows = ef.withColumn("rank", F.explode(F.array(*[F.lit(int(r)) for r in ranks])))
    return E.with_inverse(rows, F.col("ef.harm"), F.col("ef.ao"), F.col("ef.co"), F.col("rank"), nb_pts)


def reconstructions(outlines: DataFrame, ranks: Sequence[int], nb_pts: int = 120) -> DataFrame:
    """``id, rank, seq, x, y``: each centred outline rebuilt at several ranks."""
    ef = E.with_forward(outlines, max(ranks), O.center(F.col("coo"))).select("id", "ef")
    rows = _at_ranks(ef, ranks, nb_pts)
    return rows.select("id", "rank", F.posexplode("shape").alias("_s", "p")).select(
        "id", "rank", (F.col("_s") + 1).cast("int").alias("seq"),
        F.col("p.x").alias("x"), F.col("p.y").alias("y"))


def deviations(outlines: DataFrame, ranks: Sequence[int], nb_pts: int = 120, factor: float = 1.0,
               norm_size: bool = True, method: str = "nearest") -> DataFrame:
    """``rank, pt, med, sd``: distance of rebuilt points to the outline.

    ``method`` is ``nearest`` (closest outline point) or ``matched`` (same
    index).  Distances stay inside each row; only n x ranks x points numbers
    are aggregated.
    """
    coo = F.col("coo")
    points = F.floor(F.size(coo) * F.lit(float(factor))).cast("int") if method == "nearest" else nb_pts
    ef = O.with_interpolated(E.with_forward(outlines, max(ranks)), coo, points, "best").select(
        "ef", "best", (O.centroid_size(coo) if norm_size else F.lit(1.0)).alias("size"))
    rows = _at_ranks(ef, ranks, nb_pts)
    if method == "nearest":
        rows = O.with_nearest(rows, F.col("shape"), F.col("best"))
        d = F.col("near.d")
    else:
        d = O.matched_distance(F.col("shape"), F.col("best"))
    rows = rows.select("rank", "size", F.posexplode(d).alias("_p", "d")).select(
        "rank", (F.col("_p") + 1).cast("int").alias("pt"), div(F.col("d"), F.col("size")).alias("d"))
    return quantiles(rows, ["rank", "pt"], "d", [0.5], ["med"], [F.stddev_samp("d").alias("sd")])


# ---- coefficients with a harmonic count of their own --------------------------------------------


def automatic_harmonics(outlines: DataFrame, threshold: float = 99.0) -> int:
    """The first harmonic whose median cumulative power exceeds ``threshold``; the set's cap if none does.

    The cap is floor(min(points)/2)-1; the profile is one row per harmonic.
    """
    cap = outlines.agg((F.floor(F.min(F.size("coo")) / 2) - 1).cast("int").alias("q")).first().q
    if cap is None or cap < 1:
        raise ValueError("outlines of four points or more are needed")
    if cap < 3:
        return cap
    found = power_calibration(power_profile(outlines, cap), [threshold]).first().minh
    return cap if found is None else min(int(found), cap)


def coefficients(outlines: DataFrame, nb_h: int | None = None, **options) -> DataFrame:
    """``efourier`` with the automatic number of harmonics unless one is given."""
    return E.efourier(outlines, automatic_harmonics(outlines) if nb_h is None else nb_h, **options)
