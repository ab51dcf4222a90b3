"""Set-level operators over a table of outlines (``id, ..., coo``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws
from ..functions import outline as O
from ..functions.base import div, let, pt
from .hull import with_hull


def template_relatively(outlines: DataFrame, size: float = 1.0) -> DataFrame:
    """Template each outline to ``size`` times its share of the largest box."""
    box = let(O.diff_range(F.col("coo")), lambda b: b["x"] * b["y"])
    largest = outlines.agg(F.max(box).alias("m")).scalar()
    sized = outlines.withColumn("_k", div(box, largest) * size)
    return sized.withColumn("coo", O.template(F.col("coo"), F.col("_k"))).drop("_k")


def set_range(outlines: DataFrame, enlarge: float = 0.0) -> DataFrame:
    """One row with struct ``b``: the range over all points, widened by k spans."""
    b = O.bounding_box(F.col("coo"))
    m = outlines.select(b.alias("b")).agg(
        F.min("b.x0").alias("x0"), F.max("b.x1").alias("x1"),
        F.min("b.y0").alias("y0"), F.max("b.y1").alias("y1"))
    dx, dy = (F.col("x1") - F.col("x0")) * enlarge, (F.col("y1") - F.col("y0")) * enlarge
    return m.select(F.struct((F.col("x0") - dx).alias("x0"), (F.col("x1") + dx).alias("x1"),
                             (F.col("y0") - dy).alias("y0"), (F.col("y1") + dy).alias("y1")).alias("b"))


def jitter(outlines: DataFrame, amount: float, seed: int) -> DataFrame:
    """Uniform noise within +-amount on every coordinate."""
    def noisy(p, i):
        def u(axis):
            return draws.uniform(F.lit(seed), F.col("id"), i + 1, F.lit(axis)) * (2 * amount) - amount
        return pt(p["x"] + u("x"), p["y"] + u("y"))
    return outlines.withColumn("coo", F.transform("coo", noisy))


def descriptors(outlines: DataFrame, rectilinearity: bool = False) -> DataFrame:
    """One row of 15 (16) shape descriptors per outline."""
    keep = [c for c in outlines.columns if c != "coo"]
    c = F.col("coo")
    base = with_hull(outlines).select(
        *keep, "coo", O.extract(c, F.col("hull")).alias("h"), O.area(c).alias("area"),
        O.perimeter(c).alias("perim"), O.length_width(c).alias("lw"), F.col("caliper.length").alias("calliper"))
    area, perim, lw = F.col("area"), F.col("perim"), F.col("lw")
    out = [
        area, F.col("calliper"), O.centroid_size(c).alias("centsize"),
        div(perim * perim, area).alias("circularity"),
        O.circularity_haralick(c).alias("circularityharalick"),
        div(perim * perim, area * 12.566370614359172).alias("circularitynorm"),
        div(O.perimeter(F.col("h")), perim).alias("convexity"),
        div(lw["width"], lw["length"]).alias("eccentricityboundingbox"),
        O.eccentricity_eigen(c).alias("eccentricityeigen"),
        (1 - div(lw["width"], lw["length"])).alias("elongation"),
        lw["length"].alias("length"), perim,
        div(area, lw["length"] * lw["width"]).alias("rectangularity"),
        div(area, O.area(F.col("h"))).alias("solidity"), lw["width"].alias("width")]
    if rectilinearity:
        base = O.with_rectilinearity(base, c)
        out.append(F.col("rectilinearity"))
    return base.select(*keep, *out)
