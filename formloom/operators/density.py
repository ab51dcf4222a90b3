"""Kernel density on a grid without forming points x cells.

A Gaussian product kernel separates, so a partition needs two thin matrices
(points x grid columns, points x grid rows) whose product is its share of the
whole grid.  Each task emits one grid per group; grids are summed by cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import small_side
from .ranks import quantiles

BATCH = 50_000
HELD_BYTES = 64 << 20  # grids of a task, before their sums go out


def bandwidths(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """``keys, n, x0, x1, y0, y1, hx, hy``: normal-reference bandwidth per axis."""
    keys = list(keys)
    base = quantiles(df, keys, x, [0.25, 0.75], ["_xa", "_xb"], [
        F.count("*").alias("n"), F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"),
        F.max(y).alias("y1"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy")])
    q = quantiles(df, keys, y, [0.25, 0.75], ["_ya", "_yb"])
    base = base.join(q, keys) if keys else base.withColumn("_q", q.select(F.struct("*")).scalar()).select("*", "_q.*").drop("_q")

    def h(n):
        s = F.least(F.col(f"s{n}"), (F.col(f"_{n}b") - F.col(f"_{n}a")) / 1.34)
        return 1.06 * s * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    return base.select(*keys, "n", "x0", "x1", "y0", "y1", h("x").alias("hx"), h("y").alias("hy"))


def density(df: DataFrame, keys: Sequence[str], x: str, y: str, n_grid: int = 50, min_points: int = 10,
            limits: DataFrame | None = None, limit_keys: Sequence[str] = ()) -> DataFrame:
    """``keys, ix, iy, x, y, z`` over the data range of every group.

    ``limits`` (``limit_keys, x0, x1, y0, y1``) sets the grid's range instead.
    """
    keys = list(keys)
    band = bandwidths(df, keys, x, y).filter(F.col("n") >= min_points)
    if limits is not None:
        band = band.drop("x0", "x1", "y0", "y1").join(limits, list(limit_keys))
    band = small_side(band)
    par = F.struct("n", "x0", "x1", "y0", "y1", "hx", "hy").alias("_b")
    rows = df.select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    rows = rows.join(band.select(*keys, par), keys) if keys else rows.withColumn("_b", band.select(par).scalar())
    rows = rows.select(*keys, "x", "y", "_b.x0", "_b.x1", "_b.y0", "_b.y1", "_b.hx", "_b.hy")

    def kernel(v, lo, hi, h):
        g = np.linspace(lo, hi, n_grid)
        z = (v[:, None] - g[None, :]) / h
        return np.exp(-0.5 * z * z)

    def share(pdf):
        p = pdf.iloc[0]
        total = np.zeros((n_grid, n_grid))
        vx, vy = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        for i in range(0, len(pdf), BATCH):
            total += kernel(vx[i:i + BATCH], p.x0, p.x1, p.hx).T @ kernel(vy[i:i + BATCH], p.y0, p.y1, p.hy)
        return total

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict = {}

        def flush():
            for key, grid in held.items():
                ix, iy = np.divmod(np.arange(n_grid * n_grid, dtype=np.int32), n_grid)
                yield pd.DataFrame({**{k: [v] * len(ix) for k, v in zip(keys, key)}, "ix": ix, "iy": iy, "s": grid.ravel()})
            held.clear()
        for pdf in batches:
            groups = pdf.groupby(keys, sort=False) if keys else [((), pdf)]
            for key, g in groups:
                held[key] = held[key] + share(g) if key in held else share(g)
                if 8 * n_grid * n_grid * len(held) > HELD_BYTES:
                    yield from flush()
        yield from flush()
    schema = T.StructType(df.select(*keys).schema.fields + [
        T.StructField("ix", T.IntegerType()), T.StructField("iy", T.IntegerType()), T.StructField("s", T.DoubleType())])
    sums = rows.mapInPandas(run, schema).groupBy(*keys, "ix", "iy").agg(F.sum("s").alias("s"))
    out = sums.join(band, keys) if keys else sums.withColumn("_b", band.select(par).scalar()).select("*", "_b.*")
    step = n_grid - 1
    return out.select(
        *keys, "ix", "iy", (F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("ix") / step).alias("x"),
        (F.col("y0") + (F.col("y1") - F.col("y0")) * F.col("iy") / step).alias("y"),
        (F.col("s") / (F.col("n") * F.col("hx") * F.col("hy") * (2 * np.pi))).alias("z"))
