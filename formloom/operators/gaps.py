"""Empty regions of a morphospace.

Points are pairs of score axes ``(pair, id, x, y)``.  A perturbed point finds its
grid cells by arithmetic, so no point meets the whole grid; which runs draw a row follows from the row's key.
What moves is bounded by cells x draws, never by points.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import draws
from ..functions import outline as O
from ..functions.base import div, let, pt
from ..session import cut, small_side
from .cells import answers
from .components import components
from .density import density
from .filters import keep_groups, require_rows
from .hull import convex_hull
from .joins import region_depth
from .occupancy import occupied_counts
from .ranks import row_index
from .resample import boot_size
from .tables import column_pairs


# ---- grid and domain ----------------------------------------------------------------


def grid(points: DataFrame, resolution: int, buffer: float) -> DataFrame:
    """One row per pair: origin, steps, cell size and span of the analysis grid."""
    b = points.groupBy("pair").agg(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                   F.min("y").alias("y0"), F.max("y").alias("y1"))
    sx, sy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    step = resolution - 1
    return b.select("pair", (F.col("x0") - buffer * sx).alias("gx0"), (F.col("y0") - buffer * sy).alias("gy0"),
                    (sx * (1 + 2 * buffer) / step).alias("dx"), (sy * (1 + 2 * buffer) / step).alias("dy"),
                    sx.alias("span_x"), sy.alias("span_y")).withColumn("cell", (F.col("dx") + F.col("dy")) / 2)


def cells(grid_table: DataFrame, resolution: int) -> DataFrame:
    """``pair, ix, iy, x, y`` of all grid points."""
    # a grid has one row: its columns are dealt out before the cells are listed
    c = grid_table.withColumn("ix", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1)))).repartition("pair", "ix").withColumn(
        "iy", F.explode(F.sequence(F.lit(0), F.lit(resolution - 1))))
    return c.select("pair", "ix", "iy", (F.col("gx0") + F.col("ix") * F.col("dx")).alias("x"),
                    (F.col("gy0") + F.col("iy") * F.col("dy")).alias("y"))


def alpha_points(points: DataFrame, alpha: float) -> DataFrame:
    """Points with another one within 2 alpha.

    In square cells of that diagonal two points always qualify; only the lone
    point of a cell asks the 24 cells around, whole cells by their extremes.
    """
    reach = 2 * alpha
    side = reach / 2 ** 0.5
    placed = points.withColumn("_i", F.floor(F.col("x") / side)).withColumn("_j", F.floor(F.col("y") / side))
    counts = cut(placed.groupBy("pair", "_i", "_j").agg(F.count("*").alias("_n")))
    crowded = placed.join(counts.filter("_n > 1"), ["pair", "_i", "_j"], "left_semi")
    lone = placed.join(counts.filter("_n = 1"), ["pair", "_i", "_j"], "left_semi")
    other = ~((F.col("_a") == F.col("_i")) & (F.col("_b") == F.col("_j")))
    around = lone.withColumn("_a", F.explode(F.sequence(F.col("_i") - 2, F.col("_i") + 2))).withColumn(
        "_b", F.explode(F.sequence(F.col("_j") - 2, F.col("_j") + 2))).filter(other).select(
        "pair", "id", "x", "y", F.col("_a").alias("_i"), F.col("_b").alias("_j"))
    keyed = placed.select("pair", F.col("id").alias("found"), F.col("x").alias("_x"), F.col("y").alias("_y"), "_i", "_j")

    def span(c, lo, hi):
        return F.greatest(lo - F.col(c), F.col(c) - hi, F.lit(0.0)), F.greatest(F.abs(F.col(c) - lo), F.abs(F.col(c) - hi))

    def nearest(x0, x1, y0, y1):
        return F.hypot(span("x", x0, x1)[0], span("y", y0, y1)[0])

    def farthest(x0, x1, y0, y1):
        return F.hypot(span("x", x0, x1)[1], span("y", y0, y1)[1])
    near = answers(keyed, around, side, lambda *e: farthest(*e) <= reach, lambda *e: nearest(*e) > reach, ["pair"])
    return crowded.drop("_i", "_j").unionByName(lone.drop("_i", "_j").join(near.select("pair", "id"), ["pair", "id"], "left_semi"))


def domain_polygon(points: DataFrame, hull_type: str = "convex", alpha: float | None = None) -> DataFrame:
    """``pair, ring``: counter-clockwise hull of the domain points.

    The default alpha is twice the largest nearest-neighbour distance, so every
    point has another one within reach and the alpha domain is the convex hull.
    """
    used = alpha_points(points, alpha) if hull_type == "alpha" and alpha is not None else points
    h = convex_hull(used, ["pair"], "x", "y", "id")
    ring = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("ord", "x", "y")))), lambda p: pt(p["x"], p["y"]))
    return h.groupBy("pair").agg(ring.alias("ring"))


def in_polygon(x: Column, y: Column, ring: Column, buffer: Column) -> Column:
    """Strictly inside a convex counter-clockwise ring, or closer than ``buffer`` to an edge."""
    def edge(p, q):
        ux, uy = q["x"] - p["x"], q["y"] - p["y"]
        px, py = x - p["x"], y - p["y"]
        t = F.least(F.greatest(div(px * ux + py * uy, ux * ux + uy * uy), F.lit(0.0)), F.lit(1.0))
        return F.struct((ux * py - uy * px > 0).alias("left"), F.hypot(px - t * ux, py - t * uy).alias("d"))
    return let(F.zip_with(ring, O.with_next(ring), edge), lambda es: (
        F.forall(es, lambda e: e["left"]) | F.exists(es, lambda e: e["d"] < buffer)))


def domain_cells(cell_table: DataFrame, polygon: DataFrame, grid_table: DataFrame, buffer: float) -> DataFrame:
    """Cells inside the buffered domain polygon."""
    b = grid_table.select("pair", (buffer * (F.col("span_x") + F.col("span_y")) / 2).alias("_buf"))
    return cell_table.join(polygon, "pair").join(b, "pair").filter(
        in_polygon(F.col("x"), F.col("y"), F.col("ring"), F.col("_buf"))).drop("ring", "_buf")


# ---- occupancy ------------------------------------------------------------------------


def perturb(points: DataFrame, uncertainty: float, seed: int, keys: Sequence[str] = (), kind: str = "gaussian") -> DataFrame:
    """Moves x and y by measurement noise; ``span_x, span_y`` are columns, ``keys`` small integers that tell the draws of a row apart.

    Gaussian noise has 95 % of its mass within the uncertainty; uniform noise
    fills it.
    """
    # one key per draw: two uniform numbers for each axis
    h = draws.mixed(draws.key(F.lit(seed), F.col("pair"), F.col("id")), *[F.col(k) for k in keys])
    drawn = points.withColumn("_h", h).select("*", *[(draws.mixed(F.col("_h"), i + 1) / F.lit(4294967296.0)).alias(f"_u{i}") for i in range(4)])

    def moved(axis, a, b):
        reach = uncertainty * F.col(f"span_{axis}")
        if kind == "uniform":
            return F.col(axis) + (F.col(a) * 2 - 1) * reach
        return F.col(axis) + draws.box_muller(F.col(a), F.col(b)) * (reach / 1.96)
    rest = [c for c in points.columns if c not in ("x", "y")]
    return drawn.select(*rest, moved("x", "_u0", "_u1").alias("x"), moved("y", "_u2", "_u3").alias("y"))


def covered_cells(points: DataFrame, keys: Sequence[str], resolution: int, radius: float = 1.5) -> DataFrame:
    """``keys, ix, iy``: cells whose centre is within ``radius`` cell sizes.

    The grid columns travel with the point; a point lists the few cells of its
    bounding square and keeps those inside the circle.
    """
    r = radius * F.col("cell")

    def reach(v, origin, step):
        lo = F.greatest(F.ceil(div(F.col(v) - r - F.col(origin), F.col(step))), F.lit(0)).cast("int")
        hi = F.least(F.floor(div(F.col(v) + r - F.col(origin), F.col(step))), F.lit(resolution - 1)).cast("int")
        return F.when(hi >= lo, F.sequence(lo, F.greatest(lo, hi)))
    near = points.withColumn("ix", F.explode(reach("x", "gx0", "dx"))).withColumn("iy", F.explode(reach("y", "gy0", "dy")))
    d = F.hypot(F.col("gx0") + F.col("ix") * F.col("dx") - F.col("x"), F.col("gy0") + F.col("iy") * F.col("dy") - F.col("y"))
    return near.filter(d <= r).select(*keys, "ix", "iy")


def kde_cells(points: DataFrame, keys: Sequence[str], grid_table: DataFrame, resolution: int,
              threshold: float = 0.0) -> DataFrame:
    """``keys, ix, iy`` with a kernel density above ``threshold``."""
    n = resolution - 1
    lim = grid_table.select("pair", F.col("gx0").alias("x0"), (F.col("gx0") + n * F.col("dx")).alias("x1"),
                            F.col("gy0").alias("y0"), (F.col("gy0") + n * F.col("dy")).alias("y1"))
    z = density(points, keys, "x", "y", resolution, 2, lim, ["pair"])
    return z.filter(F.col("z") > threshold).select(*keys, "ix", "iy")


def monte_carlo_counts(points: DataFrame, grid_table: DataFrame, resolution: int, iterations: int, uncertainty: float,
                       seed: int, radius: float = 1.5, kind: str = "gaussian", method: str = "radius") -> DataFrame:
    """``pair, ix, iy, hits, full``: draws in which a cell is occupied, all rows in every draw."""
    if method == "kde":
        return _dense_counts(points, grid_table, resolution, 1, iterations, uncertainty, seed, None, kind)
    return occupied_counts(points, grid_table, resolution, 1, iterations, uncertainty, seed, None, radius, kind)


def bootstrap_rate(points: DataFrame, size: float | None) -> float:
    """Mean number of times that a run draws a row: the asked sample size over the number of rows."""
    if size is None:
        return 1.0
    r = points.agg(F.count_distinct("id").alias("n")).select("n", boot_size(F.col("n"), size).alias("m")).first()
    return r.m / r.n


def bootstrap_counts(points: DataFrame, grid_table: DataFrame, resolution: int, iterations: int, mc: int,
                     uncertainty: float, seed: int, size: float | None = None, radius: float = 1.5,
                     kind: str = "gaussian", method: str = "radius") -> DataFrame:
    """``pair, ix, iy, hits, full``: occupied draws over all bootstraps, and bootstraps with at least half of their draws occupied.

    A bootstrap draws every row a Poisson number of times, known from the row's key, so rows are never looked up; its
    size varies around the asked one.
    """
    rate = bootstrap_rate(points, size)
    if method == "kde":
        return _dense_counts(points, grid_table, resolution, iterations, mc, uncertainty, seed, rate, kind)
    return occupied_counts(points, grid_table, resolution, iterations, mc, uncertainty, seed, rate, radius, kind)


def count_draws(occ: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, hits``: distinct draws ``m``, as bits of 64-bit words.

    A word folds on the map side to one number per cell, so neither the shuffle
    nor the hash table grows with points or draws of the same word.
    """
    words = occ.groupBy(*keys, F.floor(F.col("m") / 64).alias("_w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(m % 64 as int))")).alias("_bits"))
    return words.groupBy(*keys).agg(F.sum(F.bit_count("_bits")).cast("bigint").alias("hits"))


def _dense_counts(points, grid_table, resolution, runs, mc, uncertainty, seed, rate, kind) -> DataFrame:
    """The same counts with cells of positive kernel density as occupied ones."""
    rows = points.join(F.broadcast(grid_table), "pair").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(runs))))
    times = F.lit(1) if rate is None else draws.copies(draws.key(F.lit(seed), F.col("pair"), F.col("id")), F.col("b"), draws.poisson_steps(rate))
    rows = rows.withColumn("_t", times).filter("_t > 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_t") - 1))).drop("_t")
    moved = perturb(rows.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(mc)))), uncertainty, seed, ["b", "k", "m"], kind)
    dense = kde_cells(moved, ["pair", "b", "m"], grid_table, resolution)
    per_run = count_draws(dense, ["pair", "ix", "iy", "b"])
    return per_run.groupBy("pair", "ix", "iy").agg(F.sum("hits").alias("hits"), F.count_if(1 - F.col("hits") / mc <= 0.5).alias("full"))


def gap_probability(domain: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """``pair, ix, iy, x, y, probability``: one minus the share of occupied draws."""
    return domain.join(counts.select("pair", "ix", "iy", "hits"), ["pair", "ix", "iy"], "left").withColumn(
        "probability", 1 - F.coalesce("hits", F.lit(0)) / total).drop("hits")


def gap_stability(domain: DataFrame, counts: DataFrame, iterations: int) -> DataFrame:
    """``..., stability``: share of bootstraps with gap probability above one half."""
    return domain.join(counts.select("pair", "ix", "iy", "full"), ["pair", "ix", "iy"], "left").withColumn(
        "stability", 1 - F.coalesce("full", F.lit(0)) / iterations).drop("full")


# ---- regions ---------------------------------------------------------------------------


TILE = 128
ROW = 1 << 31  # a cell as one number: iy * ROW + ix


def tile_labels(cell: np.ndarray, side: int) -> np.ndarray:
    """The smallest cell of each cell's component, for distinct cells of one ``side`` x ``side`` tile.

    Minima run along whole rows and columns of cells in turns, until nothing changes.
    """
    iy, ix = (cell // ROW) % side, (cell % ROW) % side
    none = np.iinfo(np.int64).max
    label = np.full((side + 1, side + 1), none)  # the last row and column stay empty: they end the runs
    label[iy, ix] = cell
    filled = label != none

    def along(values, full):
        flat, inside = values.ravel(), full.ravel()
        edge = np.flatnonzero(np.append(True, inside[1:] != inside[:-1]))
        least = np.minimum.reduceat(flat, edge)
        return np.repeat(least, np.diff(np.append(edge, len(flat)))).reshape(values.shape)
    while True:
        new = along(label, filled)
        new = np.ascontiguousarray(along(np.ascontiguousarray(new.T), np.ascontiguousarray(filled.T)).T)
        if (new == label).all():
            return new[iy, ix]
        label = new


def label_regions(certain: DataFrame, thresholds: Sequence[float], tile: int = TILE) -> DataFrame:
    """``pair, threshold, gap_id, ix, iy, x, y, certainty`` of connected cells.

    Cells join along the four sides.  Cells are labelled inside square tiles of a fixed side, then the labels that touch across
    tile borders are merged as components, so no task sees a grid.  Ids count in the
    order of each region's first cell (iy, ix).
    """
    keys = ["pair", "threshold"]
    cuts = F.array(*[F.lit(float(t)) for t in thresholds])
    rows = certain.withColumn("threshold", F.explode(cuts)).filter(F.col("certainty") >= F.col("threshold")).select(
        *keys, "ix", "iy", "x", "y", "certainty")
    schema = T.StructType(rows.schema.fields + [T.StructField("label", T.LongType())])

    def label(t: pa.Table) -> pa.Table:
        t = t.drop_columns(["_tx", "_ty"])
        at = [t[c].combine_chunks().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("iy", "ix")]
        return t.append_column("label", pa.array(tile_labels(at[0] * ROW + at[1], tile), pa.int64()))
    tiles = rows.withColumn("_tx", F.floor(F.col("ix") / tile)).withColumn("_ty", F.floor(F.col("iy") / tile))
    labelled = cut(tiles.groupBy(*keys, "_tx", "_ty").applyInArrow(label, schema))

    def touching(side, other):
        # the last column (row) of a tile against the first one of the next
        here = labelled.filter(F.col(side) % tile == tile - 1).select(*keys, (F.col(side) + 1).alias(side), other, F.col("label").alias("a"))
        return here.join(labelled.filter(F.col(side) % tile == 0).select(*keys, side, other, F.col("label").alias("b")), [*keys, side, other]).select(*keys, "a", "b")
    merged = components(touching("ix", "iy").unionByName(touching("iy", "ix")), keys).withColumnRenamed("node", "label")
    named = cut(labelled.select(*keys, "label").distinct().join(merged, [*keys, "label"], "left").withColumn("root", F.coalesce("root", "label")))
    ids = row_index(named.select(*keys, "root").distinct(), "root", "gap_id", within=keys)
    named = cut(named.join(ids.select(*keys, "root", F.col("gap_id").cast("int").alias("gap_id")), [*keys, "root"]))
    return labelled.join(named.select(*keys, "label", "gap_id"), [*keys, "label"]).select(*keys, "gap_id", "ix", "iy", "x", "y", "certainty")


def region_metrics(regions: DataFrame, grid_table: DataFrame, points: DataFrame) -> DataFrame:
    """Area (cells x cell area), certainty, centroid and depth per region."""
    m = regions.groupBy("pair", "threshold", "gap_id").agg(
        F.count("*").alias("n_cells"), F.avg("certainty").alias("mean_certainty"), F.max("certainty").alias("max_certainty"),
        F.avg("x").alias("centroid_x"), F.avg("y").alias("centroid_y"))
    m = m.join(F.broadcast(grid_table.select("pair", (F.col("dx") * F.col("dy")).alias("_a"))), "pair").withColumn(
        "area", F.col("n_cells") * F.col("_a")).drop("_a")
    # a region is found again by its pair; the threshold goes into its key
    keyed = m.withColumn("_g", F.col("gap_id")).withColumn("gap_id", F.struct("threshold", "_g"))
    return region_depth(keyed, points.select("pair", "x", "y"), ["pair"]).withColumn("gap_id", F.col("_g")).drop("_g")


def relief(certain: DataFrame) -> DataFrame:
    """``pair, ix, iy, x, y, certainty, elevation`` for maps."""
    return certain.filter(F.col("certainty").isNotNull()).select(
        "pair", "ix", "iy", "x", "y", "certainty", (1 - F.col("certainty")).alias("elevation"))


def summary(metrics: DataFrame) -> DataFrame:
    """Region metrics with the axes of their pair, largest first per pair."""
    parts = F.split("pair", "-")
    return metrics.select(F.col("pair").alias("pc_pair"), parts.getItem(0).alias("pc_x"), parts.getItem(1).alias("pc_y"),
                          "threshold", "gap_id", "n_cells", "area", "mean_certainty", "max_certainty", "centroid_x",
                          "centroid_y", "gap_depth")


def top_gaps(summary_table: DataFrame, n: int = 5) -> DataFrame:
    return summary_table.orderBy(F.desc("area"), "pc_pair", "threshold", "gap_id").limit(n)


# ---- the whole analysis ------------------------------------------------------------------


def detect_gaps(scores: DataFrame, pcs: Sequence[str], uncertainty: float = 0.05, resolution: int = 150,
                mc: int = 100, bootstraps: int = 200, size: float | None = None, group: str | None = None,
                groups: Sequence | None = None, domain_reference: str = "all", estimation: str = "bootstrap_mc",
                thresholds: Sequence[float] = (0.8, 0.9, 0.95), mc_bootstrap: int | None = None,
                domain_mode: str = "hull", hull_type: str = "convex", alpha: float | None = None, buffer: float = 0.05,
                kind: str = "gaussian", method: str = "radius", radius: float = 1.5, seed: int = 1,
                id_col: str = "ID") -> dict[str, DataFrame]:
    """Grid, certainty per cell, regions and summary for all PC pairs in one plan.

    ``domain_reference`` says whether the grid and domain come from all rows or
    from the chosen groups only.
    """
    wide = scores.withColumnRenamed(id_col, "id") if id_col != "id" else scores
    chosen = keep_groups(wide, group, groups) if group else wide
    require_rows(chosen, 3, "specimens")
    points = column_pairs(chosen, pcs, ["id"], all_pairs=True)
    base = column_pairs(wide, pcs, ["id"], all_pairs=True) if domain_reference == "all" else points
    g = grid(base, resolution, buffer)
    domain = cells(g, resolution)
    if domain_mode == "hull":
        domain = domain_cells(domain, domain_polygon(base, hull_type, alpha), g, buffer)
    common = dict(uncertainty=uncertainty, seed=seed, radius=radius, kind=kind, method=method)
    if estimation == "two_stage":
        m2 = mc_bootstrap or max(50, mc // 2)
        prob = gap_probability(domain, monte_carlo_counts(points, g, resolution, mc, **common), mc)
        stab = gap_stability(domain, bootstrap_counts(points, g, resolution, bootstraps, m2, size=size, **common), bootstraps)
        certain = two_stage(prob, stab)
    else:
        m2 = mc_bootstrap or mc
        counts = bootstrap_counts(points, g, resolution, bootstraps, m2, size=size, **common)
        certain = gap_probability(domain, counts, bootstraps * m2).withColumn("certainty", F.col("probability"))
    # one row per cell: written once, since regions, metrics and maps all read it
    certain = cut(certain)
    regions = cut(label_regions(certain, thresholds))
    metrics = region_metrics(regions, g, points)
    return {"grid": g, "certainty": certain, "regions": regions, "summary": summary(metrics)}


def two_stage(probability: DataFrame, stability: DataFrame) -> DataFrame:
    """Certainty = probability x stability per cell."""
    return probability.join(stability.select("pair", "ix", "iy", "stability"), ["pair", "ix", "iy"]).withColumn(
        "certainty", F.col("probability") * F.col("stability"))
