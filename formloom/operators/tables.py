"""Table forms: flattening, layouts, coefficient columns, group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import outline as O
from ..functions.base import div, let, pt
from ..session import small_side
from ..sources.text import pc_columns
from .ranks import quantiles, row_index


def _span(df: DataFrame, col: str):
    return df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()


def min_max(df: DataFrame, col: str, out: str) -> DataFrame:
    """``(v - min) / max(v - min)`` from one scalar aggregate."""
    return df.withColumn("_s", _span(df, col)).withColumn(
        out, div(F.col(col) - F.col("_s.lo"), F.col("_s.hi") - F.col("_s.lo"))).drop("_s")


def colour_bin(df: DataFrame, col: str, bins: int, out: str = "bin") -> DataFrame:
    """Equal-width bin 1..bins of the normalised value (maximum in the last)."""
    return df.withColumn("_s", _span(df, col)).withColumn(out, F.least(
        F.width_bucket(F.col(col), F.col("_s.lo"), F.col("_s.hi"), F.lit(bins)),
        F.lit(bins).cast("bigint"))).drop("_s")


# ---- shapes and factors ----------------------------------------------------------


def build_outlines(points: DataFrame, factors: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``id, coo`` (+ factors) from a points table; one outline is one group."""
    coo = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: pt(p["x"], p["y"]))
    out = points.groupBy(key).agg(coo.alias("coo"))
    return out.join(factors, key, "left") if factors is not None else out


def default_names(df: DataFrame, order: str, out: str = "name") -> DataFrame:
    """``shp<n>`` in the order of the unique column ``order``."""
    return row_index(df, order, "_n").withColumn(out, F.concat(F.lit("shp"), F.col("_n").cast("string"))).drop("_n")


def coefficient_table(df: DataFrame, coe: str, method: str, norm: bool) -> DataFrame:
    """``id, <factors>, coe`` with method, norm and harmonic count in the metadata."""
    meta = {"method": method, "norm": norm, "blocks": 4}
    return df.select(*[c for c in df.columns if c != coe],
                     F.col(coe).cast("array<double>").alias("coe", metadata=meta))


def flatten_scores(scores: DataFrame, retain: float | None = None, shares: Sequence[float] | None = None,
                   n_rows: int | None = None, keep: Sequence[str] = ("ID", "group")) -> DataFrame:
    """Factors with the first ``retain`` PCs.

    Below 1 it is a variance share (axes needed, from ``shares``); the default
    is the row count, then cut to the columns there are.
    """
    pcs = pc_columns(scores.columns)
    if retain is None:
        retain = n_rows if n_rows is not None else len(pcs)
    elif retain < 1:
        total, k = 0.0, len(shares)
        for i, s in enumerate(shares):
            total += s
            if total >= retain:
                k = i + 1
                break
        retain = k
    return scores.select(*keep, *pcs[:int(retain)])


def flatten_classes(pred: DataFrame, scores: Sequence[str], retain: int | None = None) -> DataFrame:
    """``actual, predicted, posterior`` (largest) and the first scores."""
    keep = list(scores)[:retain] if retain else list(scores)
    return pred.select("id", "actual", "predicted", F.array_max("posterior").alias("posterior"), *keep)


# ---- layouts -----------------------------------------------------------------------


def to_wide(outlines: DataFrame, k: int, key: str = "id") -> DataFrame:
    """``x1..xk y1..yk`` columns (all outlines of one length)."""
    return outlines.select(key, *[F.element_at("coo", i + 1)["x"].alias(f"x{i + 1}") for i in range(k)],
                           *[F.element_at("coo", i + 1)["y"].alias(f"y{i + 1}") for i in range(k)])


def from_wide(wide: DataFrame, k: int, key: str = "id") -> DataFrame:
    return wide.select(key, F.array(*[pt(F.col(f"x{i + 1}"), F.col(f"y{i + 1}")) for i in range(k)]).alias("coo"))


def split_lengths(coo: Column, lengths: Sequence[int]) -> Column:
    """Consecutive pieces of the given lengths."""
    out, at = [], 1
    for n in lengths:
        out.append(F.slice(coo, at, n))
        at += n
    return F.array(*out)


def long_matrix(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``key, variable, value`` (melt)."""
    return df.unpivot(key, list(cols), "variable", "value")


def wide_coefficients(coefs: DataFrame, nb_h: int, by: str = "letter", key: str = "id") -> DataFrame:
    """One column per coefficient, ordered by letter or by harmonic rank."""
    names = [(letter, h) for letter in "ABCD" for h in range(1, nb_h + 1)]
    if by == "rank":
        names.sort(key=lambda n: (n[1], n[0]))
    pos = {n: "ABCD".index(n[0]) * nb_h + n[1] for n in names}
    return coefs.select(key, *[F.element_at("coe", pos[n]).alias(f"{n[0]}{n[1]}") for n in names])


def panel(outlines: DataFrame) -> DataFrame:
    """``id, label, coo``: centred shapes scaled by their largest coordinate.

    Shapes with fewer than three points or a non-finite one are dropped;
    the label is ``id (i)`` with the position among the shapes kept.
    """
    good = outlines.filter(O.is_valid_import(F.col("coo")))
    unit = let(O.center(F.col("coo")), lambda c: let(
        F.array_max(F.transform(c, lambda p: F.greatest(F.abs(p["x"]), F.abs(p["y"])))),
        lambda m: F.transform(c, lambda p: pt(div(p["x"], m), div(p["y"], m)))))
    return row_index(good.select("id", unit.alias("coo")), "id", "_i").select(
        "id", F.concat(F.col("id").cast("string"), F.lit(" ("), F.col("_i").cast("string"), F.lit(")")).alias("label"),
        "coo")


def column_pairs(df: DataFrame, cols: Sequence[str], keep: Sequence[str], all_pairs: bool = False) -> DataFrame:
    """One row per (row, column pair): ``pair, <keep>, x, y``.

    Consecutive pairs (an even number of columns) or all i < j.  The number of
    pairs depends on the columns only; the pairs are unpivoted inside the row.
    """
    cols = list(cols)
    if all_pairs:
        pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    else:
        if len(cols) % 2:
            raise ValueError("an even number of columns is needed")
        pairs = list(zip(cols[::2], cols[1::2]))
    cells = F.explode(F.array(*[F.struct(
        F.lit(f"{a}-{b}").alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs]))
    return df.select(*keep, cells.alias("_c")).select("_c.pair", *keep, "_c.x", "_c.y")


# ---- group summaries -----------------------------------------------------------------


def group_summary(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count("*").alias("n"), *[f for c, n in ((x, "x"), (y, "y")) for f in (
            F.avg(c).alias(f"mean_{n}"), F.stddev_samp(c).alias(f"sd_{n}"),
            F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}"))])


def cluster_centres(df: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """Mean position and size per cluster; cluster ``0`` is noise."""
    return df.filter(F.col(cluster).cast("string") != "0").groupBy(cluster).agg(
        F.avg(x).alias("x"), F.avg(y).alias("y"), F.count("*").alias("n"))


def group_sizes(df: DataFrame, group: str, levels: DataFrame) -> DataFrame:
    """Rows per level of ``levels`` (one column); a missing level counts 0."""
    name = levels.columns[0]
    return levels.join(df.groupBy(F.col(group).alias(name)).agg(F.count("*").alias("n")), name, "left").select(
        name, F.coalesce("n", F.lit(0)).alias("n"))


def covariance(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.var_samp(x).alias("sxx"), F.covar_samp(x, y).alias("sxy"), F.var_samp(y).alias("syy"),
        F.corr(x, y).alias("r"))


def box_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``lower, q1, median, q3, upper, n_out``: whiskers end at the last point
    within 1.5 box lengths."""
    keys = list(keys)
    q = quantiles(df, keys, value, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(lo, hi)
    return df.join(small_side(q), keys).groupBy(*keys).agg(
        F.min(F.when(inside, F.col(value))).alias("lower"), F.first("q1").alias("q1"),
        F.first("median").alias("median"), F.first("q3").alias("q3"),
        F.max(F.when(inside, F.col(value))).alias("upper"), F.count_if(~inside).alias("n_out"))


def job_summary(jobs: DataFrame) -> DataFrame:
    """Totals of a job log ``input, status, seconds, width, height``."""
    return jobs.agg(
        F.count_distinct("input").alias("n_files"), F.count("*").alias("n_outputs"),
        F.count_if(F.col("status") == "success").alias("n_ok"),
        F.count_if(F.col("status") != "success").alias("n_failed"),
        F.avg("seconds").alias("mean_seconds"), F.sum("seconds").alias("total_seconds"),
        F.avg("width").alias("mean_width"), F.avg("height").alias("mean_height"))


# ---- sorts, limits ---------------------------------------------------------------------


def paginate(df: DataFrame, order: str, per_page: int) -> DataFrame:
    """Adds ``page`` by position in the order of the unique column."""
    return row_index(df, order, "_i").withColumn(
        "page", F.ceil(F.col("_i") / per_page).cast("bigint")).drop("_i")


def head(df: DataFrame, order: Sequence, n: int = 10) -> DataFrame:
    return df.orderBy(*order).limit(n)


def axis_extremes(df: DataFrame, id_col: str, x: str, y: str) -> DataFrame:
    """Distinct ids at the ends of both axes; the lowest id wins a tie."""
    def at(c, sign):
        return F.min_by(id_col, F.struct((F.col(c) * sign).alias("v"), F.col(id_col).alias("i")))
    return df.agg(F.array_distinct(F.array(at(x, 1), at(x, -1), at(y, 1), at(y, -1))).alias("ids")).select(
        F.explode("ids").alias(id_col))


def fraction_schedule(n_total: DataFrame, fractions: Sequence[float]) -> DataFrame:
    """``fraction, realized_n``: the lowest fraction of every realised size.

    ``n_total`` is a one-row, one-column table.
    """
    n = F.col(n_total.columns[0])
    rows = n_total.select(n, F.explode(F.array(*[F.lit(float(f)) for f in sorted(set(fractions))])).alias("fraction"))
    size = F.least(F.greatest(F.lit(2).cast("bigint"), F.floor(F.col("fraction") * n)), n).cast("bigint")
    return rows.select("fraction", size.alias("realized_n")).groupBy("realized_n").agg(
        F.min("fraction").alias("fraction")).select("fraction", "realized_n")


def first_converged(summary: DataFrame, thresholds: Sequence[float] = (0.95, 0.90, 0.80), sd_threshold: float = 0.05,
                    angle_threshold: float = 5.0, angle_sd_threshold: float | None = None) -> DataFrame:
    """Per metric (and similarity threshold) the lowest fraction that is good enough."""
    angle = F.col("metric_type").endswith("_deg")
    cuts = sorted({float(t) for t in thresholds}, reverse=True)
    ask = F.when(angle, F.array(F.lit(None).cast("double"))).otherwise(F.array(*[F.lit(t) for t in cuts]))
    rows = summary.withColumn("similarity_threshold", F.explode(ask))
    ok_angle = F.col("mean") <= angle_threshold
    if angle_sd_threshold is not None:
        ok_angle = ok_angle & (F.col("sd") <= angle_sd_threshold)
    ok = F.when(angle, ok_angle).otherwise(
        (F.col("mean") >= F.col("similarity_threshold")) & (F.col("sd") <= sd_threshold))
    return rows.groupBy("metric_type", "similarity_threshold").agg(
        F.min(F.when(ok, F.col("fraction"))).alias("recommended_fraction"),
        F.min_by("realized_n", F.when(ok, F.col("fraction"))).alias("recommended_sample_size")).withColumn(
        "metric_family", F.when(angle, "angle").otherwise("similarity")).withColumn(
        "converged", F.col("recommended_fraction").isNotNull())


def outward_shifts(df: DataFrame, x: str, y: str, shift: float, dx: float = 0.0, dy: float = 0.0,
                   auto: bool = True) -> DataFrame:
    """``shift_x, shift_y``: away from the mean by shift x range x 0.1.

    The range is the largest coordinate span.  Without ``auto`` only the
    offsets are given.
    """
    if not auto:
        return df.withColumn("shift_x", F.lit(float(dx))).withColumn("shift_y", F.lit(float(dy)))
    s = df.agg(F.struct(
        F.avg(x).alias("mx"), F.avg(y).alias("my"),
        (F.greatest(F.max(x), F.max(y)) - F.least(F.min(x), F.min(y))).alias("span")).alias("s")).scalar()
    u, v = F.col(x) - F.col("_s.mx"), F.col(y) - F.col("_s.my")
    m = F.hypot(u, v)
    m = F.when(m == 0, F.lit(1.0)).otherwise(m)
    by = F.col("_s.span") * (shift * 0.1)
    return df.withColumn("_s", s).withColumn("shift_x", u / m * by + dx).withColumn(
        "shift_y", v / m * by + dy).drop("_s")


# ---- sets -----------------------------------------------------------------------------


def bin_of(v: str, lo: str, hi: str, resolution: int) -> Column:
    """Right-closed bin 1..resolution, the lowest value in the first."""
    w = (F.col(hi) - F.col(lo)) / resolution
    return F.greatest(F.least(F.ceil((F.col(v) - F.col(lo)) / w), F.lit(resolution)), F.lit(1))


def cell_iou(a: DataFrame, b: DataFrame, keys: Sequence[str], resolution: int = 60) -> DataFrame:
    """``keys, iou`` of the grid cells two ``x, y`` sets occupy.

    Common bounds per key; bins are right-closed with the lowest value in the
    first.  Cells are de-duplicated before they meet.
    """
    keys = list(keys)
    both = a.select(*keys, "x", "y", F.lit(1).alias("_w")).unionByName(
        b.select(*keys, "x", "y", F.lit(2).alias("_w")))
    bounds = small_side(both.groupBy(*keys).agg(
        F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.min("y").alias("_y0"), F.max("y").alias("_y1")))

    ok = (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0"))
    placed = both.join(bounds.filter(ok), keys).select(
        *keys, bin_of("x", "_x0", "_x1", resolution).alias("_i"), bin_of("y", "_y0", "_y1", resolution).alias("_j"), "_w")
    cells = placed.groupBy(*keys, "_i", "_j").agg(
        F.bool_or(F.col("_w") == 1).alias("_a"), F.bool_or(F.col("_w") == 2).alias("_b"))
    found = cells.groupBy(*keys).agg((F.count_if(F.col("_a") & F.col("_b")) / F.count("*")).alias("iou"))
    return bounds.select(*keys).join(found, keys, "left")
