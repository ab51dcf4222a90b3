"""Bootstrap draws and the saturation of score ranges with sample size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..functions.base import div
from ..session import cut
from ..sources.text import pc_columns
from .ranks import quantiles, row_index


def boot_size(n: Column, size: float | None) -> Column:
    """Draws per bootstrap: all, a fraction (<= 1), or a count capped at n; at least 2."""
    if size is None:
        out = n
    elif size <= 1:
        out = F.floor(n * F.lit(float(size)))
    else:
        out = F.least(F.floor(F.lit(float(size))), n)
    out = out.cast("bigint")
    return F.when(out >= 2, out).otherwise(F.raise_error(F.lit("bootstrap sample has fewer than 2 rows")).cast("bigint"))


def bootstrap(spark: SparkSession, n: int, iterations: int, size: int, *seed) -> DataFrame:
    """``b, k, idx``: draws with replacement of row indices 1..n."""
    base = spark.range(iterations * size)
    b, k = F.floor(F.col("id") / size) + 1, F.col("id") % size + 1
    return base.select(b.alias("b"), k.alias("k")).select("b", "k", draws.index(n, *seed, F.col("b"), F.col("k")).alias("idx"))


def size_schedule(sizes: Sequence[float], n: int, min_size: int = 5) -> list[int]:
    """Absolute sizes: values up to 1 are shares (half-even rounding)."""
    out = {int(round(s * n)) if s <= 1 else int(s) for s in sizes}
    out = sorted(v for v in out if min_size <= v <= n)
    if not out:
        raise ValueError(f"no valid sample size between {min_size} and {n}")
    return out


ENDS = 256  # rows of each end of an axis to begin with


def axis_ends(indexed: DataFrame, pcs: Sequence[str], k: int) -> DataFrame:
    """The rows among the ``k`` largest or smallest of any axis: at most ``2 * len(pcs) * k``."""
    out = None
    for c in pcs:
        for order in (F.col(c).desc(), F.col(c).asc()):
            end = indexed.orderBy(order).limit(k)
            out = end if out is None else out.unionByName(end)
    return out.dropDuplicates(["idx"])


def saturation_runs(scores: DataFrame, sizes: Sequence[int], iterations: int, pcs: Sequence[str], seed: int,
                    id_col: str = "ID", ends: int = ENDS) -> DataFrame:
    """``sample_size, b, total_variance, cumulative_variance, pc1_variance``.

    A run's range follows from the first row at either end of an axis that it draws, so the draws only meet the ``ends`` outermost rows
    of every axis (a broadcast of known size) and the rows themselves are read once, however many draws there are. A run that drew
    none of an end's rows is not decided; the ends are then extended until every run is.
    """
    spark, pcs = scores.sparkSession, list(pcs)
    indexed = cut(row_index(scores.select(id_col, *pcs), id_col, "idx").drop(id_col))
    n = indexed.count()
    parts = [bootstrap(spark, n, iterations, s, seed, s).select(F.lit(s).alias("sample_size"), "b", "idx") for s in sizes]
    draw = parts[0]
    for p in parts[1:]:
        draw = draw.unionByName(p)
    asked = spark.createDataFrame([(int(s),) for s in sizes], "sample_size int").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).withColumn("b", F.col("b").cast("bigint"))
    while True:
        outer = cut(axis_ends(indexed, pcs, ends))
        if ends < n:  # the innermost value of each end: what lies beyond it is among the rows
            bound = outer.agg(*[F.element_at(F.sort_array(F.collect_list(c), f), ends).alias(f"{w}{i}")
                                for i, c in enumerate(pcs) for w, f in (("z", False), ("a", True))]).first()
        found = draw.join(F.broadcast(outer), "idx").groupBy("sample_size", "b").agg(
            *[f(c).alias(f"{w}{i}") for i, c in enumerate(pcs) for w, f in (("z", F.max), ("a", F.min))])
        runs = cut(asked.join(found, ["sample_size", "b"], "left"))
        if ends >= n:
            break
        decided = F.lit(True)
        for i in range(len(pcs)):
            decided = decided & (F.col(f"z{i}") >= bound[f"z{i}"]) & (F.col(f"a{i}") <= bound[f"a{i}"])
        if not runs.filter(~F.coalesce(decided, F.lit(False))).limit(1).count():
            break
        ends *= 4
    r = runs.select("sample_size", "b", *[(F.col(f"z{i}") - F.col(f"a{i}")).alias(c) for i, c in enumerate(pcs)])
    logs = sum((F.log(F.when(F.col(c) == 0, F.lit(1e-10)).otherwise(F.col(c))) for c in pcs), F.lit(0.0))
    return r.select("sample_size", "b", sum((F.col(c) for c in pcs), F.lit(0.0)).alias("total_variance"),
                    F.exp(logs / len(pcs)).alias("cumulative_variance"), F.col(pcs[0]).alias("pc1_variance"))


def saturation(scores: DataFrame, sizes: Sequence[float], iterations: int = 200, pcs_to_analyze: int | None = None,
               metrics: Sequence[str] = ("total_variance", "cumulative_variance"), min_size: int = 5, seed: int = 1,
               id_col: str = "ID") -> DataFrame:
    """Per size and metric: mean, median, sd, 2.5/97.5 % quantiles, share of rows."""
    clean = scores.dropna(subset=pc_columns(scores.columns))
    pcs = pc_columns(scores.columns)[:pcs_to_analyze]
    n = clean.count()
    runs = saturation_runs(clean, size_schedule(sizes, n, min_size), iterations, pcs, seed, id_col)
    long = runs.unpivot(["sample_size"], list(metrics), "metric_type", "value").filter(F.col("value").isNotNull())
    keys = ["sample_size", "metric_type"]
    q = quantiles(long, keys, "value", [0.025, 0.5, 0.975], ["q025", "median", "q975"],
                  [F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")])
    return q.select(
        *keys, "mean", "median", "sd", "q025", "q975", (F.col("sample_size") / n).alias("sample_proportion"))


def relative_saturation(saturated: DataFrame) -> DataFrame:
    """Adds ``pct``: percent of the metric's largest mean."""
    top = F.max("mean").over(Window.partitionBy("metric_type"))
    return saturated.withColumn("pct", div(F.col("mean"), top) * 100)
