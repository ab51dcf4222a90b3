"""Ranks, exact quantiles and draws without one task seeing a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side


ACCURACY = 20_000


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float],
              names: Sequence[str], extra: Sequence[Column] = (), accuracy: int = ACCURACY) -> DataFrame:
    """Exact interpolated (type 7) quantiles per group, plus ``extra`` aggregates.

    A bounded sketch brackets every wanted rank; only the rows inside a bracket
    are ranked (at most 6/accuracy of the group, or the whole group when it is
    small), after equal values are folded into counts.  Ranks below the bracket
    are counted exactly, so the sketch cannot change the result.  NULL and NaN
    are no values and count nowhere, also not in ``extra``.
    """
    keys, k = list(keys), len(probs)
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    off = 3.0 / accuracy
    edges = [max(p - off, 0.0) for p in probs] + [min(p + off, 1.0) for p in probs]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), F.percentile_approx(value, edges, accuracy).alias("_e"), *extra)
    # a small group is one bracket for all probabilities (i = -1)
    small = F.col("_n") <= 4 * accuracy

    def bracket(i, lo, hi):
        return F.struct(F.lit(i).alias("i"), lo.alias("lo"), hi.alias("hi"))
    inf = F.lit(float("inf"))
    parts = F.when(small, F.array(bracket(-1, -inf, inf))).otherwise(F.array(*[
        bracket(i, F.element_at("_e", i + 1), F.element_at("_e", k + i + 1)) for i in range(k)]))
    more = [c for c in sketch.columns if c not in (*keys, "_n", "_e")]
    known = small_side(sketch.select(*keys, *more, F.struct("_n", parts.alias("b")).alias("_b")))
    values = rows.select(*keys, F.col(value).alias("_v"))
    tagged = values.join(known.select(*keys, "_b"), keys) if keys else values.withColumn("_b", known.select("_b").scalar())
    # values below a bracket only count; the ones inside keep their value
    hits = tagged.select(*keys, "_v", F.col("_b._n").alias("_n"), F.explode("_b.b").alias("_q")).filter(
        F.col("_v") <= F.col("_q.hi"))
    below = F.col("_v") < F.col("_q.lo")
    folded = hits.groupBy(*keys, F.col("_q.i").alias("_i"), "_n",
                          F.when(below, -inf).otherwise(F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = folded.withColumn("_r", F.sum("_c").over(w))
    picks = []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(float(p))
        mine = F.col("_i").isin(i, -1)
        for n, r in (("_a", F.floor(h)), ("_z", F.ceil(h))):
            holds = mine & (F.col("_r") > r) & (F.col("_r") - F.col("_c") <= r)
            picks.append(F.max(F.when(holds, F.col("_v"))).alias(f"{n}{i}"))
    found = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *picks)

    def value_at(i):
        h = (F.col("_n") - 1) * F.lit(float(probs[i]))
        return (F.col(f"_a{i}") + (h - F.floor(h)) * (F.col(f"_z{i}") - F.col(f"_a{i}"))).alias(names[i])
    out = found.select(*keys, *[value_at(i) for i in range(k)])
    if not more:
        return out
    if keys:
        return out.join(known.select(*keys, *more), keys)
    return out.withColumn("_m", known.select(F.struct(*more)).scalar()).select(*names, *[f"_m.{c}" for c in more])


def row_index(df: DataFrame, key: str, out: str = "row_index", within: Sequence[str] = (),
              buckets: int | None = None) -> DataFrame:
    """Adds the 1-based position of every row in the order of the unique ``key``.

    With ``within`` positions count per group.  Split points come from a hash
    sample of fixed size, so every bucket is a bounded share of the rows, also
    of a hot group; only bucket counts are summed over the whole order.
    """
    spark, within = df.sparkSession, list(within)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = [r[0] for r in df.select(key).orderBy(F.xxhash64(key), key).limit(32 * buckets).collect()]
    sample.sort()
    cuts = sorted({sample[len(sample) * i // buckets] for i in range(1, buckets)}) if sample else []
    kind = df.schema[key].dataType
    bounds = F.array(*[F.lit(c).cast(kind) for c in cuts]) if cuts else None
    tagged = df.withColumn("_b", F.size(F.filter(bounds, lambda c: c <= F.col(key)))
                           if bounds is not None else F.lit(0))
    counts = tagged.groupBy(*within, "_b").agg(F.count("*").alias("_n"))
    # at most one row per bucket (and group)
    offsets = counts.withColumn("_o", F.sum("_n").over(
        Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_n")).drop("_n")
    pos = F.row_number().over(Window.partitionBy(*within, "_b").orderBy(key))
    placed = tagged.withColumn("_p", pos).join(offsets if within else F.broadcast(offsets), [*within, "_b"])
    return placed.withColumn(out, (F.col("_o") + F.col("_p")).cast("bigint")).drop("_b", "_o", "_p")


def hash_cutoffs(df: DataFrame, keys: Sequence[str], hexes: str, k: str) -> DataFrame:
    """``keys, cutoff``: the ``k``-th smallest hex string of every group, exactly.

    Rows with a hash up to the cutoff are a sample of size k without
    replacement.  Counts per 4-digit prefix (65536 at most) find the prefix of
    the k-th hash; only the rows of that one prefix are sorted.
    """
    keys = list(keys)
    rows = df.withColumn("_x", F.substring(hexes, 1, 4))
    counts = rows.groupBy(*keys, "_x").agg(F.count("*").alias("_c"), F.max(k).alias("_k"))
    w = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    edge = counts.withColumn("_r", F.sum("_c").over(w)).filter(
        (F.col("_r") >= F.col("_k")) & (F.col("_r") - F.col("_c") < F.col("_k"))).select(
        *keys, "_x", (F.col("_k") - F.col("_r") + F.col("_c")).alias("_need"))
    inside = rows.join(small_side(edge), [*keys, "_x"])
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(hexes))
    return inside.withColumn("_rn", rn).filter(F.col("_rn") == F.col("_need")).select(*keys, F.col(hexes).alias("cutoff"))
