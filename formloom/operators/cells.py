"""Questions to points around a position, answered from cells that split where they are crowded.

A cell keeps its number of points, the smallest id and the extremes of both axes. A question takes whole cells by their
extremes: all of them hit, or none does. Only where a cell lies on the edge of the question are its points
looked at, and a cell of many points is split into ``SPLIT`` x ``SPLIT`` smaller ones first, so no key holds more than ``CROWD`` rows.
Points of one place never need splitting: their extremes are the point.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut

CROWD, SPLIT = 64, 8


def answers(points: DataFrame, asked: DataFrame, side: float, all_hit: Callable[..., Column], none_hits: Callable[..., Column],
            keys: Sequence[str] = (), crowd: int = CROWD) -> DataFrame:
    """``asked`` columns (without its cells) and ``found``, the smallest id that a question hits; questions without a hit are left out.

    ``points``: keys, ``found, _x, _y, _i, _j`` with cells of ``side``; ``asked``: keys, ``x, y``, other columns and a row for each cell
    ``_i, _j`` that a hit can lie in. ``all_hit`` and ``none_hits`` tell from the extremes ``(x0, x1, y0, y1)`` of some points whether
    the question at x, y hits all or none of them; of a single point one of the two must hold.
    """
    keys = list(keys)
    ends = [F.col(c) for c in ("_x0", "_x1", "_y0", "_y1")]
    own = [c for c in asked.columns if c not in ("_i", "_j")]
    at = [*keys, "_up", "_vp", "_i", "_j"]
    rest, ask = cut(points.withColumn("_up", F.lit(0).cast("long")).withColumn("_vp", F.lit(0).cast("long"))), asked
    hits, first = None, True
    while True:
        nodes = cut(rest.groupBy(*at).agg(F.count("*").alias("_n"), F.min("found").alias("_f"), F.min("_x").alias("_x0"), F.max("_x").alias("_x1"),
                                          F.min("_y").alias("_y0"), F.max("_y").alias("_y1")))
        near = ask.join(nodes, [*keys, "_i", "_j"] if first else [*keys, "_up", "_vp"])
        near = cut(near.withColumn("_all", all_hit(*ends)).withColumn("_none", none_hits(*ends)).filter(F.col("_all") | ~F.col("_none")))
        edge = near.filter(~F.col("_all"))
        one = F.col("_x"), F.col("_x"), F.col("_y"), F.col("_y")
        looked = edge.filter(F.col("_n") <= crowd).select(*own, *[c for c in at if c not in own]).join(rest.drop(*[c for c in own if c not in at]), at).filter(all_hit(*one))
        found = near.filter("_all").select(*own, F.col("_f").alias("found")).unionByName(looked.select(*own, "found"))
        hits = found if hits is None else hits.unionByName(found)
        deep = edge.filter(F.col("_n") > crowd)
        if not deep.limit(1).count():
            return hits.groupBy(*own).agg(F.min("found").alias("found"))
        # one level down, in the cells that some question lies on the edge of
        side, first = side / SPLIT, False
        split = cut(deep.select(*at).distinct().withColumn("_k", F.xxhash64(*at)))
        fresh = rest.join(split, at).drop("_up", "_vp").withColumnsRenamed({"_i": "_u", "_j": "_v"})
        rest = cut(fresh.withColumn("_up", F.col("_k")).withColumn("_vp", F.xxhash64("_u", "_v")).drop("_k", "_u", "_v")
                   .withColumn("_i", F.floor(F.col("_x") / side)).withColumn("_j", F.floor(F.col("_y") / side)))
        ask = deep.select(*own, F.xxhash64(*at).alias("_up"), F.xxhash64("_i", "_j").alias("_vp"))
