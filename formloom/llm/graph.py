"""Connected components by alternating star steps over a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formloom.session import cut, discard


def components(edges: DataFrame) -> DataFrame:
    """(id, root) of every node of ``edges`` (a, b): root is the smallest node that it reaches.

    A large step hangs the larger neighbours of each node on its smallest one, a small step the smaller ones, until every
    node hangs on its root; the number of rounds grows with the logarithm of the longest path. Only minima by node
    are shuffled, with map-side folding, so a node may have any number of neighbours. Each round
    is written to the shared folder, where only the last one stays. Edges with a null end or equal ends are left out.
    """
    e = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionAll(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least("x", F.min("y")).alias("m"))
        large = both.join(least, "x").where(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        discard(last)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(
        e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
