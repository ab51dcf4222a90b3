"""Connected components of a table of edges, many graphs side by side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, node, root`` of the nodes of ``edges`` (keys, a, b): the smallest node reached inside the same graph.

    In turns every node hands its larger neighbours to its smallest one, then its smaller ones, until all hang on their root.  The number of
    turns grows with the logarithm of the longest path; what is shuffled are minima, folded on the map side.
    """
    keys = list(keys)
    hung = cut(edges.filter(F.col("a") != F.col("b")).select(*keys, F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(hung, keys)
    while state[0]:
        turned = hung.select(*keys, F.col("u").alias("v"), F.col("v").alias("u"))
        least = cut(hung.unionByName(turned).groupBy(*keys, F.col("u").alias("n")).agg(F.least("n", F.min("v")).alias("m")))
        ends = hung.select(*keys, F.col("v").alias("n"), F.col("u").alias("far")).unionByName(
            hung.select(*keys, F.col("u").alias("n"), F.col("v").alias("far")))
        up = cut(ends.join(least, [*keys, "n"]).filter(F.col("far") > F.col("n")).select(*keys, F.col("far").alias("u"), F.col("m").alias("v")).distinct())
        least = cut(up.groupBy(*keys, "u").agg(F.min("v").alias("m")))
        down = up.join(least, [*keys, "u"]).filter(F.col("v") != F.col("m")).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        hung = cut(down.unionByName(least.withColumnRenamed("m", "v")).distinct())
        before, state = state, _state(hung, keys)
        if state == before:
            break
    nodes = hung.select(*keys, F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(hung.select(*keys, F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(hung: DataFrame, keys: Sequence[str]) -> tuple:
    return tuple(hung.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))).first())
