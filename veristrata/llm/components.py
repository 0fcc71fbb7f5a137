"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veristrata.llm.common import stage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (node, label), label being the smallest node of its component.

    Nodes without edges don't appear. Each step aggregates before it shuffles and is written
    to the shared folder; a hub's edges are joined by key, which adaptive execution splits.
    """
    at = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = _print(at)
    while mark[0]:
        both = at.union(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        at = stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _print(at)
        if new == mark:
            break
        mark = new
    return at.select(F.col("u").alias("node"), F.col("v").alias("label")).union(at.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
