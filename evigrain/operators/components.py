"""Connected components of an undirected graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evigrain.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node of ``edges(u, v)``; the root is the smallest node of its component.

    Each round links every node to the smallest one near it and keeps what was connected connected; the rounds end
    when only stars are left, after a number that grows with the logarithm of the longest chain. Lineage is cut in
    every round.
    """
    e = materialise(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = materialise(small.select("x.u", "x.v").where("u != v").distinct(), "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _stars(e: DataFrame) -> bool:
    """No node has two smaller neighbours, and no root has one."""
    seen = e.groupBy("u").count()
    return seen.where("count > 1").isEmpty() and e.join(seen.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
