"""Connected components by alternating star contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its smallest node.

    Each round hangs larger neighbours, then smaller ones, below the smallest
    neighbour.  Edges stay at most as many as given, rounds grow with the logarithm
    of the longest path, and every round is a written table.  A hub's edges are
    combined before each exchange or split by the join, never gathered.
    """
    links = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = None
    while True:
        now = links.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        hung = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        hung = materialise(hung)
        low = hung.groupBy("u").agg(F.min("v").alias("low"))
        rest = hung.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
        links = materialise(low.select("u", F.col("low").alias("v")).unionByName(rest).distinct())
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
