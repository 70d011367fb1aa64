"""Flagship plan: liquid universe, trailing return buckets, forward return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, compounded
from tessera.functions.ranking import ntile_of
from tessera.operators import labels, universe
from tessera.plans import views


def liquidity_momentum(
    spark: SparkSession, sf: str, buckets: int = 10, top_k: int = 100, liquidity: int = 3, momentum: int = 3
) -> DataFrame:
    """Mean forward 5-session excess return by trailing-return bucket of the ``top_k`` liquid assets.

    All asset windows share one exchange on (country, asset); the cross-section
    is cut to ``top_k`` before it is shuffled by date.  Trailing returns that differ by
    less than rounding tie, and ties lie in order of the asset.
    """
    p = views.panel(spark, sf, "user", rf=True)
    p = p.withColumn("momentum", compounded("ret", momentum, by_asset()))
    p = labels.forward_excess(p)
    picked = universe.liquid_universe(p, liquidity, top_k).where(
        F.col("momentum").isNotNull() & F.col("target").isNotNull())
    keys = ["country", "date"]
    # a date holds at most top_k names, so plain windows do
    ranked = picked.select("*", F.count(F.lit(1)).over(W.partitionBy(*keys)).alias("n"),
                           F.row_number().over(W.partitionBy(*keys).orderBy(F.round("momentum", 9), "asset")).alias("pos"))
    ranked = ranked.where(F.col("n") >= buckets).withColumn("bucket", ntile_of("pos", "n", buckets))
    return ranked.groupBy("bucket").agg(
        F.count_distinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"),
        F.avg("momentum").alias("mean_momentum"), F.avg("target").alias("mean_target_bps"))
