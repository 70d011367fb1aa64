"""Quantiles of everything seen before each of a list of cut sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def expanding_quantile(
    rows: DataFrame, origins: DataFrame, key: str, order: str, value: str, share: float, width: float
) -> DataFrame:
    """Exact quantile of ``value`` over rows with ``order`` strictly below each origin.

    A row is counted once under the first origin that sees it.  Counts per value
    band of ``width``, cumulated over origins, locate the band that holds the
    quantile; only rows of those bands are then expanded to the origins that need
    them.  Rows times origins is never formed.

    ``origins``: (key, order), bounded by the calendar.  Returns (key, order, q).
    """
    o = origins.select(key, F.col(order).alias("_at")).distinct()
    o = o.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy("_at")))
    cuts = F.broadcast(o.groupBy(key).agg(F.sort_array(F.collect_list("_at")).alias("_cuts")))
    seen = F.size(F.filter("_cuts", lambda c: c <= F.col(order))) + 1
    known = rows.where(F.col(value).isNotNull())
    # distinct sessions are bounded by the calendar: place those, not every row
    place = known.select(key, order).distinct().join(cuts, key).select(
        key, order, seen.alias("_k"), F.size("_cuts").alias("_last")).where(F.col("_k") <= F.col("_last"))
    base = (
        known.join(F.broadcast(place), [key, order])
        .select(key, F.col(value).alias("_v"), "_k", "_last")
        .withColumn("_b", F.floor(F.col("_v") / width))
        .groupBy(key, "_b", "_v", "_k", "_last").agg(F.count(F.lit(1)).alias("_c"))
    )
    band = base.groupBy(key, "_b", "_k", "_last").agg(F.sum("_c").alias("_c"))
    grid = band.groupBy(key, "_b", "_last").agg(F.min("_k").alias("_k0")).select(
        key, "_b", F.explode(F.sequence("_k0", "_last")).alias("_k"))
    grow = W.partitionBy(key, "_b").orderBy("_k").rowsBetween(W.unboundedPreceding, 0)
    cum = grid.join(band.drop("_last"), [key, "_b", "_k"], "left").select(
        key, "_b", "_k", F.sum(F.coalesce("_c", F.lit(0))).over(grow).alias("_n"))
    across = W.partitionBy(key, "_k")
    upto = across.orderBy("_b").rowsBetween(W.unboundedPreceding, 0)
    spot = cum.select(key, "_b", "_k", "_n", F.sum("_n").over(upto).alias("_cum"), F.sum("_n").over(across).alias("_tot"))
    pos = (F.col("_tot") - 1) * F.lit(float(share))
    lo, hi, first = F.floor(pos), F.ceil(pos), F.col("_cum") - F.col("_n")
    hit = ((first <= lo) & (lo < F.col("_cum"))) | ((first <= hi) & (hi < F.col("_cum")))
    need = spot.where(hit).select(key, "_b", "_k", first.alias("_first"), pos.alias("_pos"))
    values = base.select(key, "_b", "_v", F.col("_k").alias("_from"), "_c")
    near = need.join(values, [key, "_b"]).where(F.col("_from") <= F.col("_k")).groupBy(
        key, "_k", "_b", "_first", "_pos", "_v").agg(F.sum("_c").alias("_c"))
    inside = W.partitionBy(key, "_k", "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    end = F.col("_first") + F.sum("_c").over(inside)
    near = near.select(key, "_k", "_pos", "_v", (end - F.col("_c")).alias("_s"), end.alias("_e"))
    at = lambda p: F.max(F.when((F.col("_s") <= p) & (p < F.col("_e")), F.col("_v")))
    low, high = at(F.floor("_pos")), at(F.ceil("_pos"))
    q = near.groupBy(key, "_k").agg((low + (high - low) * F.max(F.col("_pos") - F.floor("_pos"))).alias("q"))
    return o.join(q, [key, "_k"], "left").select(key, F.col("_at").alias(order), "q")
