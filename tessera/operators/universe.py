"""Point-in-time universes: lagged snapshots, size ranks and top-k selection.

``row_number() <= k`` filters are pruned before the shuffle by Spark's window
group limit, so selecting k from a very large cross-section moves k rows per
task.  Full ranks use the distributed ordinal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import attach_stats, by_asset, col, full_frame
from tessera.functions.ranking import ordinal


def month_of(date: str | Column) -> Column:
    return F.trunc(col(date), "MM").cast("date")


def usable_month(snapshot: str | Column) -> Column:
    """Month in which a snapshot may first be used: the one after it was taken."""
    return F.add_months(month_of(snapshot), 1)


def lag_snapshots(caps: DataFrame) -> DataFrame:
    return caps.withColumn("universe_month", usable_month("snapshot_date"))


def dedupe_snapshots(lagged: DataFrame, keep: str) -> DataFrame:
    """One snapshot per asset and month: ``largest`` known size or ``latest`` date."""
    keys = ["country", "universe_month", "asset"]
    size = F.coalesce("market_cap", F.lit(float("-inf")))
    order = F.struct(size, "snapshot_date") if keep == "largest" else F.struct(F.col("snapshot_date"), size)
    best = F.max(F.struct(order.alias("o"), "market_cap", "snapshot_date")).alias("b")
    return lagged.groupBy(*keys).agg(best).select(*keys, "b.market_cap", "b.snapshot_date")


def size_rank(universe: DataFrame, **kw) -> DataFrame:
    """Descending size rank per (country, month); unknown sizes last, ties by asset."""
    size = -F.coalesce("market_cap", F.lit(float("-inf")))
    return ordinal(universe, ["country", "universe_month"], [size, "asset"], "market_cap_rank", **kw)


def largest(universe: DataFrame, n: int) -> DataFrame:
    """The rows of ``size_rank`` up to rank ``n``; only ``n`` rows per group and task are moved."""
    size = -F.coalesce("market_cap", F.lit(float("-inf")))
    return top_k(universe, ["country", "universe_month"], [size.asc(), F.asc("asset")], n, "market_cap_rank")


def flags(ranked: DataFrame, top_n: int) -> DataFrame:
    eligible = F.coalesce(F.col("market_cap") > 0, F.lit(False))
    return ranked.withColumn("eligible", eligible).withColumn(
        "selected", eligible & (F.col("market_cap_rank") <= top_n))


def build(caps: DataFrame, keep: str, top_n: int, pool: int | None = None) -> DataFrame:
    """Ranked snapshots with their flags, of the first ``pool`` ranks if given."""
    known = dedupe_snapshots(lag_snapshots(caps), keep)
    return flags(size_rank(known) if pool is None else largest(known, pool), top_n)


def point_in_time(panel: DataFrame, universe: DataFrame) -> DataFrame:
    """Members of the month only, with their lagged size and rank."""
    u = universe.where("eligible").select("country", "universe_month", "asset", "market_cap", "market_cap_rank")
    return panel.withColumn("universe_month", month_of("date")).join(u, ["country", "universe_month", "asset"])


def trailing_liquidity(panel: DataFrame, n: int, value: str = "dollar_volume") -> DataFrame:
    """Median traded value over the last ``n`` rows of the asset (full frames only)."""
    med = full_frame(lambda x: F.percentile(x, F.lit(0.5)), value, n, by_asset())
    return panel.withColumn("liquidity", med)


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "pick") -> DataFrame:
    """First ``k`` rows per group in a total order."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)


def liquid_universe(panel: DataFrame, n: int, k: int, keys=("country", "date")) -> DataFrame:
    liquid = trailing_liquidity(panel, n).where(F.col("liquidity").isNotNull())
    return top_k(liquid, list(keys), [F.desc("liquidity"), F.asc("asset")], k, "liquidity_rank")


def available_top_n(members: DataFrame, complete: Column, pool: int | None, n: int) -> DataFrame:
    """Best ``n`` by size with complete features, among the first ``pool`` ranks if given."""
    ok = members.where(complete if pool is None else (F.col("market_cap_rank") <= pool) & complete)
    return top_k(ok, ["country", "date"], [F.asc("market_cap_rank"), F.asc("asset")], n)


def cross_section_size(df: DataFrame, out: str = "n_assets") -> DataFrame:
    return attach_stats(df, ["country", "date"], F.count(F.lit(1)).alias(out))


def full_dates(df: DataFrame, n: int) -> DataFrame:
    """Rows of dates that hold exactly ``n`` assets."""
    return cross_section_size(df).where(F.col("n_assets") == n)


def pure_top_n(members: DataFrame, complete: Column, n: int) -> dict[str, DataFrame]:
    """Top ``n`` without replacement: all, feature-complete, and full complete dates."""
    all_rows = members.where(F.col("market_cap_rank") <= n).withColumn("complete", complete)
    ready = all_rows.where("complete")
    return {"all": all_rows, "complete": ready, "full": full_dates(ready, n)}


def presence(snapshots: DataFrame, name: str) -> DataFrame:
    """First and last snapshot, months observed and last known attribute per asset."""
    when = F.struct("snapshot_date", name)
    return snapshots.groupBy("country", "asset").agg(
        F.min("snapshot_date").alias("first_snapshot"), F.max("snapshot_date").alias("last_snapshot"),
        F.count_distinct(month_of("snapshot_date")).alias("months_observed"),
        F.max_by(name, when).alias("last_" + name))


def churn(members: DataFrame, dates: DataFrame) -> DataFrame:
    """Continuing, entered and exited names between consecutive cross-sections.

    ``dates`` is the small list of (country, date) cross-sections in order.
    """
    w = W.partitionBy("country").orderBy("date")
    d = F.broadcast(dates.select("country", "date", F.row_number().over(w).alias("step")))
    m = members.select("country", "asset", "date").join(d, ["country", "date"]).select("country", "asset", "step")
    now = m.withColumn("now", F.lit(1))
    before = m.select("country", "asset", (F.col("step") + 1).alias("step"), F.lit(1).alias("before"))
    both = now.join(before, ["country", "asset", "step"], "full")
    counts = both.groupBy("country", "step").agg(
        F.count_if(F.col("now").isNotNull() & F.col("before").isNotNull()).alias("continuing"),
        F.count_if(F.col("before").isNull()).alias("entered"),
        F.count_if(F.col("now").isNull()).alias("exited"))
    return counts.join(d, ["country", "step"]).drop("step")
