"""Rolling, cross-sectional and market features.

Asset windows partition by (country, asset) and order by session: at most one
row per session, so the largest window partition is the length of the calendar.
All window columns of one call share a single exchange and sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import (
    all_present, attach_stats, by_asset, compounded, contiguous_diffs, full_frame, safe_div,
)
from tessera.functions.ranking import exact_quantiles
from tessera.operators.calendar import calendar_flags


def session_returns(grid: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """n-session simple returns on a densified grid: a gap at either end gives null."""
    w = by_asset()
    return grid.select("*", *[
        (safe_div("close", F.lag("close", n).over(w)) - 1).alias(f"return_{n}s") for n in horizons])


def grid_features(grid: DataFrame, n: int) -> DataFrame:
    """Moving-average style features on a densified grid with full ``n``-session frames."""
    w = by_asset()
    r = safe_div("close", F.lag("close").over(w)) - 1
    g = grid.withColumn("r1", r)
    illiq = F.when(F.col("volume") > 0, safe_div(F.abs("r1"), F.col("close") * F.col("volume")))
    g = g.withColumn("illiq", illiq)
    return g.select(
        "*",
        full_frame(F.stddev_pop, "r1", n, w).alias("vol"),
        (safe_div("close", full_frame(F.avg, "close", n, w)) - 1).alias("close_to_mean"),
        (safe_div("volume", full_frame(F.avg, "volume", n, w)) - 1).alias("volume_to_mean"),
        full_frame(F.avg, "illiq", n, w).alias("illiq_mean"),
        (F.sum(F.col("observed").cast("int")).over(w.rowsBetween(-n + 1, 0)) == n).alias("full_history"),
    )


def bar_shape(df: DataFrame) -> DataFrame:
    """Intraday range, open-to-close return and high/low proxy."""
    low = F.when(F.col("low") > 0, F.col("low"))
    return df.select(
        "*",
        safe_div(F.col("high") - F.col("low"), "close").alias("intraday_range"),
        (safe_div("close", "open") - 1).alias("open_to_close"),
        (safe_div("high", low) - 1).alias("high_low_proxy"),
    )


def log_levels(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.log1p("volume").alias("log_volume"),
        F.log1p("dollar_volume").alias("log_dollar_volume"),
        F.when(F.col("close") > 0, F.ln("close")).alias("log_price"),
    )


def illiquidity() -> Column:
    """Absolute return per unit of traded value, null when nothing traded."""
    return safe_div(F.abs("ret"), F.nullif(F.col("dollar_volume"), F.lit(0.0)))


def rolling_features(
    panel: DataFrame,
    returns: tuple[int, ...] = (5, 10, 20, 60),
    vols: tuple[int, ...] = (5, 20, 60),
    gated: int = 60,
) -> DataFrame:
    """Row-based rolling features; only the ``gated`` horizon is void across a gap."""
    w = by_asset()
    ok = contiguous_diffs(gated, w)

    def gate(n: int, c: Column) -> Column:
        return F.when(ok, c) if n == gated else c

    cols = [gate(n, compounded("ret", n, w)).alias(f"return_{n}") for n in returns]
    cols += [gate(n, full_frame(F.stddev_pop, "ret", n, w)).alias(f"vol_{n}") for n in vols]
    return panel.select("*", *cols, ok.alias(f"continuous_{gated}"))


def model_features(panel: DataFrame, returns=(5, 10, 20, 60), vols=(5, 20, 60), gated: int = 60) -> DataFrame:
    """The whole feature row: rolling, level, shape, illiquidity and calendar columns."""
    out = rolling_features(panel, returns, vols, gated)
    out = log_levels(bar_shape(out)).withColumn("amihud", illiquidity())
    return calendar_flags(out)


def risk_history(n: int) -> Column:
    return contiguous_diffs(n, by_asset())


def feature_complete(names: list[str]) -> Column:
    return all_present(names)


def market_stats(panel: DataFrame, medians: dict[str, str], **kw) -> DataFrame:
    """Cross-section per (country, date): mean, dispersion, breadth and medians.

    Breadth divides by every row; an unknown return is not an advance.  Medians
    of all measures come from one exact aggregate.
    """
    keys = ["country", "date"]
    base = panel.groupBy(*keys).agg(
        F.avg("ret").alias("market_return"),
        F.when(F.count("ret") > 1, F.stddev_samp("ret")).alias("dispersion"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("breadth"),
    )
    if not medians:
        return base
    wide = exact_quantiles(panel, keys, {out: (src, 0.5) for out, src in medians.items()}, **kw)
    return base.join(wide, keys, "left")


def market_windows(market: DataFrame, returns=(5, 20, 60), vols=(20, 60), long_mean: int = 200) -> DataFrame:
    """Index windows on the market series, one row per (country, session)."""
    w = W.partitionBy("country").orderBy("date")
    m = market.withColumn("index_level", F.product(1 + F.coalesce("market_return", F.lit(0.0))).over(
        w.rowsBetween(W.unboundedPreceding, 0)))
    cols = [compounded("market_return", n, w).alias(f"market_return_{n}") for n in returns]
    cols += [full_frame(F.stddev_pop, "market_return", n, w).alias(f"market_vol_{n}") for n in vols]
    distance = safe_div("index_level", full_frame(F.avg, "index_level", long_mean, w)) - 1
    return m.select("*", *cols, distance.alias("market_distance"))


def attach_market(panel: DataFrame, market: DataFrame) -> DataFrame:
    """Market row of the date on every asset; the market table is one row per session."""
    return panel.join(F.broadcast(market), ["country", "date"], "left")


def demean(df: DataFrame, value: str, out: str, keys: tuple[str, ...] = ("country", "date")) -> DataFrame:
    """Value less its cross-sectional mean."""
    return attach_stats(df, list(keys), F.avg(value).alias("_m")).withColumn(
        out, F.col(value) - F.col("_m")).drop("_m")
