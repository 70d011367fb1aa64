"""Performance statistics of return series.

A series has one row per (book, session): its length is bounded by the calendar,
so ordered windows per book are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import full_frame, safe_div

# Periods per year.
DAILY, WEEKLY = 252, 52


def wealth(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Running growth and drawdown; the peak starts at the first period's wealth."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    d = df.where(F.col(value).isNotNull()).withColumn("wealth", F.product(1 + F.col(value)).over(w))
    return d.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(w) - 1)


def _annual(value: str, periods: int) -> tuple[Column, Column]:
    mean = F.avg(value) * periods
    sd = F.when(F.count(value) > 1, F.stddev_samp(value)) * F.sqrt(F.lit(float(periods)))
    return mean, sd


def sharpe(value: str, periods: int) -> Column:
    mean, sd = _annual(value, periods)
    return F.when(sd > 0, safe_div(mean, sd))


def summary(df: DataFrame, keys: list[str], value: str, periods: int) -> DataFrame:
    mean, sd = _annual(value, periods)
    return df.groupBy(*keys).agg(
        F.count(value).alias("n_periods"), mean.alias("annual_return"), sd.alias("annual_volatility"),
        sharpe(value, periods).alias("sharpe"))


def max_drawdown(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return wealth(df, keys, order, value).groupBy(*keys).agg(F.min("drawdown").alias("max_drawdown"))


def turnover_stats(daily: DataFrame, trades: DataFrame, keys: list[str], periods: int = DAILY) -> DataFrame:
    """Turnover per rebalance and year, cumulative cost drag, return per unit of turnover."""
    d = daily.groupBy(*keys).agg(
        F.count("net_return").alias("n"), (F.sum("gross_return") - F.sum("net_return")).alias("cost_drag"),
        (F.avg("net_return") * periods).alias("annual_return"))
    t = trades.groupBy(*keys).agg(F.avg("turnover").alias("mean_turnover"), F.sum("turnover").alias("_t"))
    yearly = F.col("_t") / (F.col("n") / periods)
    return d.join(t, keys).select(
        *keys, "mean_turnover", yearly.alias("annual_turnover"), "cost_drag",
        F.when(yearly > 0, F.col("annual_return") / yearly).alias("return_per_turnover"))


def reliability(daily: DataFrame, trades: DataFrame, risk: DataFrame, keys: list[str]) -> DataFrame:
    """Coverage, universe size, fallback rate and missing valuations per held asset-day.

    Coverage counts the sessions that had a return (``evaluated`` of the daily ledger).
    ``risk``: (country, signal_date, valid_assets, fallback).
    """
    d = daily.groupBy(*keys).agg(
        (F.count_if("evaluated") / F.count(F.lit(1))).alias("coverage"), F.sum("positions").alias("held_asset_days"),
        F.sum("missing_valuations").alias("missing_events"))
    t = trades.join(risk, ["country", "signal_date"], "left").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rebalances"), F.avg("positions").alias("mean_assets"),
        F.avg("valid_assets").alias("mean_valid_risk_assets"),
        F.avg(F.coalesce(F.col("fallback"), F.lit(False)).cast("double")).alias("fallback_rate"))
    return d.join(t, keys).withColumn("missing_rate", safe_div("missing_events", "held_asset_days"))


def economics(df: DataFrame, keys: list[str], order: str, value: str, periods: int = WEEKLY) -> DataFrame:
    """Geometric return, Sortino, drawdown, Calmar, CVaR 5%, hit rate, best and worst."""
    r = F.col(value)
    s = df.where(r.isNotNull())
    w = W.partitionBy(*keys)
    s = s.withColumn("_q", F.percentile(r, F.lit(0.05)).over(w))
    down = F.when(r < 0, r)
    down_sd = F.when(F.count(down) > 1, F.stddev_samp(down))
    growth = F.when(F.min(1 + r) > 0, F.exp(F.sum(F.when(1 + r > 0, F.ln(F.when(1 + r > 0, 1 + r)))) * periods / F.count(r)) - 1)
    base = s.groupBy(*keys).agg(
        F.count(r).alias("n_periods"), growth.alias("geometric_return"),
        F.when(down_sd > 0, F.avg(r) * periods / (down_sd * F.sqrt(F.lit(float(periods))))).alias("sortino"),
        F.avg(F.when(r <= F.col("_q"), r)).alias("cvar_5"),
        F.avg(F.when(r > 0, 1.0).otherwise(0.0)).alias("hit_rate"), F.max(r).alias("best"), F.min(r).alias("worst"))
    return base.join(max_drawdown(df, keys, order, value), keys).withColumn(
        "calmar", F.when(F.col("max_drawdown") < 0, F.col("geometric_return") / F.abs("max_drawdown")))


def rolling_sharpe(df: DataFrame, keys: list[str], order: str, value: str, n: int = 26, periods: int = WEEKLY) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(order)
    sd = full_frame(F.stddev_samp, value, n, w)
    one = F.when(sd > 0, full_frame(F.avg, value, n, w) / sd * F.sqrt(F.lit(float(periods))))
    return df.where(F.col(value).isNotNull()).select(*keys, order, one.alias("rolling_sharpe"))


def by_period(df: DataFrame, key: str, date: str, value: str, periods: int) -> DataFrame:
    """Whole-period and per-year rows from one pass with grouping sets."""
    mean, sd = _annual(value, periods)
    y = df.withColumn("year", F.year(date))
    return (
        y.groupingSets([[F.col(key)], [F.col(key), F.col("year")]], key, "year")
        .agg(F.count(value).alias("n_periods"), mean.alias("annual_return"), sd.alias("annual_volatility"))
        .withColumn("period", F.coalesce(F.col("year").cast("string"), F.lit("all")))
        .drop("year")
    )


def incremental(daily: DataFrame, trades: DataFrame, base: str, keys: list[str], periods: int = DAILY) -> DataFrame:
    """Each strategy against the base one on shared dates: delta Sharpe, return and turnover."""
    mine = daily.where(F.col("strategy") != base).select("strategy", *keys, "date", F.col("net_return").alias("a"))
    other = daily.where(F.col("strategy") == base).select(*keys, "date", F.col("net_return").alias("b"))
    d = mine.join(other, [*keys, "date"]).groupBy("strategy", *keys).agg(
        (sharpe("a", periods) - sharpe("b", periods)).alias("delta_sharpe"),
        F.avg(F.col("a") - F.col("b")).alias("mean_delta_return"))
    t = trades.groupBy("strategy", *keys).agg(F.avg("turnover").alias("t"))
    tb = t.where(F.col("strategy") == base).select(*keys, F.col("t").alias("tb"))
    return d.join(t, ["strategy", *keys]).join(tb, keys).withColumn("delta_turnover", F.col("t") - F.col("tb")).drop("t", "tb")


def turnover_reduction(trades: DataFrame, keys: list[str]) -> DataFrame:
    """One minus the ratio of mean turnovers for every two strategies of a group; strategies are few."""
    t = trades.groupBy("strategy", *keys).agg(F.avg("turnover").alias("t"))
    right = t.select(*keys, F.col("strategy").alias("right_"), F.col("t").alias("tb"))
    return t.withColumnRenamed("strategy", "left_").join(right, keys).where("left_ < right_").select(
        "left_", "right_", *keys, (1 - safe_div("t", "tb")).alias("turnover_reduction"))


def strategy_pairs(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Returns ``a`` and ``b`` of every two strategies of a group on shared dates."""
    right = daily.select(*keys, "date", F.col("strategy").alias("right_"), F.col("net_return").alias("b"))
    return daily.select(*keys, "date", F.col("strategy").alias("left_"), F.col("net_return").alias("a")).join(
        right, [*keys, "date"]).where("left_ < right_")
