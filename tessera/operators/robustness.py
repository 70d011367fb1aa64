"""A grid of portfolio configurations run through weights, rebalancing path and ledger side by side.

A variant is one row of a small table: ``k`` names, covariance ``kind`` and
``window``, largest weight, turnover cap and cost.  Variants are only a key column,
so one plan computes all of them: targets by risk scaling, a turnover-capped path in
which names without a complete window keep their weight, then the daily ledger.
Covariances come from the store of pair moments, once for the whole grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import fold, ledger, portfolio
from tessera.operators.universe import top_k

SCHEMA = "variant string, k int, cost_bps double, kind string, window int, turnover_cap double, max_weight double"


def table(spark: SparkSession, variants: list[dict]) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = {"double": float, "int": int, "string": str}
    cast = [types[c.split()[1]] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(t(v[n]) for n, t in zip(names, cast)) for v in variants], SCHEMA)


def targets(signals: DataFrame, assets: DataFrame, variances: DataFrame, grid: DataFrame, score: str) -> DataFrame:
    """Names of every variant's executions: targets of the ``k`` best valid ones, and frozen ones.

    ``signals``: (country, date, asset, execution_session, score); ``assets``: (country, date,
    window, asset, valid); ``variances``: (country, date, window, kind, asset, variance).
    """
    s = signals.join(assets.select("country", "date", "window", "asset", "valid"), ["country", "date", "asset"])
    s = s.join(variances, ["country", "date", "window", "asset"]).join(F.broadcast(grid), ["kind", "window"])
    keys = ["variant", "country", "date"]
    best = top_k(s.where("valid"), keys, [F.desc(score), F.asc("asset")], F.col("k"))
    chosen = portfolio.risk_scaled(best, score, "variance", F.col("max_weight"), keys).select(*keys, "asset", "target_weight")
    names = s.select(*keys, "asset", "execution_session", "cost_bps", "turnover_cap", (~F.col("valid")).alias("frozen"))
    names = names.join(chosen, [*keys, "asset"], "left").where("target_weight IS NOT NULL OR frozen")
    return names.withColumnsRenamed({"variant": "strategy", "date": "signal_date"})


def path(names: DataFrame, returns: DataFrame) -> DataFrame:
    """Weights of every execution along the turnover-capped path, with the cost rate of the variant.

    Every execution of the grid takes part, also one that holds nothing but frozen names.
    """
    per_book = names.select("strategy", "turnover_cap").distinct()
    moved = fold.names_between(names, names, returns).join(F.broadcast(per_book), "strategy")
    rows = fold.rebalance(moved.withColumn("scenario", F.lit("grid")))
    at = names.select("strategy", "country", "execution_session", "signal_date", "cost_bps").distinct()
    held = rows.where("target_weight > 0").select("strategy", "country", "execution_session", "asset", "target_weight")
    return held.join(F.broadcast(at), ["strategy", "country", "execution_session"]).withColumn("rate", F.col("cost_bps") / 10000)


def run(weights: DataFrame, returns: DataFrame, calendar: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily P&L and trades per variant of staged path weights."""
    held = ledger.positions(weights, returns, calendar)
    trades = ledger.turnover(ledger.weight_ledger(weights, ledger.drifted(held)), weights, 1.0)
    return ledger.daily_pnl(held, trades, calendar), trades


def summary(pnl: DataFrame, trades: DataFrame) -> DataFrame:
    """Per variant: sessions, mean and deviation of net returns, executions, mean turnover and total cost."""
    a = pnl.groupBy("strategy", "country").agg(
        F.count(F.lit(1)).alias("sessions"), F.avg("net_return").alias("mean_net"), F.stddev_samp("net_return").alias("deviation"))
    b = trades.groupBy("strategy", "country").agg(
        F.count(F.lit(1)).alias("executions"), F.avg("turnover").alias("mean_turnover"), F.sum("cost").alias("total_cost"))
    return a.join(b, ["strategy", "country"]).withColumnRenamed("strategy", "variant")
