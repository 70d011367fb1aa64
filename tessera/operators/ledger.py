"""Costed portfolio ledger in set form.

Input is one weights table: (strategy, country, signal_date, execution_session,
asset, target_weight, rate), with a ``scenario`` column where several cost
scenarios run side by side.  A holding period runs from an execution to the
next; inside it a position is weight times running growth, so drifted weights,
P&L and trades are windows and joins, not a loop over dates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import safe_div

DEFAULT_COST = 0.001


def book_of(df: DataFrame) -> list[str]:
    """Keys of a book: strategy, cost scenario if the table has one, country."""
    return [c for c in ("strategy", "scenario", "country") if c in df.columns]


def rebalances(weights: DataFrame) -> DataFrame:
    """Ordered executions per book with the next and previous one."""
    book = book_of(weights)
    w = W.partitionBy(*book).orderBy("execution_session")
    return weights.select(*book, "execution_session", "signal_date").distinct().select(
        "*", F.lead("execution_session").over(w).alias("next_session"),
        (F.row_number().over(w) == 1).alias("initial"))


def positions(weights: DataFrame, returns: DataFrame, calendar: DataFrame) -> DataFrame:
    """Value of every held position on every session of its holding period.

    Each position generates its own sessions; their number is bounded by the
    calendar.  An unknown return carries the position at its last value.
    """
    book = book_of(weights)
    reb = rebalances(weights).select(*book, "execution_session", "next_session")
    last = calendar.groupBy("country").agg(F.max("session_id").alias("last_session"))
    held = (
        weights.where(F.col("target_weight") > 0)
        .join(F.broadcast(reb), [*book, "execution_session"])
        .join(F.broadcast(last), "country")
        .withColumn("until", F.coalesce("next_session", "last_session"))
        .where(F.col("until") > F.col("execution_session"))
        .select(*book, "execution_session", "next_session", "asset", "target_weight", "rate",
                F.explode(F.sequence(F.col("execution_session") + 1, F.col("until"))).alias("session_id"))
    )
    r = returns.select("country", "asset", "session_id", "ret")
    w = W.partitionBy("asset", "execution_session", *book).orderBy("session_id")
    growth = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return held.join(r, ["country", "asset", "session_id"], "left").select(
        "*", (F.col("target_weight") * growth).alias("value"), F.col("ret").isNull().alias("missing"))


def drifted(held: DataFrame) -> DataFrame:
    """Weights just before the next execution: position values normalised over the book."""
    book = book_of(held)
    at = held.where(F.col("session_id") == F.col("next_session"))
    total = at.groupBy(*book, "next_session").agg(F.sum("value").alias("_v"))
    return at.join(total, [*book, "next_session"]).select(
        *book, F.col("next_session").alias("execution_session"), "asset",
        safe_div("value", "_v").alias("pre_weight"), F.col("rate").alias("last_rate"))


def weight_ledger(weights: DataFrame, before: DataFrame) -> DataFrame:
    """Pre-trade, target and trade over the union of old and new names, with component and cost.

    Exits pay the rate stored at the previous execution.
    """
    book = book_of(weights)
    keys = [*book, "execution_session", "asset"]
    new = weights.select(*keys, "target_weight", "rate")
    j = before.join(new, keys, "full")
    pre, tgt = F.coalesce("pre_weight", F.lit(0.0)), F.coalesce("target_weight", F.lit(0.0))
    delta = tgt - pre
    rate = F.coalesce("rate", "last_rate", F.lit(DEFAULT_COST))
    component = (
        F.when(F.col("target_weight").isNull(), "forced_exit")
        .when(F.col("pre_weight").isNull() & (tgt > 0), "forced_entry")
        .otherwise("continuing_name")
    )
    return j.select(
        *keys, pre.alias("pre_weight"), tgt.alias("target_weight"), delta.alias("weight_delta"),
        F.abs(delta).alias("absolute_trade"), component.alias("trade_component"), rate.alias("cost_rate"),
        (F.abs(delta) * rate).alias("transaction_cost"))


def turnover(ledger: DataFrame, weights: DataFrame, cap: float) -> DataFrame:
    """Turnover by component per execution; the initial deployment is exempt from the cap."""
    book = book_of(ledger)
    part = lambda c: F.sum(F.when(F.col("trade_component") == c, F.col("absolute_trade")).otherwise(0.0))
    t = ledger.groupBy(*book, "execution_session").agg(
        part("continuing_name").alias("continuing_turnover"), part("forced_entry").alias("entry_turnover"),
        part("forced_exit").alias("exit_turnover"), F.sum("absolute_trade").alias("turnover"),
        F.sum("transaction_cost").alias("cost"), F.count_if(F.col("target_weight") > 0).alias("positions"))
    first = rebalances(weights).select(*book, "execution_session", "signal_date", "initial")
    t = t.join(F.broadcast(first), [*book, "execution_session"])
    return t.withColumn("rebalance_type", F.when(F.col("initial"), "initial_deployment").otherwise("rebalance")).withColumn(
        "cap_utilization", F.when(~F.col("initial"), F.col("turnover") / cap)).drop("initial")


def daily_pnl(held: DataFrame, trades: DataFrame, calendar: DataFrame) -> DataFrame:
    """Gross return, cost, net return, turnover, positions and missing valuations per session.

    A new book earns from the session after its execution.  ``evaluated`` tells, before
    nulls become 0, whether the session had a return: some held name was valued, or the
    book was only being deployed.
    """
    book = book_of(held)
    v = held.groupBy(*book, "execution_session", "session_id").agg(
        F.sum("value").alias("v"), F.count(F.lit(1)).alias("n_held"), F.count_if("missing").alias("missing_valuations"))
    w = W.partitionBy(*book, "execution_session").orderBy("session_id")
    v = v.withColumn("gross_return", safe_div("v", F.lag("v", 1, 1.0).over(w)) - 1)
    first = trades.groupBy(*book).agg(F.min("execution_session").alias("_first"))
    days = F.broadcast(first).join(F.broadcast(calendar.select("country", "session_id", "date")), "country").where(
        F.col("session_id") >= F.col("_first"))
    t = trades.select(*book, F.col("execution_session").alias("session_id"), "turnover", "cost", "positions")
    days = days.withColumn("_deployed", F.col("session_id") == F.col("_first")).drop("_first")
    d = days.join(v.drop("execution_session", "v"), [*book, "session_id"], "left").join(t, [*book, "session_id"], "left")
    zero = F.lit(0.0)
    return d.select(
        *book, "session_id", "date", F.coalesce("gross_return", zero).alias("gross_return"),
        F.coalesce("cost", zero).alias("cost"),
        (F.coalesce("gross_return", zero) - F.coalesce("cost", zero)).alias("net_return"),
        F.coalesce("turnover", zero).alias("turnover"),
        F.coalesce("positions", "n_held", F.lit(0)).cast("bigint").alias("positions"),
        F.coalesce("missing_valuations", F.lit(0)).cast("bigint").alias("missing_valuations"),
        F.coalesce(F.col("n_held") > F.col("missing_valuations"), F.col("_deployed")).alias("evaluated"))


def missing_valuations(held: DataFrame) -> DataFrame:
    book = book_of(held)
    return held.where("missing").select(*book, "session_id", "asset", F.lit("missing_valuation_carried").alias("reason"))


def period_pnl(weights: DataFrame, forward: DataFrame, value: str) -> DataFrame:
    """Return of each target book over the label window; evaluable only if every name has one."""
    book = book_of(weights)
    keys = [*book, "signal_date"]
    f = forward.select("country", "asset", F.col("date").alias("signal_date"), F.col(value).alias("_f"))
    j = weights.where(F.col("target_weight") > 0).join(f, ["country", "asset", "signal_date"], "left")
    return j.groupBy(*keys).agg(
        F.bool_and(F.col("_f").isNotNull()).alias("evaluable"), F.count_if(F.col("_f").isNull()).alias("missing_names"),
        F.sum(F.col("target_weight") * F.col("_f")).alias("_r"), F.count(F.lit(1)).alias("names"),
    ).select(*keys, "names", "missing_names", "evaluable", F.when(F.col("evaluable"), F.col("_r")).alias("period_return"))


def target_turnover(weights: DataFrame) -> DataFrame:
    """L1 distance between consecutive target books; a name that left counts once."""
    book = book_of(weights)
    reb = rebalances(weights)
    now = weights.select(*book, "execution_session", "asset", F.col("target_weight").alias("w1"))
    nxt = weights.join(F.broadcast(reb), [*book, "execution_session"]).where(F.col("next_session").isNotNull()).select(
        *book, F.col("next_session").alias("execution_session"), "asset", F.col("target_weight").alias("w0"))
    j = now.join(nxt, [*book, "execution_session", "asset"], "full")
    zero = F.lit(0.0)
    return j.groupBy(*book, "execution_session").agg(
        F.sum(F.abs(F.coalesce("w1", zero) - F.coalesce("w0", zero))).alias("l1_turnover"))


def event_log(trades: DataFrame, risk: DataFrame, skipped: DataFrame) -> DataFrame:
    """Rebalance types, risk fallbacks and skipped signals in one log.

    ``risk``: (country, signal_date, fallback), where the covariance fell back to its
    diagonal; ``skipped``: (country, signal_date, status).
    """
    cols = ["country", "signal_date", "event", "detail"]
    a = trades.select("country", "signal_date", F.lit("rebalance").alias("event"), F.concat_ws(
        ":", "strategy", "rebalance_type").alias("detail"))
    b = risk.where("fallback").select("country", "signal_date", F.lit("risk_fallback").alias("event"),
                                      F.lit("too_few_valid_assets").alias("detail"))
    c = skipped.where(F.col("status") != "scheduled").select(
        "country", "signal_date", F.lit("skipped").alias("event"), F.col("status").alias("detail"))
    return a.select(*cols).unionByName(b).unionByName(c)
