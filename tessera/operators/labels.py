"""Forward labels, purge and split audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, growth, safe_div
from tessera.operators.calendar import date_ahead


def forward_excess(panel: DataFrame, first: int = 1, last: int = 5) -> DataFrame:
    """Excess growth over exactly the next sessions, in decimals and basis points.

    Rows are unique per session, so the row ``last`` ahead being ``last``
    sessions ahead already proves that none between is missing.
    """
    w = by_asset()
    exact = F.lead("session_id", last).over(w) == F.col("session_id") + last
    p = panel.select("*", exact.alias("_x"), growth("ret", first, last, w).alias("_g"),
                     growth("rf_daily", first, last, w).alias("_f"))
    return (
        p.withColumn("forward_raw", F.when(F.col("_x"), F.col("_g") - 1))
        .withColumn("forward_excess", F.when(F.col("_x"), F.col("_g") - F.col("_f")))
        .withColumn("target", F.col("forward_excess") * 10000)
        .drop("_x", "_g", "_f")
    )


def label_dates(panel: DataFrame, first: int, last: int, execute: int = 1) -> DataFrame:
    """Execution date and first and last label date, each null across a gap."""
    w = by_asset()
    return panel.select(
        "*", date_ahead(execute, w).alias("execution_date"), date_ahead(first, w).alias("label_start_date"),
        date_ahead(last, w).alias("label_end_date"))


def availability(df: DataFrame) -> DataFrame:
    ok = F.col("target").isNotNull() & F.col("execution_date").isNotNull()
    return df.withColumn("target_available", ok).withColumn(
        "target_status", F.when(ok, "available").otherwise("missing_exact_sessions"))


def entry_exit_label(signals: DataFrame, bars: DataFrame, calendar: DataFrame, lag: int, hold: int) -> DataFrame:
    """Close-to-close label between two calendar offsets with the first failing reason."""
    last = F.broadcast(calendar.groupBy("country").agg(F.max("session_id").alias("_last")))
    px = bars.select("country", "asset", "session_id", "close")
    keys = ["country", "asset", "session_id"]
    entry = px.select("country", "asset", (F.col("session_id") - lag).alias("session_id"), F.col("close").alias("entry_close"))
    leave = px.select("country", "asset", (F.col("session_id") - lag - hold).alias("session_id"), F.col("close").alias("exit_close"))
    s = signals.join(last, "country").join(entry, keys, "left").join(leave, keys, "left")
    status = (
        F.when(F.col("session_id") + lag > F.col("_last"), "no_entry_session")
        .when(F.col("session_id") + lag + hold > F.col("_last"), "no_exit_session")
        .when(F.col("entry_close").isNull(), "missing_entry")
        .when(F.col("exit_close").isNull(), "missing_exit")
        .when(F.col("entry_close") <= 0, "bad_entry")
        .otherwise("ok")
    )
    return s.withColumn("label_status", status).withColumn(
        "label", F.when(F.col("label_status") == "ok", safe_div("exit_close", "entry_close") - 1)).drop("_last")


def cash_over_holding(calendar: DataFrame, rate: DataFrame, lag: int, hold: int) -> DataFrame:
    """Compounded cash between entry and exit, only when every session has an observed rate."""
    w = W.partitionBy("country").orderBy("session_id")
    frame = w.rowsBetween(lag + 1, lag + hold)
    d = calendar.join(F.broadcast(rate.select("country", "date", "rf_daily")), ["country", "date"], "left")
    return d.withColumn("cash_observed", F.count("rf_daily").over(frame)).withColumn(
        "cash_return", F.when(F.col("cash_observed") == hold, F.product(1 + F.col("rf_daily")).over(frame) - 1))


def purge(df: DataFrame, boundary: str, early: str, folds: list[str]) -> DataFrame:
    """Mark rows of the early fold whose label reaches the boundary, and eligible rows."""
    cut = F.to_date(F.lit(boundary))
    gone = F.coalesce((F.col("split") == early) & (F.col("label_end_date") >= cut), F.lit(False))
    return df.withColumn("purged", gone).withColumn("model_eligible", F.col("split").isin(folds) & ~gone)


def split_audit(df: DataFrame, boundary: str, early: str) -> DataFrame:
    """Per split: rows, purged rows, date range and leaking rows that were left eligible."""
    cut = F.to_date(F.lit(boundary))
    leak = (F.col("split") == early) & F.col("model_eligible") & (F.col("label_end_date") >= cut)
    return df.groupBy("country", "split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if("purged").alias("n_purged"),
        F.count_if("model_eligible").alias("n_eligible"), F.min("date").alias("first_date"),
        F.max("date").alias("last_date"), F.max("label_end_date").alias("last_label_date"),
        F.count_if(leak).alias("n_leaking"))
