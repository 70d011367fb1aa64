"""Session calendars and time alignment.

A calendar has one row per (country, session); its size is bounded by elapsed
time, not by the data, so ordering it in one task is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, col


def session_calendar(panel: DataFrame, by_country: bool) -> DataFrame:
    """Distinct session dates with a dense 0-based ``session_id``."""
    keys = ["country"] if by_country else []
    days = panel.select(*keys, "date").distinct()
    w = W.partitionBy(*keys).orderBy("date") if keys else W.orderBy("date")
    return days.withColumn("session_id", (F.row_number().over(w) - 1).cast("bigint"))


def week_ending(c: str | Column) -> Column:
    """Friday that closes the Saturday..Friday week of a date."""
    return F.next_day(F.date_sub(col(c), 1), "FRI")


def weekly_signal(calendar: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Flag the last session of each week."""
    out = calendar.withColumn("week", week_ending("date"))
    last = F.max("date").over(W.partitionBy(*keys, "week"))
    return out.withColumn("is_weekly_signal", F.col("date") == last)


def month_end_sessions(calendar: DataFrame, keys: tuple[str, ...] = ("country",)) -> DataFrame:
    """Last session of each month."""
    return calendar.groupBy(*keys, F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))


def densify(panel: DataFrame, calendar: DataFrame, measures: list[str], span: str = "listed") -> DataFrame:
    """Every session of each asset, gaps as null.

    ``span="listed"`` runs from the first to the last observed session of the
    asset; ``"all"`` covers the whole calendar.  Each asset generates its own
    session ids, so no pair of tables is multiplied.
    """
    life = panel.groupBy("country", "asset").agg(
        F.min("session_id").alias("s0"), F.max("session_id").alias("s1"))
    if span == "all":
        ends = calendar.groupBy("country").agg(F.min("session_id").alias("s0"), F.max("session_id").alias("s1"))
        life = life.select("country", "asset").join(F.broadcast(ends), "country")
    grid = life.select("country", "asset", F.explode(F.sequence("s0", "s1")).alias("session_id"))
    grid = grid.join(F.broadcast(calendar.select("country", "session_id", "date")), ["country", "session_id"])
    held = panel.select("country", "asset", "session_id", *measures, F.lit(True).alias("observed"))
    return grid.join(held, ["country", "asset", "session_id"], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False)))


def daily_simple_rate(annual_pct: str | Column) -> Column:
    """Annual percentage as a simple daily rate on a 365-day year."""
    return F.pow(1 + col(annual_pct) / 100, F.lit(1.0 / 365)) - 1


def fill_rate(calendar: DataFrame, rate: DataFrame) -> DataFrame:
    """Carry the last rate forward on the calendar; unknown before the first becomes zero."""
    w = W.partitionBy("country").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    carried = F.last("rf_daily", ignorenulls=True).over(w)
    return (
        calendar.join(rate.select("country", "date", "rf_daily"), ["country", "date"], "left")
        .withColumn("_f", carried)
        .withColumn("rf_known", F.col("_f").isNotNull())
        .withColumn("rf_daily", F.coalesce("_f", F.lit(0.0)))
        .drop("_f")
    )


def session_offset(signals: DataFrame, calendar: DataFrame, lag: int, hold: int) -> DataFrame:
    """Entry and exit dates ``lag`` and ``lag + hold`` sessions after the signal."""
    c = F.broadcast(calendar.select("country", "session_id", "date"))
    entry = c.select("country", (F.col("session_id") - lag).alias("session_id"), F.col("date").alias("entry_date"))
    leave = c.select("country", (F.col("session_id") - lag - hold).alias("session_id"), F.col("date").alias("exit_date"))
    keys = ["country", "session_id"]
    return signals.join(entry, keys, "left").join(leave, keys, "left")


def date_ahead(k: int, window=None) -> Column:
    """Date of the asset's row ``k`` sessions later, null across a gap."""
    w = window if window is not None else by_asset()
    return F.when(F.lead("session_id", k).over(w) == F.col("session_id") + k, F.lead("date", k).over(w))


def calendar_flags(df: DataFrame, date: str = "date") -> DataFrame:
    """Weekday (Monday = 0), calendar month end and quarter end."""
    month_end = F.last_day(date) == F.col(date)
    return (
        df.withColumn("day_of_week", F.weekday(date))
        .withColumn("is_month_end", month_end.cast("int"))
        .withColumn("is_quarter_end", (month_end & (F.month(date) % 3 == 0)).cast("int"))
    )


def quarter_key(date: str | Column) -> Column:
    return F.concat(F.year(col(date)).cast("string"), F.lit("Q"), F.quarter(col(date)).cast("string"))
