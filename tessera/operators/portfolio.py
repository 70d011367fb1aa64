"""Target weights, cost rates, schedules and scenario grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expanding import expanding_quantile
from tessera.functions.expr import attach_stats, safe_div
from tessera.operators.universe import top_k

GROUP = ["country", "date"]
# Default one-way cost (10 basis points) and basis points per unit.
DEFAULT_COST = 0.001
BPS = 10000.0
MIN_CAP = 0.05


def equal_weight(df: DataFrame, valid: Column) -> DataFrame:
    """1/n over valid names."""
    d = df.where(valid)
    return attach_stats(d, GROUP, F.count(F.lit(1)).alias("_n")).withColumn("target_weight", 1 / F.col("_n")).drop("_n")


def top_k_equal(df: DataFrame, score: str, k: int) -> DataFrame:
    """Equal weight over the k best names (all names when fewer)."""
    d = top_k(df.where(F.col(score).isNotNull()), GROUP, [F.desc(score), F.asc("asset")], k)
    n = F.count(F.lit(1)).over(W.partitionBy(*GROUP))
    return d.withColumn("target_weight", 1 / n).drop("pick")


def name_turnover(picks: DataFrame, dates: DataFrame, k: int) -> DataFrame:
    """Share of names changed since the previous cross-section: symmetric difference over ``k``."""
    from tessera.operators.universe import churn

    c = churn(picks, dates)
    return c.select(*GROUP, ((F.col("entered") + F.col("exited")) / k).alias("name_turnover"))


def risk_scaled(df: DataFrame, score: str, variance: str, min_cap: float | Column = MIN_CAP, keys: list[str] = GROUP) -> DataFrame:
    """Long-only weights proportional to positive score over variance, capped, fully invested.

    ``min_cap`` is the largest weight of a name (1/n where that is more).

    Water filling in closed form: sorted by scaled score, the first row whose
    scaled share fits the cap fixes the multiplier; better rows sit at the cap.
    The universe is a top-n cross-section, so the window is bounded.
    """
    g = W.partitionBy(*keys)
    order = g.orderBy(F.desc("_s"), F.asc("asset"))
    d = df.withColumn("_s", F.coalesce(safe_div(F.greatest(F.col(score), F.lit(0.0)), variance), F.lit(0.0)))
    d = d.select(
        "*", F.count(F.lit(1)).over(g).alias("_n"), F.count_if(F.col("_s") > 0).over(g).alias("_p"),
        F.row_number().over(order).alias("_k"),
        F.sum("_s").over(order.rowsBetween(0, W.unboundedFollowing)).alias("_rest"),
    ).withColumn("_c", F.greatest(F.lit(min_cap), 1 / F.col("_n")))
    lam = safe_div(1 - (F.col("_k") - 1) * F.col("_c"), "_rest")
    d = d.withColumn("_l", F.when((F.col("_rest") > 0) & (lam * F.col("_s") <= F.col("_c") + 1e-15), lam))
    d = d.withColumn("_first", F.min(F.when(F.col("_l").isNotNull(), F.col("_k"))).over(g))
    d = d.withColumn("_lam", F.max(F.when(F.col("_k") == F.col("_first"), F.col("_l"))).over(g))
    short = F.col("_p") * F.col("_c") < 1
    rest = safe_div(1 - F.col("_p") * F.col("_c"), F.col("_n") - F.col("_p"))
    w = (
        F.when(F.col("_p") == 0, 1 / F.col("_n"))
        .when(short, F.when(F.col("_s") > 0, F.col("_c")).otherwise(rest))
        .otherwise(F.least(F.col("_c"), F.col("_lam") * F.col("_s")))
    )
    return d.withColumn("target_weight", w).withColumn("cap", F.col("_c")).drop(
        "_s", "_n", "_p", "_k", "_rest", "_c", "_l", "_first", "_lam")


def last_quote_before(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """As-of: the asset's last spread strictly before each signal session.

    Quotes and signals of an asset are merged into one ordered run; the signal
    sorts before a quote of the same session.
    """
    keys = ["country", "asset", "session_id"]
    q = quotes.where(F.col("spread_bps").isNotNull()).select(*keys, F.lit(1).alias("kind"), "spread_bps")
    q = q.join(signals.select("country", "asset").distinct(), ["country", "asset"], "left_semi")
    s = signals.select(*keys).distinct().select(*keys, F.lit(0).alias("kind"), F.lit(None).cast("double").alias("spread_bps"))
    w = W.partitionBy("asset", "country").orderBy("session_id", "kind").rowsBetween(W.unboundedPreceding, -1)
    merged = q.unionByName(s).withColumn("own_bps", F.last("spread_bps", ignorenulls=True).over(w))
    return merged.where("kind = 0").select(*keys, "own_bps")


def cost_rates(signals: DataFrame, quotes: DataFrame, band_bps: float = 0.5) -> DataFrame:
    """One-way rates per signal row: C0 fixed, C1 lagged country median, C2 lagged own quote.

    Both medians and quotes use sessions strictly before the signal.  A name
    without a quote pays the country rate.
    """
    o = signals.select("country", "session_id").distinct()
    med = expanding_quantile(quotes, o, "country", "session_id", "spread_bps", 0.5, band_bps)
    half = F.coalesce(F.col("q") / 2 / BPS, F.lit(DEFAULT_COST))
    own = last_quote_before(signals, quotes)
    out = signals.join(F.broadcast(med), ["country", "session_id"], "left").join(
        own, ["country", "asset", "session_id"], "left")
    c1 = F.greatest(half, F.lit(0.0))
    return out.withColumn("c0", F.lit(DEFAULT_COST)).withColumn("c1", c1).withColumn(
        "c2", F.greatest(F.coalesce(F.col("own_bps") / 2 / BPS, half), F.lit(0.0))).drop("q", "own_bps")


def long_scenarios(rates: DataFrame, keep: list[str]) -> DataFrame:
    """One row per cost scenario."""
    return rates.select(*keep, F.inline(F.array(*[
        F.struct(F.lit(s.upper()).alias("scenario"), F.col(s).alias("rate")) for s in ("c0", "c1", "c2")])))


def schedule(signals: DataFrame, entries: DataFrame) -> DataFrame:
    """Signals with execution date and entry count; the reason when one is skipped."""
    n = entries.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("entries"))
    s = signals.join(n, GROUP, "left").fillna({"entries": 0})
    return s.withColumn("status", F.when(F.col("execution_date").isNull(), "missing_execution").when(
        F.col("entries") == 0, "empty_signal").otherwise("scheduled"))


def schedule_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("country").agg(
        F.count_if(F.col("status") == "scheduled").alias("scheduled"),
        F.count_if(F.col("status") == "missing_execution").alias("skipped_missing_execution"),
        F.count_if(F.col("status") == "empty_signal").alias("skipped_empty_signal"))


def scenario_grid(base: dict[str, float | str], options: dict[str, list[float] | list[str]]) -> list[dict[str, float | str]]:
    """One dimension at a time around a base configuration (a handful of rows)."""
    out = [dict(base, variant="base")]
    for name, values in options.items():
        for value in values:
            if value != base[name]:
                label = value if isinstance(value, str) else f"{value:g}"
                out.append(dict(base, **{name: value, "variant": f"{name}={label}"}))
    return out
