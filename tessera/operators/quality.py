"""Coverage, audit and contract checks as aggregates and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, safe_div
from tessera.functions.ranking import exact_quantiles

# Assumed one-way cost in basis points, price-jump threshold, event window in days.
ASSUMED_BPS = 10.0
JUMP = 0.15
EVENT_DAYS = 3


def coverage(panel: DataFrame, fields: list[str], valid: Column) -> DataFrame:
    """Per asset: first, last, rows, valid rows, zero-volume rows, missing fields."""
    missing = sum((F.col(f).isNull().cast("bigint") for f in fields), F.lit(0).cast("bigint"))
    return panel.groupBy("country", "asset").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("observations"),
        F.count_if(valid).alias("valid_observations"), F.count_if(F.col("volume") == 0).alias("zero_volume"),
        F.sum(missing).alias("missing_fields"))


def missing_grid(panel: DataFrame) -> DataFrame:
    """Expected sessions between an asset's first and last against those observed, per country.

    Session ids are dense, so the span needs no range scan of the calendar.
    """
    a = panel.groupBy("country", "asset").agg(
        F.count(F.lit(1)).alias("o"), (F.max("session_id") - F.min("session_id") + 1).alias("e"))
    return a.groupBy("country").agg(F.sum("e").alias("expected"), F.sum("o").alias("observed")).withColumn(
        "missing_rate", 1 - F.col("observed") / F.col("expected"))


def threshold_counts(cov: DataFrame, limits: list[int]) -> DataFrame:
    return cov.groupBy("country").agg(*[F.count_if(F.col("observations") >= n).alias(f"at_least_{n}") for n in limits])


def forecast_dates(calendar: DataFrame, rows: DataFrame, selected: Column, need: int) -> DataFrame:
    """Every calendar date with eligible and selected counts, and whether it is usable."""
    n = rows.groupBy("country", "date").agg(F.count(F.lit(1)).alias("eligible"), F.count_if(selected).alias("selected"))
    d = calendar.select("country", "date").join(n, ["country", "date"], "left").fillna({"eligible": 0, "selected": 0})
    return d.withColumn("usable", F.col("selected") >= need)


def field_rates(panel: DataFrame, fields: list[str]) -> DataFrame:
    cols = [F.avg(F.col(f).isNull().cast("double")).alias(f + "_missing") for f in fields]
    return panel.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), *cols,
                                        F.avg((F.col("volume") == 0).cast("double")).alias("zero_volume_rate"))


def jumps(panel: DataFrame, threshold: float = JUMP) -> DataFrame:
    """Adjacent-session moves of at least ``threshold``, with the volume ratio."""
    w = by_asset()
    p = panel.select(
        "country", "asset", "date", "session_id", "ret", (F.col("session_id") - F.lag("session_id").over(w)).alias("_gap"),
        safe_div("volume", F.lag("volume").over(w)).alias("volume_ratio"))
    return p.where((F.col("_gap") == 1) & (F.abs("ret") >= threshold)).drop("_gap")


def event_ledger(events: DataFrame, fields: list[str]) -> DataFrame:
    """Content-hash id of the event, each event once."""
    text = F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields])
    return events.select(*fields).distinct().withColumn("event_id", F.substring(F.sha2(text, 256), 1, 20))


def event_dates(ledger: DataFrame, dates: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per event and known date kind."""
    cells = [F.struct(F.lit(kind).alias("date_kind"), F.col(c).alias("event_date")) for c, kind in dates.items()]
    return ledger.select(*keep, F.inline(F.array(*cells))).where(F.col("event_date").isNotNull())


def nearest_event(moves: DataFrame, events: DataFrame, days: int = EVENT_DAYS) -> DataFrame:
    """Closest event within ``days`` of each move; moves without one are kept.

    Dates fall in buckets wider than ``days``: a move looks into its own and the
    two neighbouring buckets, so the interval becomes an equi join on
    (asset, bucket) whatever the number of events of one asset.
    """
    size = days + 1
    bucket = lambda d: F.floor(F.unix_date(d) / size)
    e = events.select("asset", "event_id", "date_kind", "event_date", bucket(F.col("event_date")).alias("_b"))
    m = moves.select("country", "asset", "date", F.explode(F.array(*[bucket(F.col("date")) + k for k in (-1, 0, 1)])).alias("_b"))
    gap = F.abs(F.datediff("date", "event_date"))
    hit = m.join(e, ["asset", "_b"]).where(gap <= days).groupBy("country", "asset", "date").agg(
        F.min(F.struct(gap.alias("gap"), "event_id", "date_kind")).alias("h"), F.count_distinct("event_id").alias("n_events"))
    return moves.join(hit, ["country", "asset", "date"], "left").select(
        *moves.columns, "h.event_id", "h.date_kind", F.col("h.gap").alias("gap_days"), F.coalesce("n_events", F.lit(0)).alias("n_events"))


def quote_audit(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per signal date: quotes found on the execution session, spread statistics, cost check.

    ``signals``: country, date, asset, execution_session. ``quotes``: country, asset, session_id, spread_bps.
    """
    q = quotes.select("country", "asset", F.col("session_id").alias("execution_session"), "spread_bps")
    j = signals.select("country", "date", "asset", "execution_session").join(
        q, ["country", "asset", "execution_session"], "left")
    keys = ["country", "date"]
    n = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("universe_assets"), F.count("spread_bps").alias("quote_assets"))
    s = exact_quantiles(j.where(F.col("spread_bps").isNotNull()), keys, {"median_bps": ("spread_bps", 0.5), "p90_bps": ("spread_bps", 0.9)})
    out = n.join(s, keys, "left").withColumn("coverage", F.col("quote_assets") / F.col("universe_assets"))
    out = out.withColumn("median_half_bps", F.col("median_bps") / 2)
    return out.withColumn("above_assumed", F.col("median_half_bps") > ASSUMED_BPS)


def quote_summary(audit: DataFrame) -> DataFrame:
    """Over dates; a date without quotes counts as not above the assumption."""
    return audit.groupBy("country").agg(
        F.count(F.lit(1)).alias("signal_dates"), F.avg("coverage").alias("mean_coverage"), F.min("coverage").alias("min_coverage"),
        F.percentile("median_half_bps", F.lit(0.5)).alias("median_half_bps"),
        F.percentile("median_half_bps", F.lit(0.9)).alias("p90_half_bps"),
        F.avg(F.when(F.col("above_assumed"), 1.0).otherwise(0.0)).alias("share_above"))


def cost_availability(panel: DataFrame) -> DataFrame:
    """Can observed costs be validated: complete quotes, imputed share, half-spread statistics, verdict."""
    quoted = F.col("bid").isNotNull() & F.col("ask").isNotNull()
    half = F.when(quoted, safe_div(F.col("ask") - F.col("bid"), F.col("ask") + F.col("bid")))
    p = panel.withColumn("half", F.when(half >= 0, half))
    n = p.groupBy("country").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("asset").alias("assets"), F.count_if(quoted).alias("complete_quotes"),
        F.avg((~quoted).cast("double")).alias("imputed_share"), F.min(F.when(quoted, F.col("date"))).alias("first_quote"),
        F.max(F.when(quoted, F.col("date"))).alias("last_quote"))
    s = exact_quantiles(p.where(F.col("half").isNotNull()), ["country"], {"median_half": ("half", 0.5), "p95_half": ("half", 0.95)})
    ok = (F.col("complete_quotes") > 0) & (F.col("imputed_share") < 1)
    return n.join(s, "country", "left").withColumn("status", F.when(ok, "pass").otherwise("blocked_no_observed_quotes"))


def failures(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, failures) for row-level expectations, all in one aggregation."""
    cells = [F.struct(F.lit(n).alias("check"), F.count_if(~F.coalesce(c, F.lit(False))).alias("failures")) for n, c in checks.items()]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], value: str, tol: float = 1e-8) -> DataFrame:
    """Row-wise comparison of two runs: present on both sides and equal, or both null."""
    a = left.select(*keys, F.col(value).alias("left_value"), F.lit(True).alias("in_left"))
    b = right.select(*keys, F.col(value).alias("right_value"), F.lit(True).alias("in_right"))
    j = a.join(b, keys, "full").fillna({"in_left": False, "in_right": False})
    gap = F.abs(F.col("left_value") - F.col("right_value"))
    same = F.coalesce(gap < tol, F.col("left_value").isNull() & F.col("right_value").isNull())
    return j.withColumn("abs_difference", gap).withColumn("match", F.col("in_left") & F.col("in_right") & same)


def seed_universe(scores: DataFrame, seeds: list[int]) -> DataFrame:
    """Union, intersection, ratio and per-seed counts of scored assets per date."""
    a = scores.groupBy("country", "date", "asset").agg(
        F.count_distinct("seed").alias("s"), *[F.bool_or(F.col("seed") == s).alias(f"h{s}") for s in seeds])
    full = F.count_if(F.col("s") == len(seeds))
    return a.groupBy("country", "date").agg(
        F.count(F.lit(1)).alias("n_union"), full.alias("n_intersection"), (full / F.count(F.lit(1))).alias("ratio"),
        *[F.count_if(f"h{s}").alias(f"n_seed{s}") for s in seeds])


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content fingerprint: row count and wrapping sum of row hashes."""
    h = F.xxhash64(*df.columns)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("hash_sum"))


def split_manifest(df: DataFrame) -> DataFrame:
    return df.groupBy("country", "split").agg(
        F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.min("execution_date").alias("first_execution"),
        F.min("label_end_date").alias("first_exit"), F.count_distinct("date").alias("n_dates"),
        F.count_distinct("asset").alias("n_assets"), F.count(F.lit(1)).alias("n_rows"))


def grid_coverage(planned: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Planned cells against landed rows, empty cells included."""
    n = landed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"))
    return planned.join(n, keys, "left").fillna({"n_rows": 0}).withColumn("empty", F.col("n_rows") == 0)


def describe(df: DataFrame, measures: list[str]) -> DataFrame:
    """count, mean, deviation, median, min, max of finite values per measure."""
    d = df.select(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) for c in measures])
    med = exact_quantiles(d, [], {c + "_med": (c, 0.5) for c in measures})
    base = d.agg(*[F.struct(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.when(F.count(c) > 1, F.stddev_samp(c)).alias("std"),
        F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in measures])
    cells = [F.struct(F.lit(c).alias("measure"), F.col(f"{c}.n").alias("n"), F.col(f"{c}.mean").alias("mean"),
                      F.col(f"{c}.std").alias("std"), F.col(f"{c}.min").alias("min"), F.col(f"{c}.max").alias("max")) for c in measures]
    mids = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c + "_med").alias("median")) for c in measures])
    return base.select(F.inline(F.array(*cells))).join(F.broadcast(med.select(F.inline(mids))), "measure")
