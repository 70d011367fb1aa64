"""Queries Q01-Q12, Q14-Q25: data quality and contracts."""

from pyspark.sql import functions as F

from tessera.functions.expr import hash_index
from tessera.operators import quality
from tessera.plans import views as v
from tessera.plans.catalog.ensembles import SEED_SQL, SEEDS, _h, seed_scores
from tessera.plans.catalog.featureset import PURGED, purged
from tessera.plans.catalog.portfolios import BOOKS, SIG, Books, signals
from tessera.plans.catalog.universes import PIT, TOP, UNI, complete, members, uni_sup
from tessera.plans.registry import query
from tessera.session import materialise

FIELDS = ["open", "close", "bid", "ask"]
_MISS = " + ".join(f"CAST({f} IS NULL AS INT)" for f in FIELDS)
COV = v.panel_sql("sup") + f""",
cov AS (SELECT country, asset, min(date) AS first_date, max(date) AS last_date, count(*) AS observations,
  count_if(bid IS NOT NULL AND close > 0) AS valid_observations, count_if(volume = 0) AS zero_volume,
  sum({_MISS}) AS missing_fields FROM panel GROUP BY 1, 2)"""


def _cov(spark, sf):
    return quality.coverage(v.panel(spark, sf, "sup"), FIELDS, F.col("bid").isNotNull() & (F.col("close") > 0))


@query("q01_asset_coverage", "country asset:i first_date:d last_date:d observations:i valid_observations:i zero_volume:i missing_fields:i",
       COV, "SELECT * FROM cov")
def q01(spark, sf):
    return _cov(spark, sf)


@query("q02_missing_grid", "country expected:i observed:i missing_rate:f", v.panel_sql("sup"),
       """SELECT *, 1 - observed / expected AS missing_rate FROM (SELECT country, sum(e) AS expected, sum(o) AS observed FROM (
  SELECT country, asset, count(*) AS o, max(session_id) - min(session_id) + 1 AS e FROM panel GROUP BY 1, 2) GROUP BY 1)""")
def q02(spark, sf):
    return quality.missing_grid(v.panel(spark, sf, "sup"))


@query("q03_threshold_counts", "country at_least_252:i at_least_280:i at_least_300:i", COV,
       """SELECT country, count_if(observations >= 252) AS at_least_252, count_if(observations >= 280) AS at_least_280,
  count_if(observations >= 300) AS at_least_300 FROM cov GROUP BY 1""")
def q03(spark, sf):
    return quality.threshold_counts(_cov(spark, sf), [252, 280, 300])


@query("q04_forecast_dates", "country date:d eligible:i selected:i usable:b", PIT,
       f"""SELECT c.country, c.date, coalesce(e, 0) AS eligible, coalesce(s, 0) AS selected, coalesce(s, 0) >= 5 AS usable
  FROM calendar c LEFT JOIN (SELECT country, date, count(*) AS e, count_if(market_cap_rank <= {TOP}) AS s FROM members
  WHERE complete GROUP BY 1, 2) m USING (country, date)""")
def q04(spark, sf):
    m = members(spark, sf).where(complete())
    return quality.forecast_dates(v.calendar(spark, sf, "sup"), m, F.col("market_cap_rank") <= TOP, 5)


@query("q05_field_rates", "country n_rows:i bid_missing:f ret_missing:f zero_volume_rate:f", v.panel_sql("sup"),
       """SELECT country, count(*) AS n_rows, avg(CAST(bid IS NULL AS INT)) AS bid_missing, avg(CAST(ret IS NULL AS INT)) AS ret_missing,
  avg(CAST(volume = 0 AS INT)) AS zero_volume_rate FROM panel GROUP BY 1""")
def q05(spark, sf):
    return quality.field_rates(v.panel(spark, sf, "sup"), ["bid", "ret"])


# Fixed value: a one-session return of this size needs review.
JUMP = 0.15
JUMPS = v.panel_sql("sup") + f""",
jumps AS (SELECT * FROM (SELECT country, asset, date, session_id, ret, session_id - lag(session_id) OVER w AS gap,
  volume / lag(volume) OVER w AS volume_ratio FROM panel WINDOW w AS (PARTITION BY country, asset ORDER BY session_id))
  WHERE gap = 1 AND abs(ret) >= {JUMP})"""


def _jumps(spark, sf):
    return quality.jumps(v.panel(spark, sf, "sup"), JUMP)


@query("q06_price_jumps", "country asset:i date:d ret:f volume_ratio:f", JUMPS, "SELECT * FROM jumps")
def q06(spark, sf):
    return _jumps(spark, sf)


EVENT_FIELDS = ["asset", "event_type", "ex_date", "effective_date"]
EVENTS = """
raw_events AS (SELECT l_suppkey AS asset, o_orderpriority AS event_type, CAST(o_orderdate AS DATE) AS ex_date,
  CAST(l_shipdate AS DATE) AS effective_date FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
ev AS (SELECT *, substr(sha256(concat_ws('|', asset, event_type, ex_date, effective_date)), 1, 20) AS event_id
  FROM (SELECT DISTINCT * FROM raw_events)),
evd AS (SELECT asset, event_id, 'ex' AS date_kind, ex_date AS event_date FROM ev UNION ALL
  SELECT asset, event_id, 'effective', effective_date FROM ev)"""


def _events(spark, sf):
    o = v.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    j = v.table(spark, sf, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_suppkey").alias("asset"), F.col("o_orderpriority").alias("event_type"),
        F.to_date("o_orderdate").alias("ex_date"), F.to_date("l_shipdate").alias("effective_date"))
    return quality.event_ledger(j, EVENT_FIELDS)


def _event_dates(spark, sf):
    return quality.event_dates(_events(spark, sf), {"ex_date": "ex", "effective_date": "effective"}, ["asset", "event_id"])


@query("q07_event_ledger", "asset:i event_type ex_date:d effective_date:d event_id", EVENTS, "SELECT * FROM ev")
def q07(spark, sf):
    return _events(spark, sf)


@query("q08_event_dates", "asset:i event_id date_kind event_date:d", EVENTS, "SELECT * FROM evd")
def q08(spark, sf):
    return _event_dates(spark, sf)


@query("q09_nearest_event", "country asset:i date:d event_id date_kind gap_days n_events:i", JUMPS + "," + EVENTS,
       """SELECT j.country, j.asset, j.date, m.event_id, m.date_kind, CAST(m.gap AS INT) AS gap_days, coalesce(n, 0) AS n_events FROM jumps j LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY country, asset, date ORDER BY gap, event_id, date_kind) AS rn FROM (
  SELECT x.country, x.asset, x.date, event_id, date_kind, abs(date_diff('day', event_date, x.date)) AS gap,
  count(DISTINCT event_id) OVER (PARTITION BY x.country, x.asset, x.date) AS n FROM jumps x JOIN evd ON evd.asset = x.asset
  AND event_date BETWEEN x.date - 3 AND x.date + 3)) m ON m.country = j.country AND m.asset = j.asset AND m.date = j.date AND rn = 1""")
def q09(spark, sf):
    return quality.nearest_event(_jumps(spark, sf), _event_dates(spark, sf))


AUDIT = SIG + """,
qa AS (SELECT *, median_bps / 2 AS median_half_bps, median_bps / 2 > 10 AS above_assumed, quote_assets / universe_assets AS coverage
  FROM (SELECT s.country, s.date, count(*) AS universe_assets, count(p.spread_bps) AS quote_assets,
  quantile_cont(p.spread_bps, 0.5) AS median_bps, quantile_cont(p.spread_bps, 0.9) AS p90_bps FROM sig s LEFT JOIN panel p
  ON p.country = s.country AND p.asset = s.asset AND p.session_id = s.execution_session GROUP BY 1, 2))"""


def _audit(spark, sf):
    return quality.quote_audit(signals(spark, sf), v.panel(spark, sf, "sup"))


@query("q10_quote_audit", "country date:d universe_assets:i quote_assets:i coverage:f median_bps:f4 p90_bps:f4 above_assumed", AUDIT,
       "SELECT * FROM qa")
def q10(spark, sf):
    return _audit(spark, sf)


@query("q11_quote_summary", "country signal_dates:i mean_coverage:f min_coverage:f median_half_bps:f4 p90_half_bps:f4 share_above:f", AUDIT,
       """SELECT country, count(*) AS signal_dates, avg(coverage) AS mean_coverage, min(coverage) AS min_coverage,
  quantile_cont(median_half_bps, 0.5) AS median_half_bps, quantile_cont(median_half_bps, 0.9) AS p90_half_bps,
  avg(CASE WHEN above_assumed THEN 1.0 ELSE 0.0 END) AS share_above FROM qa GROUP BY 1""")
def q11(spark, sf):
    return quality.quote_summary(_audit(spark, sf))


@query("q12_cost_availability",
       "country n_rows:i assets:i complete_quotes:i imputed_share:f first_quote:d last_quote:d median_half:f9 p95_half:f9 status", v.bars_sql("sup"),
       """SELECT country, count(*) AS n_rows, count(DISTINCT asset) AS assets, count(bid) AS complete_quotes, avg(CAST(bid IS NULL AS INT)) AS imputed_share,
  min(CASE WHEN bid IS NOT NULL THEN date END) AS first_quote, max(CASE WHEN bid IS NOT NULL THEN date END) AS last_quote,
  quantile_cont((ask - bid) / (ask + bid), 0.5) AS median_half, quantile_cont((ask - bid) / (ask + bid), 0.95) AS p95_half,
  CASE WHEN count(bid) > 0 AND count(bid) < count(*) THEN 'pass' ELSE 'blocked_no_observed_quotes' END AS status FROM bars GROUP BY 1""")
def q12(spark, sf):
    return quality.cost_availability(v.bars(spark, sf, "sup"))


CONTRACT = PIT + f""",
m10 AS (SELECT * FROM members WHERE market_cap_rank <= {TOP}), n10 AS (SELECT country, date, count(*) AS n FROM m10 GROUP BY 1, 2)"""


@query("q14_cross_section_contract", "country dates:i exact_dates:i short_dates:i", CONTRACT,
       f"""SELECT country, count(*) AS dates, count_if(n = {TOP}) AS exact_dates, count_if(n <> {TOP}) AS short_dates FROM n10 GROUP BY 1""")
def q14(spark, sf):
    n = members(spark, sf).where(F.col("market_cap_rank") <= TOP).groupBy("country", "date").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("country").agg(F.count(F.lit(1)).alias("dates"), F.count_if(F.col("n") == TOP).alias("exact_dates"),
                                    F.count_if(F.col("n") != TOP).alias("short_dates"))


REL = PURGED + """,
rel AS (SELECT *, target - avg(target) OVER (PARTITION BY country, date) AS t_rel FROM purged)"""


@query("q15_panel_contract", "check_name failures:i", REL,
       """SELECT 'purged_rows_not_eligible' AS check_name, count_if(purged AND model_eligible) AS failures FROM rel
  UNION ALL SELECT 'execution_after_signal', count_if(execution_date <= date) FROM rel
  UNION ALL SELECT 'label_starts_after_execution', count_if(label_start_date <= execution_date) FROM rel
  UNION ALL SELECT 'label_end_after_start', count_if(label_end_date <= label_start_date) FROM rel
  UNION ALL SELECT 'demeaned_mean_zero', count_if(abs(m) > 1e-6) FROM (SELECT avg(t_rel) AS m FROM rel WHERE t_rel IS NOT NULL GROUP BY country, date)""")
def q15(spark, sf):
    p = purged(spark, sf)
    p = materialise(p.select("country", "date", "asset", "target", "purged", "model_eligible", "execution_date", "label_start_date", "label_end_date"))
    ok = lambda c: F.coalesce(c, F.lit(True))
    rows = quality.failures(p, {
        "purged_rows_not_eligible": ~(F.col("purged") & F.col("model_eligible")),
        "execution_after_signal": ok(F.col("execution_date") > F.col("date")),
        "label_starts_after_execution": ok(F.col("label_start_date") > F.col("execution_date")),
        "label_end_after_start": ok(F.col("label_end_date") > F.col("label_start_date"))})
    from tessera.operators.features import demean

    mean = demean(p.where(F.col("target").isNotNull()), "target", "rel").groupBy("country", "date").agg(F.avg("rel").alias("m"))
    return rows.unionByName(quality.failures(mean, {"demeaned_mean_zero": F.abs("m") <= 1e-6})).withColumnRenamed("check", "check_name")


@query("q16_leakage_checks", "check_name failures:i", PURGED,
       """SELECT 'label_inside_split' AS check_name, count_if(split = 'train' AND model_eligible AND label_end_date >= DATE '1998-01-01') AS failures FROM purged
  UNION ALL SELECT 'execution_after_signal', count_if(execution_date <= date) FROM purged
  UNION ALL SELECT 'window_start_exists', count_if(ret IS NULL) FROM purged
  UNION ALL SELECT 'rf_known', count_if(NOT rf_known) FROM purged""")
def q16(spark, sf):
    ok = lambda c: F.coalesce(c, F.lit(True))
    leak = (F.col("split") == "train") & F.col("model_eligible") & (F.col("label_end_date") >= F.to_date(F.lit("1998-01-01")))
    return quality.failures(purged(spark, sf), {
        "label_inside_split": ok(~leak), "execution_after_signal": ok(F.col("execution_date") > F.col("date")),
        "window_start_exists": F.col("ret").isNotNull(), "rf_known": F.col("rf_known")}).withColumnRenamed("check", "check_name")


@query("q17_run_accounting", "check_name failures:i", BOOKS + """,
sw AS (SELECT strategy, country, execution_session, sum(target_weight) AS s FROM led GROUP BY 1, 2, 3)""",
       """SELECT 'weights_sum_to_one' AS check_name, count_if(abs(s - 1) > 1e-8) AS failures FROM sw
  UNION ALL SELECT 'weights_not_negative', count_if(target_weight < -1e-12) FROM led
  UNION ALL SELECT 'parts_add_up', count_if(abs(continuing_turnover + entry_turnover + exit_turnover - turnover) > 1e-10) FROM tr
  UNION ALL SELECT 'net_is_gross_less_cost', count_if(abs(gross_return - cost - net_return) > 1e-12) FROM pnl""")
def q17(spark, sf):
    b = Books(spark, sf)
    held = b.held()
    led, trades = b.trades(held)
    led, trades = materialise(led), materialise(trades)
    from tessera.operators import ledger

    pnl = ledger.daily_pnl(held, trades, b.calendar)
    s = led.groupBy("strategy", "country", "execution_session").agg(F.sum("target_weight").alias("s"))
    parts = F.col("continuing_turnover") + F.col("entry_turnover") + F.col("exit_turnover") - F.col("turnover")
    out = quality.failures(s, {"weights_sum_to_one": F.abs(F.col("s") - 1) <= 1e-8})
    for df, checks in ((led, {"weights_not_negative": F.col("target_weight") >= -1e-12}),
                       (trades, {"parts_add_up": F.abs(parts) <= 1e-10}),
                       (pnl, {"net_is_gross_less_cost": F.abs(F.col("gross_return") - F.col("cost") - F.col("net_return")) <= 1e-12})):
        out = out.unionByName(quality.failures(df, checks))
    return out.withColumnRenamed("check", "check_name")


TWO = v.panel_sql("sup") + f""",
ra AS (SELECT country, asset, date, close AS x FROM panel WHERE {_h(10, "'a'", 'asset', 'session_id')} <> 0),
rb AS (SELECT country, asset, date, CASE WHEN {_h(10, "'d'", 'asset', 'session_id')} = 0 THEN close + 1e-3 ELSE close END AS x
  FROM panel WHERE {_h(10, "'b'", 'asset', 'session_id')} <> 0)"""


@query("q18_run_reconciliation", "country asset:i date:d left_value:f right_value:f in_left:b in_right:b match:b", TWO,
       """SELECT *, coalesce(in_left AND in_right AND abs(left_value - right_value) < 1e-8, FALSE) AS match FROM (
  SELECT country, asset, date, ra.x AS left_value, rb.x AS right_value, ra.x IS NOT NULL AS in_left, rb.x IS NOT NULL AS in_right
  FROM ra FULL JOIN rb USING (country, asset, date))""")
def q18(spark, sf):
    p = v.panel(spark, sf, "sup").select("country", "asset", "date", "session_id", "close")
    tag = lambda t: hash_index(F.lit(10), t, F.col("asset"), F.col("session_id"))
    a = p.where(tag("a") != 0).withColumnRenamed("close", "x")
    b = p.where(tag("b") != 0).withColumn("x", F.when(tag("d") == 0, F.col("close") + 1e-3).otherwise(F.col("close")))
    return quality.reconcile(a, b, ["country", "asset", "date"], "x")


@query("q19_seed_universe", "country date:d n_union:i n_intersection:i ratio:f n_seed7:i n_seed19:i n_seed42:i", SEED_SQL + """,
pa AS (SELECT country, date, asset, count(*) AS s, bool_or(seed = 7) AS h7, bool_or(seed = 19) AS h19, bool_or(seed = 42) AS h42
  FROM seeds GROUP BY 1, 2, 3)""",
       """SELECT country, date, count(*) AS n_union, count_if(s = 3) AS n_intersection, count_if(s = 3) / count(*) AS ratio,
  count_if(h7) AS n_seed7, count_if(h19) AS n_seed19, count_if(h42) AS n_seed42 FROM pa GROUP BY 1, 2""")
def q19(spark, sf):
    return quality.seed_universe(seed_scores(spark, sf), SEEDS)


@query("q20_fingerprint", "run n_rows:i equal:b", v.bars_sql("sup"),
       "SELECT run, n_rows, TRUE AS equal FROM (SELECT count(*) AS n_rows FROM bars), (VALUES ('first'), ('second')) AS r(run)")
def q20(spark, sf):
    """Two evaluations of the same table must agree."""
    one = quality.fingerprint(v.bars(spark, sf, "sup")).withColumn("run", F.lit("first"))
    two = quality.fingerprint(v.bars(spark, sf, "sup").repartition("date")).withColumn("run", F.lit("second"))
    both = one.unionByName(two)
    same = both.agg(F.count_distinct("n_rows", "hash_sum") == 1).scalar()
    return both.withColumn("equal", same)


@query("q21_country_coverage", "country n_rows:i mean_cap_present:f median_n:f min_n:i", PIT + """,
n AS (SELECT country, date, count(*) AS n FROM members WHERE complete GROUP BY 1, 2)""",
       """SELECT * FROM (SELECT country, count(*) AS n_rows, avg(CAST(market_cap IS NOT NULL AS INT)) AS mean_cap_present FROM members GROUP BY 1)
  JOIN (SELECT country, quantile_cont(n, 0.5) AS median_n, min(n) AS min_n FROM n GROUP BY 1) USING (country)""")
def q21(spark, sf):
    m = members(spark, sf)
    n = m.where(complete()).groupBy("country", "date").agg(F.count(F.lit(1)).alias("n"))
    usable = n.groupBy("country").agg(F.percentile("n", F.lit(0.5)).alias("median_n"), F.min("n").alias("min_n"))
    return m.groupBy("country").agg(F.count(F.lit(1)).alias("n_rows"), F.avg(
        F.col("market_cap").isNotNull().cast("double")).alias("mean_cap_present")).join(usable, "country")


@query("q22_split_manifest", "country split first_date:d last_date:d first_execution:d first_exit:d n_dates:i n_assets:i n_rows:i", PURGED,
       """SELECT country, split, min(date) AS first_date, max(date) AS last_date, min(execution_date) AS first_execution,
  min(label_end_date) AS first_exit, count(DISTINCT date) AS n_dates, count(DISTINCT asset) AS n_assets, count(*) AS n_rows
  FROM purged GROUP BY 1, 2""")
def q22(spark, sf):
    return quality.split_manifest(purged(spark, sf))


@query("q23_grid_coverage", "country asset:i month:d n_rows:i empty:b", v.bars_sql("sup") + "," + v.CAPS_SUP_SQL + "," + UNI,
       """SELECT u.country, u.asset, u.universe_month AS month, coalesce(n, 0) AS n_rows, coalesce(n, 0) = 0 AS empty FROM uni u
  LEFT JOIN (SELECT country, asset, CAST(date_trunc('month', date) AS DATE) AS month, count(*) AS n FROM bars GROUP BY 1, 2, 3) b
  ON b.country = u.country AND b.asset = u.asset AND b.month = u.universe_month""")
def q23(spark, sf):
    planned = uni_sup(spark, sf).select("country", "asset", F.col("universe_month").alias("month"))
    landed = v.bars(spark, sf, "sup").withColumn("month", F.trunc("date", "MM"))
    return quality.grid_coverage(planned, landed, ["country", "asset", "month"])


@query("q25_describe", "measure n:i mean:f4 std:f4 median:f4 min:f4 max:f4", v.panel_sql("sup"), " UNION ALL ".join(
    f"""SELECT '{c}' AS measure, count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, quantile_cont({c}, 0.5) AS median,
  min({c}) AS min, max({c}) AS max FROM panel""" for c in ("close", "ret", "spread_bps")))
def q25(spark, sf):
    return quality.describe(v.panel(spark, sf, "sup"), ["close", "ret", "spread_bps"])
