"""Queries U01-U14 and the flagship."""

from pyspark.sql import functions as F

from tessera.operators import calendar as cal
from tessera.operators import clean, features, universe
from tessera.plans import flagship
from tessera.plans import views as v
from tessera.plans.catalog.calendars import WEEKLY
from tessera.plans.catalog.cleaning import FOLDS, SPLIT_SQL
from tessera.plans.catalog.featureset import forward_sql, full, labelled
from tessera.plans.registry import query

TOP = 10
LAG_SQL = "CAST(date_trunc('month', snapshot_date) + INTERVAL 1 MONTH AS DATE)"
CAPS_USER = f"""{v.CAPS_USER_SQL.strip()},
lagged AS (SELECT *, {LAG_SQL} AS universe_month FROM caps)"""


def lagged_user(spark, sf):
    return universe.lag_snapshots(v.caps(spark, sf, "user"))


@query("u01_lagged_snapshot", "country asset:i snapshot_date:d universe_month:d market_cap:f2", CAPS_USER, "SELECT * FROM lagged")
def u01(spark, sf):
    return lagged_user(spark, sf)


@query("u02_dedupe_largest", "country universe_month:d asset:i market_cap:f2", CAPS_USER,
       "SELECT country, universe_month, asset, max(market_cap) AS market_cap FROM lagged GROUP BY 1, 2, 3")
def u02_largest(spark, sf):
    return universe.dedupe_snapshots(lagged_user(spark, sf), "largest")


@query("u02_dedupe_latest", "country universe_month:d asset:i market_cap:f2 snapshot_date:d", CAPS_USER,
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, universe_month, asset
  ORDER BY snapshot_date DESC) AS rn FROM lagged) WHERE rn = 1""")
def u02_latest(spark, sf):
    return universe.dedupe_snapshots(lagged_user(spark, sf), "latest")


UNI = f"""
uni AS (SELECT *, eligible AND market_cap_rank <= {TOP} AS selected FROM (
  SELECT *, coalesce(market_cap > 0, FALSE) AS eligible, row_number() OVER (PARTITION BY country, universe_month
    ORDER BY market_cap DESC NULLS LAST, asset) AS market_cap_rank FROM (
  SELECT country, asset, snapshot_date, market_cap, {LAG_SQL} AS universe_month FROM caps)))"""
UNI_SUP = v.SUPPLIER_COUNTRY.strip() + "," + v.CAPS_SUP_SQL + "," + UNI


def uni_sup(spark, sf, pool=None):
    return universe.build(v.caps(spark, sf, "sup"), "latest", TOP, pool)


@query("u03_size_rank", "country universe_month:d asset:i market_cap_rank:i", UNI_SUP, "SELECT * FROM uni")
def u03(spark, sf):
    return uni_sup(spark, sf)


@query("u04_universe_flags", "country universe_month:d asset:i eligible:b selected:b", UNI_SUP, "SELECT * FROM uni")
def u04(spark, sf):
    return uni_sup(spark, sf)


PIT = v.panel_sql("sup") + "," + v.CAPS_SUP_SQL + "," + UNI + f""",
rolled AS (SELECT *, {full('product(1 + ret)', 'ret', 3)} - 1 AS r3 FROM panel),
members AS (SELECT p.*, u.universe_month, u.market_cap, u.market_cap_rank,
  r3 IS NOT NULL AND spread_bps IS NOT NULL AS complete
  FROM rolled p JOIN uni u ON u.country = p.country AND u.asset = p.asset
  AND u.universe_month = date_trunc('month', p.date) WHERE u.eligible)"""


def members(spark, sf):
    p = features.rolling_features(v.panel(spark, sf, "sup"), (3,), ())
    return universe.point_in_time(p, uni_sup(spark, sf))


def complete():
    return features.feature_complete(["return_3", "spread_bps"])


@query("u05_point_in_time_join", "country asset:i date:d universe_month:d market_cap:f2 market_cap_rank:i close:f", PIT,
       "SELECT * FROM members")
def u05(spark, sf):
    return members(spark, sf)


@query("u06_liquid_universe", "country asset date:d liquidity:f3 liquidity_rank:i", v.panel_sql("brand") + f""",
liq AS (SELECT *, {full('quantile_cont(dollar_volume, 0.5)', 'dollar_volume', 60)} AS liquidity FROM panel)""",
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY liquidity DESC, asset) AS liquidity_rank
  FROM liq WHERE liquidity IS NOT NULL) WHERE liquidity_rank <= 15""")
def u06(spark, sf):
    return universe.liquid_universe(v.panel(spark, sf, "brand"), 60, 15)


@query("u07_available_top_n", "country asset:i date:d market_cap_rank:i pick:i", PIT,
       f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY market_cap_rank, asset) AS pick
  FROM members WHERE complete AND market_cap_rank <= {2 * TOP}) WHERE pick <= {TOP}""")
def u07(spark, sf):
    return universe.available_top_n(members(spark, sf), complete(), 2 * TOP, TOP)


@query("u08_full_cross_section", "country asset:i date:d n_assets:i", PIT + f""",
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY market_cap_rank, asset) AS pick
  FROM members WHERE complete) WHERE pick <= {TOP})""",
       f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, date) AS n_assets FROM picked)
  WHERE n_assets = {TOP}""")
def u08(spark, sf):
    return universe.full_dates(universe.available_top_n(members(spark, sf), complete(), None, TOP), TOP)


def _pure(spark, sf):
    return universe.pure_top_n(members(spark, sf), complete(), TOP)


@query("u09_pure_top_n_all", "country asset:i date:d market_cap_rank:i complete:b", PIT,
       f"SELECT * FROM members WHERE market_cap_rank <= {TOP}")
def u09_all(spark, sf):
    return _pure(spark, sf)["all"]


@query("u09_pure_top_n_complete", "country asset:i date:d market_cap_rank:i", PIT,
       f"SELECT * FROM members WHERE market_cap_rank <= {TOP} AND complete")
def u09_complete(spark, sf):
    return _pure(spark, sf)["complete"]


@query("u09_pure_top_n_full", "country asset:i date:d market_cap_rank:i", PIT,
       f"""SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY country, date) AS n FROM members
  WHERE market_cap_rank <= {TOP} AND complete) WHERE n = {TOP}""")
def u09_full(spark, sf):
    return _pure(spark, sf)["full"]


@query("u10_investable", "country asset:i date:d feature_eligible:b risk_eligible:b investable:b", PIT,
       """SELECT *, complete AS feature_eligible, risk AS risk_eligible, complete AND risk AS investable FROM (
  SELECT *, coalesce(session_id - lag(session_id, 4) OVER (PARTITION BY country, asset ORDER BY session_id) = 4, FALSE)
  AS risk FROM members)""")
def u10(spark, sf):
    m = members(spark, sf).withColumn("risk_eligible", features.risk_history(4)).withColumn("feature_eligible", complete())
    return m.withColumn("investable", F.col("risk_eligible") & F.col("feature_eligible"))


@query("u11_variable_n", "country asset:i date:d n_assets:i", PIT,
       "SELECT *, count(*) OVER (PARTITION BY country, date) AS n_assets FROM members WHERE complete")
def u11(spark, sf):
    return universe.cross_section_size(members(spark, sf).where(complete()))


@query("u12_presence_ledger", "country asset:i first_snapshot:d last_snapshot:d months_observed:i last_market_cap:f2",
       v.SUPPLIER_COUNTRY.strip() + "," + v.CAPS_SUP_SQL,
       """SELECT country, asset, min(snapshot_date) AS first_snapshot, max(snapshot_date) AS last_snapshot,
  count(DISTINCT date_trunc('month', snapshot_date)) AS months_observed, arg_max(market_cap, snapshot_date) AS last_market_cap
  FROM caps GROUP BY 1, 2""")
def u12(spark, sf):
    return universe.presence(v.caps(spark, sf, "sup"), "market_cap")


@query("u13_universe_churn", "country date:d continuing:i entered:i exited:i", PIT + f""",
m AS (SELECT country, asset, date, dense_rank() OVER (PARTITION BY country ORDER BY date) AS step FROM members
  WHERE market_cap_rank <= {TOP} AND complete),
j AS (SELECT coalesce(a.country, b.country) AS country, coalesce(a.step, b.step + 1) AS step, a.asset AS now, b.asset AS before
  FROM m a FULL JOIN m b ON a.country = b.country AND a.asset = b.asset AND a.step = b.step + 1)""",
       """SELECT country, date, count_if(now IS NOT NULL AND before IS NOT NULL) AS continuing,
  count_if(before IS NULL) AS entered, count_if(now IS NULL) AS exited
  FROM j JOIN (SELECT DISTINCT country, step, date FROM m) USING (country, step) GROUP BY 1, 2""")
def u13(spark, sf):
    m = _pure(spark, sf)["complete"].select("country", "asset", "date")
    return universe.churn(m, m.select("country", "date").distinct())


@query("u14_weekly_extract", "country date:d asset:i market_cap_rank:i split target_status",
       v.panel_sql("sup", rf=True) + "," + v.CAPS_SUP_SQL + "," + UNI + "," + forward_sql(1, 5) + "," + WEEKLY,
       f"""SELECT f.country, f.date, f.asset, market_cap_rank, {SPLIT_SQL.format(d='f.date')} AS split,
  CASE WHEN target IS NOT NULL AND execution_date IS NOT NULL THEN 'available' ELSE 'missing_exact_sessions' END AS target_status
  FROM fwd f JOIN weekly w ON w.country = f.country AND w.date = f.date AND is_weekly_signal
  JOIN uni u ON u.country = f.country AND u.asset = f.asset AND u.universe_month = date_trunc('month', f.date)
  WHERE u.eligible""")
def u14(spark, sf):
    from tessera.operators import labels

    signals = cal.weekly_signal(v.calendar(spark, sf, "sup")).where("is_weekly_signal").select("country", "date")
    rows = labels.availability(labelled(spark, sf)).join(F.broadcast(signals), ["country", "date"], "left_semi")
    rows = universe.point_in_time(rows, uni_sup(spark, sf))
    return rows.withColumn("split", clean.split_by_date("date", FOLDS, "outside"))


def void_after_zero(sql: str) -> str:
    """The panel's statement with the query's rule for a price of zero: the return after it is unknown, not infinite."""
    lag = "lag(close) OVER (PARTITION BY b.country, asset ORDER BY session_id)"
    return sql.replace(f"close / {lag}", f"close / nullif({lag}, 0)")


@query("flagship_liquidity_momentum", "bucket:i n_dates:i n_rows:i mean_momentum:f mean_target_bps:f4",
       void_after_zero(v.panel_sql("user", rf=True)) + "," + forward_sql(1, 5) + f""",
p AS (SELECT *, {full('product(1 + ret)', 'ret', 3)} - 1 AS momentum,
  {full('quantile_cont(dollar_volume, 0.5)', 'dollar_volume', 3)} AS liquidity FROM fwd),
picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, date ORDER BY liquidity DESC, asset) AS rn
  FROM p WHERE liquidity IS NOT NULL) WHERE rn <= 100 AND momentum IS NOT NULL AND target IS NOT NULL),
b AS (SELECT *, ntile(10) OVER (PARTITION BY country, date ORDER BY round(momentum, 9), asset) AS bucket,
  count(*) OVER (PARTITION BY country, date) AS n FROM picked)""",
       """SELECT bucket, count(DISTINCT date) AS n_dates, count(*) AS n_rows, avg(momentum) AS mean_momentum,
  avg(target) AS mean_target_bps FROM b WHERE n >= 10 GROUP BY 1""")
def flag(spark, sf):
    return flagship.liquidity_momentum(spark, sf)
