"""Queries K01-K10: calendars and time alignment."""

from pyspark.sql import functions as F

from tessera.functions.expr import by_asset
from tessera.operators import calendar as cal
from tessera.plans import views as v
from tessera.plans.registry import query


@query("k01_global_calendar", "date:d session_id:i",
       sql="""SELECT date, row_number() OVER (ORDER BY date) - 1 AS session_id
  FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events)""")
def k01(spark, sf):
    return cal.session_calendar(v._sessions(spark, sf, "user"), by_country=False)


@query("k02_country_calendar", "country date:d session_id:i", v.calendar_sql("sup"), "SELECT * FROM calendar")
def k02(spark, sf):
    return v.calendar(spark, sf, "sup")


WEEKLY = """
weekly AS (SELECT *, date = max(date) OVER (PARTITION BY country, week) AS is_weekly_signal FROM
  (SELECT *, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week FROM calendar))"""


@query("k03_weekly_signal", "country date:d session_id:i week:d is_weekly_signal:b",
       v.calendar_sql("user") + "," + WEEKLY, "SELECT * FROM weekly")
def k03(spark, sf):
    return cal.weekly_signal(v.calendar(spark, sf, "user"))


@query("k04_month_end_sessions", "country month:d date:d", v.calendar_sql("sup"),
       "SELECT country, date_trunc('month', date) AS month, max(date) AS date FROM calendar GROUP BY ALL")
def k04(spark, sf):
    return cal.month_end_sessions(v.calendar(spark, sf, "sup"))


GRID = """
life AS (SELECT country, asset, min(session_id) AS s0, max(session_id) AS s1 FROM panel GROUP BY 1, 2),
grid AS (SELECT l.country, l.asset, c.session_id, c.date, p.close, p.volume, p.high, p.low, p.open,
  p.close IS NOT NULL AS observed
  FROM life l JOIN calendar c ON c.country = l.country AND c.session_id BETWEEN {lo} AND {hi}
  LEFT JOIN panel p ON p.country = l.country AND p.asset = l.asset AND p.session_id = c.session_id)"""
GRID_LISTED = GRID.format(lo="l.s0", hi="l.s1")
GRID_ALL = GRID.format(lo="0", hi="1000000")


@query("k05_densify_all", "country asset:i session_id:i date:d close:f observed:b",
       v.panel_sql("sup") + "," + GRID_ALL, "SELECT * FROM grid")
def k05_all(spark, sf):
    return cal.densify(v.panel(spark, sf, "sup"), v.calendar(spark, sf, "sup"), ["close"], span="all")


@query("k05_densify_listed", "country asset:i session_id:i date:d close:f observed:b",
       v.panel_sql("user") + "," + GRID_LISTED, "SELECT * FROM grid")
def k05_listed(spark, sf):
    return cal.densify(v.panel(spark, sf, "user"), v.calendar(spark, sf, "user"), ["close"])


@query("k06_fill_rate", "country date:d session_id:i rf_daily:f9 rf_known:b", v.cash_sql("sup"), "SELECT * FROM cash")
def k06(spark, sf):
    return v.cash_calendar(spark, sf, "sup")


@query("k07_session_offset", "country session_id:i date:d entry_date:d exit_date:d", v.calendar_sql("sup"),
       """SELECT c.country, c.session_id, c.date, e.date AS entry_date, x.date AS exit_date FROM calendar c
  LEFT JOIN calendar e ON e.country = c.country AND e.session_id = c.session_id + 1
  LEFT JOIN calendar x ON x.country = c.country AND x.session_id = c.session_id + 6""")
def k07(spark, sf):
    c = v.calendar(spark, sf, "sup")
    return cal.session_offset(c, c, 1, 5)


@query("k08_execution_date", "country asset:i date:d execution_date:d", v.panel_sql("sup"),
       """SELECT country, asset, date, CASE WHEN lead(session_id) OVER w = session_id + 1 THEN lead(date) OVER w END
  AS execution_date FROM panel WINDOW w AS (PARTITION BY country, asset ORDER BY session_id)""")
def k08(spark, sf):
    return v.panel(spark, sf, "sup").withColumn("execution_date", cal.date_ahead(1, by_asset()))


@query("k09_calendar_flags", "country date:d day_of_week:i is_month_end:i is_quarter_end:i", v.calendar_sql("user"),
       """SELECT country, date, isodow(date) - 1 AS day_of_week, CAST(last_day(date) = date AS INT) AS is_month_end,
  CAST(last_day(date) = date AND month(date) IN (3, 6, 9, 12) AS INT) AS is_quarter_end FROM calendar""")
def k09(spark, sf):
    return cal.calendar_flags(v.calendar(spark, sf, "user"))


@query("k10_quarter_key", "country date:d quarter", v.calendar_sql("sup"),
       "SELECT country, date, year(date) || 'Q' || quarter(date) AS quarter FROM calendar")
def k10(spark, sf):
    return v.calendar(spark, sf, "sup").withColumn("quarter", cal.quarter_key("date"))


@query("k11_weekly_signal_rows", "country asset:i date:d close:f", v.panel_sql("user") + "," + WEEKLY,
       "SELECT p.* FROM panel p JOIN weekly w USING (country, date) WHERE is_weekly_signal")
def k11(spark, sf):
    """Panel restricted to signal sessions by a semi join."""
    signals = cal.weekly_signal(v.calendar(spark, sf, "user")).where("is_weekly_signal")
    return v.panel(spark, sf, "user").join(F.broadcast(signals), ["country", "date"], "left_semi")
