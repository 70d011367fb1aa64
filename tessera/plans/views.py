"""Panel views over the star-schema tables, in Spark and as SQL.

``bars`` turns ticks into one row per (country, asset, session).  Partial
aggregation runs before any shuffle, so a hot asset costs no more than its
number of sessions; from then on an asset holds at most one row per session.
Calendars are bounded by elapsed time (one row per country and day at most),
which is what makes broadcasting them safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions.expr import by_asset, safe_div
from tessera.operators import calendar as cal

MAX_ORDER = 2**41  # order keys below 2 * 10**12
UNITS, MAX_WHOLE = 1e9, 2.0**53  # from there on doubles have no rests


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """One table; its footer is read for the schema only once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def week_start(c: str) -> F.Column:
    d = F.to_date(c)
    return F.date_sub(d, F.weekday(d))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))


def supplier_country(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "supplier")
        .join(_regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("asset"), F.col("r_name").alias("country"))
    )


def _ticks(li: DataFrame, asset: str) -> DataFrame:
    price = F.col("l_extendedprice") / F.col("l_quantity")
    cents = F.floor(price * 100)
    day = F.weekday(F.to_date("l_shipdate")).cast("bigint")
    key = (day * MAX_ORDER + F.col("l_orderkey")) * 8 + F.col("l_linenumber")
    return li.select(
        F.col(asset).alias("asset"),
        week_start("l_shipdate").alias("date"),
        (key * 65536 + cents % 65536).alias("k"),
        price.alias("price"),
        F.col("l_quantity").alias("qty"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
    )


def _exact_sum(c: str) -> F.Column:
    """Sum that does not depend on the order of rows: of whole numbers, which doubles add exactly, and of the rests in units of 1e-9."""
    rest = F.when(F.abs(c) < MAX_WHOLE, F.rint((F.col(c) - F.rint(c)) * UNITS).cast("bigint")).otherwise(0)
    return F.sum(F.rint(c)) + F.sum(rest) / F.lit(UNITS)


def _exact_mean(c: str) -> F.Column:
    return F.try_divide(_exact_sum(c), F.count(c))


def _bars(ticks: DataFrame) -> DataFrame:
    quoted = F.col("n") > 1
    return (
        ticks.groupBy("asset", "date")
        .agg(
            F.min_by("price", "k").alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", "k").alias("close"),
            _exact_sum("qty").alias("volume"),
            _exact_mean("discount").alias("d"),
            _exact_mean("tax").alias("t"),
            F.count(F.lit(1)).alias("n"),
        )
        .withColumn("bid", F.when(quoted, F.col("close") * (1 - F.col("d") / 10)))
        .withColumn("ask", F.when(quoted, F.col("close") * (1 + F.col("t") / 10)))
        .drop("d", "t", "n")
    )


def bars_sup(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per supplier; country is the supplier's region."""
    bars = _bars(_ticks(table(spark, sf, "lineitem"), "l_suppkey"))
    return bars.join(supplier_country(spark, sf), "asset")


def bars_brand(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly bars per brand, one market."""
    li = table(spark, sf, "lineitem").join(
        table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")
    )
    return _bars(_ticks(li, "p_brand")).withColumn("country", F.lit("ALL"))


def bars_user(spark: SparkSession, sf: str) -> DataFrame:
    """Daily bars per user of the event stream, one market."""
    e = table(spark, sf, "events")
    when = F.struct("ts", "event_id")
    several = F.col("volume") > 1
    return (
        e.groupBy(F.col("user_id").alias("asset"), F.to_date("ts").alias("date"))
        .agg(
            F.min_by("value", when).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", when).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
        .withColumn("bid", F.when(several, F.col("close") * 0.999))
        .withColumn("ask", F.when(several, F.col("close") * 1.001))
        .withColumn("country", F.lit("ALL"))
    )


BARS = {"sup": bars_sup, "brand": bars_brand, "user": bars_user}


def bars(spark: SparkSession, sf: str, view: str) -> DataFrame:
    return BARS[view](spark, sf)


def _sessions(spark: SparkSession, sf: str, view: str) -> DataFrame:
    """Distinct (country, date) without building bars."""
    if view == "user":
        e = table(spark, sf, "events")
        return e.select(F.lit("ALL").alias("country"), F.to_date("ts").alias("date")).distinct()
    li = table(spark, sf, "lineitem")
    if view == "brand":
        return li.select(F.lit("ALL").alias("country"), week_start("l_shipdate").alias("date")).distinct()
    # lines meet the supplier only, so they shrink to one row per nation and week before any exchange
    home = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    seen = li.join(home, F.col("l_suppkey") == F.col("s_suppkey")).select("s_nationkey", week_start("l_shipdate").alias("date")).distinct()
    return seen.join(_regions(spark, sf), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("r_name").alias("country"), "date").distinct()


def calendar(spark: SparkSession, sf: str, view: str) -> DataFrame:
    return cal.session_calendar(_sessions(spark, sf, view), by_country=True)


def cash_rate(spark: SparkSession, sf: str, view: str) -> DataFrame:
    """Annual percentage per session from activity counts; every eleventh is missing."""
    if view == "user":
        counts = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date"))
    else:
        counts = table(spark, sf, "orders").groupBy(week_start("o_orderdate").alias("date"))
    rate = counts.agg((1 + F.count(F.lit(1)) % 5).cast("double").alias("annual_pct"))
    return (
        calendar(spark, sf, view)
        .where(F.col("session_id") % 11 != 0)
        .join(rate, "date")
        .select("country", "date", "annual_pct")
    )


def cash_calendar(spark: SparkSession, sf: str, view: str) -> DataFrame:
    rate = cash_rate(spark, sf, view).select("country", "date", cal.daily_simple_rate("annual_pct").alias("rf_daily"))
    return cal.fill_rate(calendar(spark, sf, view), rate)


def panel(spark: SparkSession, sf: str, view: str, rf: bool = False) -> DataFrame:
    """Bars with session ids, simple returns, dollar volume and quoted spread."""
    grid = cash_calendar(spark, sf, view) if rf else calendar(spark, sf, view)
    cols = ["country", "date", "session_id"] + (["rf_daily", "rf_known"] if rf else [])
    w = by_asset()
    mid = (F.col("bid") + F.col("ask")) / 2
    return (
        bars(spark, sf, view)
        .join(F.broadcast(grid.select(*cols)), ["country", "date"])
        .withColumn("ret", safe_div("close", F.lag("close").over(w)) - 1)
        .withColumn("dollar_volume", F.col("close") * F.col("volume"))
        .withColumn(
            "spread_bps",
            F.when((F.col("bid") >= 0) & (F.col("ask") >= F.col("bid")) & (mid > 0),
                   safe_div(F.col("ask") - F.col("bid"), mid) * 10000),
        )
    )


def caps(spark: SparkSession, sf: str, view: str) -> DataFrame:
    """Size snapshots: traded value per asset and month, dated at month end."""
    if view == "user":
        src = table(spark, sf, "events").select(
            F.col("user_id").alias("asset"), F.to_date("ts").alias("d"), F.col("value").alias("v"))
        stamp = F.date_add(F.date_sub("d", F.weekday("d")), 6)
    else:
        src = table(spark, sf, "lineitem").select(
            F.col("l_suppkey").alias("asset"), F.to_date("l_shipdate").alias("d"), F.col("l_extendedprice").alias("v"))
        stamp = F.last_day("d")
    out = src.groupBy("asset", stamp.alias("snapshot_date")).agg(F.round(F.sum("v"), 2).alias("market_cap"))
    if view == "user":
        return out.withColumn("country", F.lit("ALL"))
    return out.join(supplier_country(spark, sf), "asset")


# --- the same views as common table expressions ----------------------------

_WEEK = "(CAST({0} AS DATE) - CAST(isodow({0}) - 1 AS INTEGER))"


def _week(c: str) -> str:
    return _WEEK.format(c)


_TICKS = """
{name}_ticks AS (SELECT {asset} AS asset, {week} AS date,
  l_extendedprice / l_quantity AS price,
  (((isodow(l_shipdate) - 1) * 2199023255552 + l_orderkey) * 8 + l_linenumber) * 65536
    + CAST(floor(l_extendedprice / l_quantity * 100) AS BIGINT) % 65536 AS k,
  l_quantity AS qty, l_discount AS discount, l_tax AS tax FROM {source}),
{name}_agg AS (SELECT asset, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
  arg_max(price, k) AS close, sum(qty) AS volume, avg(discount) AS d, avg(tax) AS t, count(*) AS n
  FROM {name}_ticks GROUP BY asset, date)"""

_QUOTE = ("CASE WHEN n > 1 THEN close * (1 - d / 10) END AS bid, "
          "CASE WHEN n > 1 THEN close * (1 + t / 10) END AS ask")

SUPPLIER_COUNTRY = """
supplier_country AS (SELECT s_suppkey AS asset, r_name AS country FROM supplier
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

_BARS_SQL = {
    "sup": SUPPLIER_COUNTRY + ","
    + _TICKS.format(name="sup", asset="l_suppkey", week=_week("l_shipdate"), source="lineitem") + f""",
bars AS (SELECT country, asset, date, open, high, low, close, volume, {_QUOTE}
  FROM sup_agg JOIN supplier_country USING (asset))""",
    "brand": _TICKS.format(name="brand", asset="p_brand", week=_week("l_shipdate"),
                           source="lineitem JOIN part ON l_partkey = p_partkey") + f""",
bars AS (SELECT 'ALL' AS country, asset, date, open, high, low, close, volume, {_QUOTE} FROM brand_agg)""",
    "user": """
user_agg AS (SELECT user_id AS asset, CAST(ts AS DATE) AS date,
  arg_min(value, ROW(ts, event_id)) AS open, max(value) AS high, min(value) AS low,
  arg_max(value, ROW(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2),
bars AS (SELECT 'ALL' AS country, asset, date, open, high, low, close, volume,
  CASE WHEN volume > 1 THEN close * 0.999 END AS bid,
  CASE WHEN volume > 1 THEN close * 1.001 END AS ask FROM user_agg)""",
}

_CAL_SQL = """
calendar AS (SELECT country, date, row_number() OVER (PARTITION BY country ORDER BY date) - 1 AS session_id
  FROM (SELECT DISTINCT country, date FROM bars))"""

_RATE_SQL = {
    "user": "SELECT CAST(ts AS DATE) AS date, 1 + count(*) % 5 AS annual_pct FROM events GROUP BY 1",
    "sup": f"SELECT {_week('o_orderdate')} AS date, 1 + count(*) % 5 AS annual_pct FROM orders GROUP BY 1",
}
_RATE_SQL["brand"] = _RATE_SQL["sup"]


def bars_sql(view: str) -> str:
    return _BARS_SQL[view]


def calendar_sql(view: str) -> str:
    return _BARS_SQL[view] + "," + _CAL_SQL


def cash_sql(view: str) -> str:
    return calendar_sql(view) + f""",
rate AS ({_RATE_SQL[view]}),
cash_rate AS (SELECT country, date, CAST(annual_pct AS DOUBLE) AS annual_pct FROM calendar JOIN rate USING (date)
  WHERE session_id % 11 <> 0),
cash_filled AS (SELECT country, date, session_id,
  last_value(rf IGNORE NULLS) OVER (PARTITION BY country ORDER BY date ROWS UNBOUNDED PRECEDING) AS f
  FROM calendar LEFT JOIN (SELECT country, date, pow(1 + annual_pct / 100, 1.0 / 365) - 1 AS rf FROM cash_rate)
  USING (country, date)),
cash AS (SELECT country, date, session_id, coalesce(f, 0) AS rf_daily, f IS NOT NULL AS rf_known FROM cash_filled)"""


def panel_sql(view: str, rf: bool = False) -> str:
    base = cash_sql(view) if rf else calendar_sql(view)
    grid, extra = ("cash", "rf_daily, rf_known,") if rf else ("calendar", "")
    return base + f""",
panel AS (SELECT b.country, b.asset, b.date, session_id, {extra} open, high, low, close, volume, bid, ask,
  close / lag(close) OVER (PARTITION BY b.country, asset ORDER BY session_id) - 1 AS ret,
  close * volume AS dollar_volume,
  CASE WHEN bid >= 0 AND ask >= bid AND (bid + ask) / 2 > 0 THEN (ask - bid) / ((bid + ask) / 2) * 10000 END AS spread_bps
  FROM bars b JOIN {grid} c ON b.country = c.country AND b.date = c.date)"""


CAPS_SUP_SQL = """
caps AS (SELECT country, asset, snapshot_date, market_cap FROM (
  SELECT l_suppkey AS asset, last_day(CAST(l_shipdate AS DATE)) AS snapshot_date,
    round(sum(l_extendedprice), 2) AS market_cap FROM lineitem GROUP BY 1, 2)
  JOIN supplier_country USING (asset))"""
CAPS_USER_SQL = """
caps AS (SELECT 'ALL' AS country, user_id AS asset, CAST(ts AS DATE) - CAST(isodow(ts) - 1 AS INTEGER) + 6 AS snapshot_date,
  round(sum(value), 2) AS market_cap FROM events GROUP BY 1, 2, 3)"""
