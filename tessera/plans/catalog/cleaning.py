"""Queries C01-C19: cleaning, projection and filters."""

from pyspark.sql import functions as F

from tessera import schema
from tessera.operators import calendar as cal
from tessera.operators import clean
from tessera.plans import views as v
from tessera.plans.registry import query

TZ = "Asia/Bangkok"
FOLDS = [("train", "1995-01-01", "1997-12-31"), ("validation", "1998-01-01", "1998-12-31"),
         ("test", "1999-01-01", "2001-12-31")]
SPLIT_SQL = """CASE WHEN {d} BETWEEN DATE '1995-01-01' AND DATE '1997-12-31' THEN 'train'
  WHEN {d} BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' THEN 'validation'
  WHEN {d} BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' THEN 'test' ELSE 'outside' END"""


@query("c01_local_date", "event_id:i local_date:d",
       sql="SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS local_date FROM events")
def c01(spark, sf):
    return v.table(spark, sf, "events").select("event_id", clean.local_date("ts", TZ).alias("local_date"))


@query("c02_numeric_coercion", "event_id:i k_number:f url_number:f",
       sql="""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k_number,
  TRY_CAST(event_type AS DOUBLE) AS url_number FROM events""")
def c02(spark, sf):
    return v.table(spark, sf, "events").select(
        "event_id", clean.numeric(F.get_json_object("props", "$.k")).alias("k_number"),
        clean.numeric("event_type").alias("url_number"))


@query("c03_clean_ids", "p_name",
       sql="""SELECT DISTINCT upper(trim(p_name)) AS p_name FROM (
  SELECT split_part(p_name, ' ', 1) AS p_name FROM part UNION ALL SELECT p_name FROM part)
  WHERE regexp_full_match(upper(trim(p_name)), '[A-Z0-9]{2,10}')""")
def c03(spark, sf):
    p = v.table(spark, sf, "part")
    both = p.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("p_name")).unionAll(p.select("p_name"))
    return clean.clean_ids(both, "p_name")


@query("c04_share_type_filter", "c_custkey:i code c_mktsegment",
       sql="""SELECT * FROM (SELECT c_custkey, c_mktsegment,
  CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END || '.' || c_nationkey AS code FROM customer)
  WHERE contains(lower(c_mktsegment), 'building') AND NOT regexp_matches(split_part(code, '.', 1), '[a-z]')""")
def c04(spark, sf):
    seg = F.col("c_mktsegment")
    code = F.concat(F.when(F.col("c_custkey") % 3 == 0, F.lower(seg)).otherwise(seg), F.lit("."), F.col("c_nationkey"))
    return clean.ordinary_shares(
        v.table(spark, sf, "customer").withColumn("code", code), "c_mktsegment", "code", wording="building")


def _extracts(spark, sf):
    """Bars plus later corrections of every thirteenth session."""
    p = v.panel(spark, sf, "sup").select("country", "asset", "date", "session_id", "close")
    again = p.where(F.col("session_id") % 13 == 0).select(
        "country", "asset", "date", "session_id", (F.col("close") * 1.01).alias("close"))
    return p.withColumn("extracted", F.lit(1)).unionByName(again.withColumn("extracted", F.lit(2)))


_EXTRACTS = v.panel_sql("sup") + """,
extracts AS (SELECT country, asset, date, session_id, close, 1 AS extracted FROM panel UNION ALL
  SELECT country, asset, date, session_id, close * 1.01, 2 FROM panel WHERE session_id % 13 = 0)"""


@query("c05_dedupe_keep_last", "country asset:i date:d close:f extracted:i", _EXTRACTS,
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, asset, date ORDER BY extracted DESC) AS rn
  FROM extracts) WHERE rn = 1""")
def c05(spark, sf):
    return clean.keep_last(_extracts(spark, sf), ["country", "asset", "date"], ["extracted"])


@query("c06_dedupe_keep_first", "country asset:i date:d close:f extracted:i", _EXTRACTS,
       """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country, asset, date ORDER BY extracted) AS rn
  FROM extracts) WHERE rn = 1""")
def c06(spark, sf):
    return clean.keep_first(_extracts(spark, sf), ["country", "asset", "date"], ["extracted"])


@query("c07_valid_bars", "country asset:i date:d strict:b loose:b", v.panel_sql("sup") + """,
holes AS (SELECT country, asset, date, CASE WHEN session_id % 5 <> 0 THEN open END AS open, high, low, close,
  CASE WHEN session_id % 7 <> 0 THEN volume END AS volume FROM panel)""",
       """SELECT country, asset, date,
  open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL
    AND close > 0 AND volume >= 0 AS strict,
  close IS NOT NULL AND volume IS NOT NULL AND close > 0 AND volume >= 0 AS loose FROM holes""")
def c07(spark, sf):
    p = v.panel(spark, sf, "sup")
    p = p.withColumn("open", F.when(F.col("session_id") % 5 != 0, F.col("open"))).withColumn(
        "volume", F.when(F.col("session_id") % 7 != 0, F.col("volume")))
    return p.select("country", "asset", "date", clean.valid_bar().alias("strict"),
                    clean.valid_bar(strict=False).alias("loose"))


@query("c08_return_with_source", "country asset:i date:d return:f return_source", v.panel_sql("sup") + """,
quoted AS (SELECT *, CASE WHEN session_id % 7 <> 0 THEN 100 * ret END AS total_return_pct FROM panel)""",
       """SELECT country, asset, date, coalesce(total_return_pct / 100, ret) AS return,
  CASE WHEN total_return_pct IS NOT NULL THEN 'total_return' WHEN ret IS NOT NULL THEN 'price' ELSE 'missing' END
  AS return_source FROM quoted""")
def c08(spark, sf):
    p = v.panel(spark, sf, "sup")
    p = p.withColumn("total_return_pct", F.when(F.col("session_id") % 7 != 0, 100 * F.col("ret")))
    return clean.returns_with_source(p)


@query("c09_quotes", "country asset:i date:d quote_valid:b mid:f quoted_spread:f quoted_spread_bps:f4",
       v.bars_sql("sup"),
       """SELECT country, asset, date, ok AS quote_valid, CASE WHEN ok THEN m END AS mid,
  CASE WHEN ok THEN (ask - bid) / m END AS quoted_spread, CASE WHEN ok THEN (ask - bid) / m * 10000 END AS quoted_spread_bps
  FROM (SELECT *, (bid + ask) / 2 AS m, coalesce(bid >= 0 AND bid <= ask AND (bid + ask) / 2 > 0, FALSE) AS ok FROM bars)""")
def c09(spark, sf):
    return clean.quotes(v.bars(spark, sf, "sup"))


@query("c10_dollar_volume", "country asset:i date:d dollar_volume:f3", v.bars_sql("sup"),
       "SELECT country, asset, date, close * volume AS dollar_volume FROM bars")
def c10(spark, sf):
    return v.bars(spark, sf, "sup").withColumn("dollar_volume", F.col("close") * F.col("volume"))


@query("c11_daily_rate", "country date:d rf_daily:f9", v.cash_sql("sup"),
       "SELECT country, date, pow(1 + annual_pct / 100, 1.0 / 365) - 1 AS rf_daily FROM cash_rate")
def c11(spark, sf):
    return v.cash_rate(spark, sf, "sup").withColumn("rf_daily", cal.daily_simple_rate("annual_pct"))


@query("c12_rate_coverage_gaps", "country date:d", v.cash_sql("sup"),
       """SELECT country, date FROM calendar c WHERE NOT EXISTS
  (SELECT 1 FROM cash_rate r WHERE r.country = c.country AND r.date = c.date)""")
def c12(spark, sf):
    return clean.missing_dates(v.calendar(spark, sf, "sup"), v.cash_rate(spark, sf, "sup"), ["country", "date"])


def _two_sides(spark, sf):
    p = v.panel(spark, sf, "sup")
    keys = ["country", "asset", "date"]
    return (p.where(F.col("session_id") % 4 != 0).select(*keys, "close"),
            p.where(F.col("session_id") % 3 != 0).select(*keys, "ret"))


_SIDES = v.panel_sql("sup") + """,
px AS (SELECT country, asset, date, close FROM panel WHERE session_id % 4 <> 0),
rt AS (SELECT country, asset, date, ret FROM panel WHERE session_id % 3 <> 0)"""


@query("c13_combine_left", "country asset:i date:d close:f ret:f", _SIDES,
       "SELECT country, asset, date, close, ret FROM px LEFT JOIN rt USING (country, asset, date)")
def c13_left(spark, sf):
    return clean.combine(*_two_sides(spark, sf), ["country", "asset", "date"], "left")


@query("c13_combine_full", "country asset:i date:d close:f ret:f", _SIDES,
       "SELECT country, asset, date, close, ret FROM px FULL JOIN rt USING (country, asset, date)")
def c13_full(spark, sf):
    return clean.combine(*_two_sides(spark, sf), ["country", "asset", "date"], "full")


@query("c14_duplicate_keys", "l_orderkey:i l_linenumber:i n_rows:i",
       sql="""SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def c14(spark, sf):
    return schema.duplicate_keys(v.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("c15_required_columns", "column_name present:b non_null:i", v.bars_sql("sup"),
       """SELECT 'asset' AS column_name, TRUE AS present, count(asset) AS non_null FROM bars
  UNION ALL SELECT 'close', TRUE, count(close) FROM bars UNION ALL SELECT 'bid', TRUE, count(bid) FROM bars
  UNION ALL SELECT 'isin', FALSE, 0""")
def c15(spark, sf):
    return schema.column_report(v.bars(spark, sf, "sup"), ["asset", "close", "bid", "isin"]).withColumnRenamed(
        "column", "column_name")


@query("c16_date_range", "country asset:i date:d close:f", v.bars_sql("sup"),
       "SELECT * FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'")
def c16(spark, sf):
    return v.bars(spark, sf, "sup").where(
        F.col("date").between(F.to_date(F.lit("1996-01-01")), F.to_date(F.lit("1999-12-31"))))


@query("c17_exchange_map", "c_custkey:i exchange",
       sql="""SELECT c_custkey, coalesce(exchange, 'UNKNOWN') AS exchange FROM customer LEFT JOIN
  (SELECT n_nationkey, n_name AS exchange FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey""")
def c17(spark, sf):
    lookup = v.table(spark, sf, "nation").where("n_regionkey < 3").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("exchange"))
    return clean.map_with_default(v.table(spark, sf, "customer"), lookup, "c_nationkey", "exchange", "UNKNOWN")


@query("c18_split_label", "country asset:i date:d split", v.bars_sql("sup"),
       f"SELECT country, asset, date, {SPLIT_SQL.format(d='date')} AS split FROM bars")
def c18(spark, sf):
    return v.bars(spark, sf, "sup").withColumn("split", clean.split_by_date("date", FOLDS, "outside"))


@query("c19_split_label_span", "country session_id:i date:d exit_date:d split", v.calendar_sql("sup"),
       """SELECT *, CASE WHEN date >= DATE '1995-01-01' AND exit_date <= DATE '1997-12-31' THEN 'train'
  WHEN date >= DATE '1998-01-01' AND exit_date <= DATE '1998-12-31' THEN 'validation'
  WHEN date >= DATE '1999-01-01' AND exit_date <= DATE '2001-12-31' THEN 'test' ELSE 'outside' END AS split
  FROM (SELECT c.country, c.session_id, c.date, x.date AS exit_date FROM calendar c LEFT JOIN calendar x
    ON x.country = c.country AND x.session_id = c.session_id + 6)""")
def c19(spark, sf):
    c = v.calendar(spark, sf, "sup")
    return cal.session_offset(c, c, 1, 5).withColumn(
        "split", clean.split_by_span("date", "exit_date", FOLDS, "outside"))
