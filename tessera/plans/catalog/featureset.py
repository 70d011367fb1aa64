"""Queries F01-F16, F24, F26 and L01-L09."""

from pyspark.sql import functions as F

from tessera.operators import calendar as cal
from tessera.operators import clean, features, labels
from tessera.plans import views as v
from tessera.plans.catalog.calendars import GRID_LISTED
from tessera.plans.catalog.cleaning import FOLDS, SPLIT_SQL
from tessera.plans.registry import query

W_SQL = "WINDOW w AS (PARTITION BY country, asset ORDER BY session_id)"


def frame(n: int, last: int = 0) -> str:
    return f"(PARTITION BY country, asset ORDER BY session_id ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(n)} = {n} THEN {agg} OVER {frame(n)} END"


def _grid(spark, sf, view):
    p = v.panel(spark, sf, view)
    return cal.densify(p, v.calendar(spark, sf, view), ["open", "high", "low", "close", "volume"])


_GRID = v.panel_sql("sup") + "," + GRID_LISTED


@query("f01_session_returns", "country asset:i session_id:i return_1s:f return_5s:f", _GRID,
       f"""SELECT *, close / lag(close) OVER w - 1 AS return_1s, close / lag(close, 5) OVER w - 1 AS return_5s
  FROM grid {W_SQL}""")
def f01(spark, sf):
    return features.session_returns(_grid(spark, sf, "sup"), (1, 5))


@query("f02_rolling_compounded_return",
       "country asset date:d return_5:f return_10:f return_20:f return_60:f continuous_60:b", v.panel_sql("brand"),
       f"""SELECT country, asset, date, r5 AS return_5, r10 AS return_10, r20 AS return_20,
  CASE WHEN c THEN r60 END AS return_60, c AS continuous_60 FROM (SELECT *,
  {full('product(1 + ret)', 'ret', 5)} - 1 AS r5, {full('product(1 + ret)', 'ret', 10)} - 1 AS r10,
  {full('product(1 + ret)', 'ret', 20)} - 1 AS r20, {full('product(1 + ret)', 'ret', 60)} - 1 AS r60,
  coalesce(session_id - lag(session_id, 60) OVER w = 60, FALSE) AS c FROM panel {W_SQL})""")
def f02(spark, sf):
    return features.rolling_features(v.panel(spark, sf, "brand"))


@query("f02_compounded_return_gaps", "country asset:i date:d return_3:f return_5:f return_8:f continuous_8:b",
       v.panel_sql("sup"),
       f"""SELECT country, asset, date, r3 AS return_3, r5 AS return_5, CASE WHEN c THEN r8 END AS return_8, c AS continuous_8
  FROM (SELECT *, {full('product(1 + ret)', 'ret', 3)} - 1 AS r3, {full('product(1 + ret)', 'ret', 5)} - 1 AS r5,
  {full('product(1 + ret)', 'ret', 8)} - 1 AS r8,
  coalesce(session_id - lag(session_id, 8) OVER w = 8, FALSE) AS c FROM panel {W_SQL})""")
def f02_gaps(spark, sf):
    return features.rolling_features(v.panel(spark, sf, "sup"), (3, 5, 8), (), 8)


@query("f03_rolling_volatility", "country asset date:d vol_5:f vol_20:f vol_60:f", v.panel_sql("brand"),
       f"""SELECT country, asset, date, v5 AS vol_5, v20 AS vol_20, CASE WHEN c THEN v60 END AS vol_60 FROM (SELECT *,
  {full('stddev_pop(ret)', 'ret', 5)} AS v5, {full('stddev_pop(ret)', 'ret', 20)} AS v20,
  {full('stddev_pop(ret)', 'ret', 60)} AS v60,
  coalesce(session_id - lag(session_id, 60) OVER w = 60, FALSE) AS c FROM panel {W_SQL})""")
def f03(spark, sf):
    return features.rolling_features(v.panel(spark, sf, "brand"), ())


_GF = """gf AS (SELECT *, CASE WHEN volume > 0 THEN abs(r1) / (close * volume) END AS illiq FROM (
  SELECT *, close / lag(close) OVER w - 1 AS r1 FROM grid WINDOW w AS (PARTITION BY country, asset ORDER BY session_id)))"""


@query("f04_close_to_mean", "country asset:i session_id:i close_to_mean:f", _GRID,
       f"SELECT *, close / {full('avg(close)', 'close', 3)} - 1 AS close_to_mean FROM grid".replace(
           "close / CASE", "close / (CASE").replace("END - 1", "END) - 1"))
def f04(spark, sf):
    return features.grid_features(_grid(spark, sf, "sup"), 3)


@query("f05_volume_to_mean", "country asset:i session_id:i volume_to_mean:f", _GRID,
       f"SELECT *, volume / ({full('avg(volume)', 'volume', 3)}) - 1 AS volume_to_mean FROM grid")
def f05(spark, sf):
    return features.grid_features(_grid(spark, sf, "sup"), 3)


@query("f06_bar_shape", "country asset:i date:d intraday_range:f open_to_close:f", v.bars_sql("sup"),
       "SELECT *, (high - low) / close AS intraday_range, close / open - 1 AS open_to_close FROM bars")
def f06(spark, sf):
    return features.bar_shape(v.bars(spark, sf, "sup"))


@query("f07_high_low_proxy", "country asset:i date:d high_low_proxy:f", v.bars_sql("sup"),
       "SELECT *, CASE WHEN low > 0 THEN high / low - 1 END AS high_low_proxy FROM bars")
def f07(spark, sf):
    return features.bar_shape(v.bars(spark, sf, "sup"))


@query("f08_log_levels", "country asset:i date:d log_volume:f log_dollar_volume:f log_price:f", v.panel_sql("sup"),
       "SELECT *, ln(1 + volume) AS log_volume, ln(1 + dollar_volume) AS log_dollar_volume, ln(close) AS log_price FROM panel")
def f08(spark, sf):
    return features.log_levels(v.panel(spark, sf, "sup"))


@query("f09_amihud_daily", "country asset:i date:d amihud:f12", v.panel_sql("sup"),
       "SELECT *, abs(ret) / nullif(dollar_volume, 0) AS amihud FROM panel")
def f09(spark, sf):
    return v.panel(spark, sf, "sup").withColumn("amihud", features.illiquidity())


@query("f10_amihud_mean", "country asset:i session_id:i illiq_mean:f12", _GRID + "," + _GF,
       f"SELECT *, {full('avg(illiq)', 'illiq', 3)} AS illiq_mean FROM gf")
def f10(spark, sf):
    return features.grid_features(_grid(spark, sf, "sup"), 3)


@query("f11_contiguity_gate", "country asset:i date:d continuous_4:b", v.panel_sql("sup"),
       f"""SELECT *, coalesce(sum(step) OVER {frame(4)} = 4, FALSE) AS continuous_4 FROM (
  SELECT *, CAST(coalesce(session_id - lag(session_id) OVER w = 1, FALSE) AS INT) AS step FROM panel {W_SQL})""")
def f11(spark, sf):
    return features.rolling_features(v.panel(spark, sf, "sup"), (), (), 4)


@query("f12_full_history", "country asset:i session_id:i full_history:b", _GRID,
       f"SELECT *, sum(CAST(observed AS INT)) OVER {frame(3)} = 3 AS full_history FROM grid")
def f12(spark, sf):
    return features.grid_features(_grid(spark, sf, "sup"), 3)


FEAT_SUP = v.panel_sql("sup") + f""",
feats AS (SELECT *, {full('stddev_pop(ret)', 'ret', 3)} AS vol_3, abs(ret) / nullif(dollar_volume, 0) AS amihud FROM panel)"""
MARKET_SQL = """
market AS (SELECT country, date, avg(ret) AS market_return, stddev_samp(ret) AS dispersion,
  avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS breadth, median(vol_3) AS median_vol,
  median(spread_bps) AS median_spread, median(amihud) AS median_amihud FROM feats GROUP BY 1, 2)"""
MEDIANS = {"median_vol": "vol_3", "median_spread": "spread_bps", "median_amihud": "amihud"}


def _feats_vol3(spark, sf):
    p = features.rolling_features(v.panel(spark, sf, "sup"), (), (3,), 60)
    return p.withColumn("amihud", features.illiquidity())


@query("f13_market_stats",
       "country date:d market_return:f dispersion:f breadth:f median_vol:f median_spread:f4 median_amihud:f12",
       FEAT_SUP + "," + MARKET_SQL, "SELECT * FROM market")
def f13(spark, sf):
    return features.market_stats(_feats_vol3(spark, sf), MEDIANS)


def _mframe(n):
    return f"(PARTITION BY country ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _mfull(agg, x, n):
    return f"CASE WHEN count({x}) OVER {_mframe(n)} = {n} THEN {agg} OVER {_mframe(n)} END"


_MARKET_RET = v.panel_sql("sup") + """,
market AS (SELECT country, date, avg(ret) AS market_return FROM panel GROUP BY 1, 2)"""
_MWIN = f"""
mwin AS (SELECT country, date, {_mfull('product(1 + market_return)', 'market_return', 5)} - 1 AS market_return_5,
  {_mfull('product(1 + market_return)', 'market_return', 20)} - 1 AS market_return_20,
  {_mfull('product(1 + market_return)', 'market_return', 60)} - 1 AS market_return_60,
  {_mfull('stddev_pop(market_return)', 'market_return', 20)} AS market_vol_20,
  {_mfull('stddev_pop(market_return)', 'market_return', 60)} AS market_vol_60,
  product(1 + coalesce(market_return, 0)) OVER (PARTITION BY country ORDER BY date ROWS UNBOUNDED PRECEDING) AS index_level
  FROM market)"""


@query("f14_market_windows", "country date:d market_return_5:f market_return_20:f market_return_60:f market_vol_20:f market_vol_60:f",
       _MARKET_RET + "," + _MWIN, "SELECT * FROM mwin")
def f14(spark, sf):
    return features.market_windows(features.market_stats(v.panel(spark, sf, "sup"), {}))


@query("f15_market_distance", "country date:d index_level:f market_distance:f", _MARKET_RET + "," + _MWIN,
       f"SELECT *, index_level / ({_mfull('avg(index_level)', 'index_level', 200)}) - 1 AS market_distance FROM mwin")
def f15(spark, sf):
    return features.market_windows(features.market_stats(v.panel(spark, sf, "sup"), {}))


@query("f16_attach_market", "country asset:i date:d ret:f market_return:f breadth:f", v.panel_sql("sup") + """,
market AS (SELECT country, date, avg(ret) AS market_return, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS breadth
  FROM panel GROUP BY 1, 2)""",
       "SELECT p.*, market_return, breadth FROM panel p LEFT JOIN market m USING (country, date)")
def f16(spark, sf):
    p = v.panel(spark, sf, "sup")
    return features.attach_market(p, features.market_stats(p, {}))


@query("f24_feature_complete", "country asset:i date:d complete:b", v.panel_sql("sup") + f""",
f AS (SELECT *, {full('product(1 + ret)', 'ret', 5)} AS r5 FROM panel)""",
       "SELECT *, r5 IS NOT NULL AND spread_bps IS NOT NULL AND ret IS NOT NULL AS complete FROM f")
def f24(spark, sf):
    p = features.rolling_features(v.panel(spark, sf, "sup"), (5,), ())
    return p.withColumn("complete", features.feature_complete(["return_5", "spread_bps", "ret"]))


@query("f26_risk_history", "country asset date:d risk_history:b", v.panel_sql("brand"),
       f"SELECT *, coalesce(session_id - lag(session_id, 126) OVER w = 126, FALSE) AS risk_history FROM panel {W_SQL}")
def f26(spark, sf):
    return v.panel(spark, sf, "brand").withColumn("risk_history", features.risk_history(126))


@query("f27_model_features",
       "country asset date:d return_5:f return_10:f return_20:f return_60:f vol_5:f vol_20:f vol_60:f log_volume:f "
       "log_dollar_volume:f log_price:f high_low_proxy:f amihud:f12 day_of_week:i is_month_end:i is_quarter_end:i",
       v.panel_sql("brand") + f""",
m AS (SELECT *, {full('product(1 + ret)', 'ret', 5)} - 1 AS return_5, {full('product(1 + ret)', 'ret', 10)} - 1 AS return_10,
  {full('product(1 + ret)', 'ret', 20)} - 1 AS return_20, {full('product(1 + ret)', 'ret', 60)} - 1 AS r60,
  {full('stddev_pop(ret)', 'ret', 5)} AS vol_5, {full('stddev_pop(ret)', 'ret', 20)} AS vol_20,
  {full('stddev_pop(ret)', 'ret', 60)} AS v60,
  coalesce(session_id - lag(session_id, 60) OVER w = 60, FALSE) AS c FROM panel {W_SQL})""",
       """SELECT *, CASE WHEN c THEN r60 END AS return_60, CASE WHEN c THEN v60 END AS vol_60, ln(1 + volume) AS log_volume,
  ln(1 + dollar_volume) AS log_dollar_volume, ln(close) AS log_price, high / low - 1 AS high_low_proxy,
  abs(ret) / nullif(dollar_volume, 0) AS amihud, isodow(date) - 1 AS day_of_week,
  CAST(last_day(date) = date AS INT) AS is_month_end,
  CAST(last_day(date) = date AND month(date) % 3 = 0 AS INT) AS is_quarter_end FROM m""")
def f27(spark, sf):
    """The whole feature row in one exchange."""
    return features.model_features(v.panel(spark, sf, "brand"))


# --- labels -----------------------------------------------------------------


def forward_sql(first: int, last: int, source: str = "panel", name: str = "fwd") -> str:
    fr = f"(PARTITION BY country, asset ORDER BY session_id ROWS BETWEEN {first} FOLLOWING AND {last} FOLLOWING)"
    n = last - first + 1
    return f"""
{name} AS (SELECT *, CASE WHEN x THEN g - 1 END AS forward_raw, CASE WHEN x THEN g - f END AS forward_excess,
  CASE WHEN x THEN (g - f) * 10000 END AS target FROM (SELECT *,
  coalesce(lead(session_id, {last}) OVER w = session_id + {last}, FALSE) AS x,
  CASE WHEN count(ret) OVER {fr} = {n} THEN product(1 + ret) OVER {fr} END AS g,
  product(1 + rf_daily) OVER {fr} AS f,
  CASE WHEN lead(session_id, 1) OVER w = session_id + 1 THEN lead(date, 1) OVER w END AS execution_date,
  CASE WHEN lead(session_id, {first}) OVER w = session_id + {first} THEN lead(date, {first}) OVER w END AS label_start_date,
  CASE WHEN lead(session_id, {last}) OVER w = session_id + {last} THEN lead(date, {last}) OVER w END AS label_end_date
  FROM {source} {W_SQL}))"""


_PANEL_RF = v.panel_sql("sup", rf=True)
LABELLED = _PANEL_RF + "," + forward_sql(1, 5)
DELAYED = _PANEL_RF + "," + forward_sql(2, 6)


def labelled(spark, sf, first=1, last=5, view="sup"):
    p = v.panel(spark, sf, view, rf=True)
    return labels.label_dates(labels.forward_excess(p, first, last), first, last)


@query("l01_entry_exit_label", "country asset:i session_id:i entry_close:f exit_close:f label:f label_status", v.panel_sql("sup") + """,
lim AS (SELECT country, max(session_id) AS s FROM calendar GROUP BY 1)""",
       """SELECT *, CASE WHEN label_status = 'ok' THEN exit_close / entry_close - 1 END AS label FROM (
  SELECT p.country, p.asset, p.session_id, e.close AS entry_close, x.close AS exit_close,
  CASE WHEN p.session_id + 1 > s THEN 'no_entry_session' WHEN p.session_id + 6 > s THEN 'no_exit_session'
    WHEN e.close IS NULL THEN 'missing_entry' WHEN x.close IS NULL THEN 'missing_exit'
    WHEN e.close <= 0 THEN 'bad_entry' ELSE 'ok' END AS label_status
  FROM panel p JOIN lim USING (country)
  LEFT JOIN panel e ON e.country = p.country AND e.asset = p.asset AND e.session_id = p.session_id + 1
  LEFT JOIN panel x ON x.country = p.country AND x.asset = p.asset AND x.session_id = p.session_id + 6)""")
def l01(spark, sf):
    p = v.panel(spark, sf, "sup")
    return labels.entry_exit_label(p.select("country", "asset", "session_id"), p, v.calendar(spark, sf, "sup"), 1, 5)


@query("l02_cash_over_holding", "country session_id:i cash_observed:i cash_return:f9", v.cash_sql("sup"),
       """SELECT country, session_id, count(rf) OVER w AS cash_observed,
  CASE WHEN count(rf) OVER w = 5 THEN product(1 + rf) OVER w - 1 END AS cash_return
  FROM calendar LEFT JOIN (SELECT country, date, pow(1 + annual_pct / 100, 1.0 / 365) - 1 AS rf FROM cash_rate)
  USING (country, date)
  WINDOW w AS (PARTITION BY country ORDER BY session_id ROWS BETWEEN 2 FOLLOWING AND 6 FOLLOWING)""")
def l02(spark, sf):
    rate = v.cash_rate(spark, sf, "sup").withColumn("rf_daily", cal.daily_simple_rate("annual_pct"))
    return labels.cash_over_holding(v.calendar(spark, sf, "sup"), rate, 1, 5)


@query("l03_forward_excess_bps", "country asset:i date:d target:f4", LABELLED, "SELECT * FROM fwd")
def l03(spark, sf):
    return labels.forward_excess(v.panel(spark, sf, "sup", rf=True))


@query("l04_delayed_label", "country asset:i date:d target:f4 execution_date:d label_start_date:d label_end_date:d",
       DELAYED, "SELECT * FROM fwd")
def l04(spark, sf):
    return labelled(spark, sf, 2, 6)


@query("l05_demeaned_target", "country asset:i date:d target_rel:f4 target_rel_investable:f4", DELAYED + """,
d AS (SELECT *, target - avg(target) OVER (PARTITION BY country, date) AS target_rel FROM fwd),
inv AS (SELECT country, asset, date, target - avg(target) OVER (PARTITION BY country, date) AS target_rel_investable
  FROM fwd WHERE spread_bps IS NOT NULL)""",
       "SELECT d.*, target_rel_investable FROM d LEFT JOIN inv USING (country, asset, date)")
def l05(spark, sf):
    """Mean over the panel, and again over the investable rows only."""
    p = labelled(spark, sf, 2, 6).withColumn("t_inv", F.when(F.col("spread_bps").isNotNull(), F.col("target")))
    p = features.attach_stats(p, ["country", "date"], F.avg("target").alias("m"), F.avg("t_inv").alias("mi"))
    return p.withColumn("target_rel", F.col("target") - F.col("m")).withColumn(
        "target_rel_investable", F.col("t_inv") - F.col("mi"))


@query("l06_forward_pnl_returns", "country asset:i date:d forward_raw:f forward_excess:f", LABELLED, "SELECT * FROM fwd")
def l06(spark, sf):
    return labels.forward_excess(v.panel(spark, sf, "sup", rf=True))


@query("l07_target_availability", "country asset:i date:d target_available:b target_status", LABELLED,
       """SELECT *, target IS NOT NULL AND execution_date IS NOT NULL AS target_available,
  CASE WHEN target IS NOT NULL AND execution_date IS NOT NULL THEN 'available' ELSE 'missing_exact_sessions' END
  AS target_status FROM fwd""")
def l07(spark, sf):
    return labels.availability(labelled(spark, sf))


PURGED = DELAYED + f""",
purged AS (SELECT *, split IN ('train', 'validation', 'test') AND NOT purged AS model_eligible FROM (SELECT *,
  coalesce(split = 'train' AND label_end_date >= DATE '1998-01-01', FALSE) AS purged FROM (
  SELECT *, {SPLIT_SQL.format(d='date')} AS split FROM fwd)))"""


def purged(spark, sf):
    p = labelled(spark, sf, 2, 6).withColumn("split", clean.split_by_date("date", FOLDS, "outside"))
    return labels.purge(p, "1998-01-01", "train", ["train", "validation", "test"])


@query("l08_purge", "country asset:i date:d split purged:b model_eligible:b", PURGED, "SELECT * FROM purged")
def l08(spark, sf):
    return purged(spark, sf)


@query("l09_split_audit",
       "country split n_rows:i n_purged:i n_eligible:i first_date:d last_date:d last_label_date:d n_leaking:i", PURGED,
       """SELECT country, split, count(*) AS n_rows, count_if(purged) AS n_purged, count_if(model_eligible) AS n_eligible,
  min(date) AS first_date, max(date) AS last_date, max(label_end_date) AS last_label_date,
  count_if(coalesce(split = 'train' AND model_eligible AND label_end_date >= DATE '1998-01-01', FALSE)) AS n_leaking
  FROM purged GROUP BY 1, 2""")
def l09(spark, sf):
    return labels.split_audit(purged(spark, sf), "1998-01-01", "train")
