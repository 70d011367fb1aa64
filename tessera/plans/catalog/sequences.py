"""Queries F17-F23, F25 and M03-M05: sequences, scaling and model fits."""

from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, full_frame
from tessera.operators import calendar as cal
from tessera.operators import clean, features, forecast, models, sequence
from tessera.plans import views as v
from tessera.plans.catalog.cleaning import FOLDS, SPLIT_SQL
from tessera.plans.catalog.featureset import full, purged
from tessera.plans.catalog.universes import TOP, UNI, uni_sup
from tessera.plans.registry import query
from tessera.session import materialise

L = 8
SIGNALS = v.panel_sql("sup") + "," + v.CAPS_SUP_SQL + "," + UNI + f""",
sg AS (SELECT m.country, u.asset, m.session_id FROM (SELECT country, max(date) AS date, max(session_id) AS session_id
    FROM calendar GROUP BY country, date_trunc('month', date)) m JOIN uni u ON u.country = m.country
    AND u.universe_month = date_trunc('month', m.date) WHERE selected),
lf AS (SELECT s.country, s.asset, s.session_id, k AS step, p.asset IS NOT NULL AS present, p.ret, p.close
  FROM sg s CROSS JOIN range({L}) AS r(k) LEFT JOIN panel p ON p.country = s.country AND p.asset = s.asset
  AND p.session_id = s.session_id - {L - 1} + k)"""
MEASURES = ["ret", "close"]


def _assembled(spark, sf):
    """Month-end signals of the selected universe, whether or not the asset traded."""
    c = materialise(v.calendar(spark, sf, "sup"))
    m = cal.month_end_sessions(c).join(F.broadcast(c), ["country", "date"])
    u = uni_sup(spark, sf, TOP).where("selected").select("country", "asset", F.col("universe_month").alias("month"))
    s = materialise(u.join(F.broadcast(m), ["country", "month"]).select("country", "asset", "session_id"))
    # windows hold rows of their own asset only
    p = v.panel(spark, sf, "sup").join(s.select("country", "asset").distinct(), ["country", "asset"], "left_semi")
    return sequence.assemble(s, p, MEASURES, L)


@query("f17_sequence_slots", "country asset:i session_id:i mask n_present:i", SIGNALS,
       """SELECT country, asset, session_id, string_agg(CASE WHEN present THEN '1' ELSE '0' END, '' ORDER BY step) AS mask,
  count_if(present) AS n_present FROM lf GROUP BY 1, 2, 3""")
def f17(spark, sf):
    a = _assembled(spark, sf)
    flag = F.transform("slots", lambda s: F.when(s.isNotNull(), "1").otherwise("0"))
    return a.select("country", "asset", "session_id", F.array_join(flag, "").alias("mask"),
                    F.size(F.filter("slots", lambda s: s.isNotNull())).alias("n_present"))


@query("f18_sequence_long", "country asset:i session_id:i step:i present:b ret:f close:f", SIGNALS, "SELECT * FROM lf")
def f18(spark, sf):
    return sequence.long_form(_assembled(spark, sf))


@query("f18_complete_sequences", "country asset:i session_id:i", SIGNALS,
       "SELECT country, asset, session_id FROM lf GROUP BY 1, 2, 3 HAVING bool_and(present)")
def f18_complete(spark, sf):
    return sequence.complete(_assembled(spark, sf))


@query("f19_absent_assets", "country asset:i session_id:i step:i close:f", SIGNALS,
       """SELECT country, asset, session_id, step, close FROM lf JOIN (SELECT country, asset, session_id FROM lf GROUP BY 1, 2, 3
  HAVING NOT bool_or(present AND step = 7)) USING (country, asset, session_id)""")
def f19(spark, sf):
    """Signals whose asset has no row on the signal session keep their slot."""
    return sequence.long_form(_assembled(spark, sf).where(F.element_at("slots", -1).isNull()))


@query("f20_sequence_summaries", "country asset:i session_id:i ret_last:f ret_mean:f ret_std:f ret_min:f ret_max:f close_mean:f", SIGNALS,
       """SELECT country, asset, session_id, max(CASE WHEN step = 7 THEN ret END) AS ret_last, avg(ret) AS ret_mean,
  stddev_pop(ret) AS ret_std, min(ret) AS ret_min, max(ret) AS ret_max, avg(close) AS close_mean FROM lf GROUP BY 1, 2, 3""")
def f20(spark, sf):
    return sequence.summarise(_assembled(spark, sf), MEASURES)


@query("f21_flat_vectors", "country asset:i session_id:i dims:i total:f4", SIGNALS,
       """SELECT country, asset, session_id, 2 * count(*) AS dims, sum(coalesce(ret, 0) + coalesce(close, 0)) AS total FROM lf GROUP BY 1, 2, 3""")
def f21(spark, sf):
    from pyspark.ml.functions import vector_to_array

    a = vector_to_array("features")
    return sequence.flatten(_assembled(spark, sf), MEASURES).select(
        "country", "asset", "session_id", F.size(a).alias("dims"), F.aggregate(a, F.lit(0.0), lambda s, x: s + x).alias("total"))


ROWS = v.panel_sql("sup") + f""",
rw AS (SELECT *, {SPLIT_SQL.format(d='date')} AS split, {full('stddev_pop(ret)', 'ret', 3)} AS vol FROM panel)"""
FIT = ROWS + f""",
cells AS (SELECT p.ret, p.vol FROM rw s JOIN rw p ON p.country = s.country AND p.asset = s.asset
  AND p.session_id BETWEEN s.session_id - {L - 1} AND s.session_id WHERE s.split = 'train'),
q AS (SELECT quantile_cont(ret, 0.5) AS rm, quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS ri,
  quantile_cont(vol, 0.5) AS vm, quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25) AS vi FROM cells)"""


def _rows(spark, sf):
    p = v.panel(spark, sf, "sup").withColumn("split", clean.split_by_date("date", FOLDS, "outside"))
    p = p.withColumn("vol", full_frame(F.stddev_pop, "ret", 3, by_asset()))
    # nothing else, as the bars then make no other columns
    return materialise(p.select("country", "asset", "session_id", "date", "split", "ret", "vol"))


def _fit(rows):
    return sequence.robust_fit(sequence.window_counts(rows, F.col("split") == "train", L), ["ret", "vol"], "freq")


@query("f22_robust_fit", "ret_median:f9 ret_iqr:f9 vol_median:f9 vol_iqr:f9", FIT,
       "SELECT rm AS ret_median, ri AS ret_iqr, vm AS vol_median, vi AS vol_iqr FROM q")
def f22(spark, sf):
    return _fit(_rows(spark, sf))


@query("f23_robust_apply", "country asset:i date:d ret_scaled:f vol_scaled:f", FIT,
       """SELECT country, asset, date, least(greatest((coalesce(ret, rm) - rm) / ri, -10), 10) AS ret_scaled,
  least(greatest((coalesce(vol, vm) - vm) / vi, -10), 10) AS vol_scaled FROM rw CROSS JOIN q""")
def f23(spark, sf):
    r = _rows(spark, sf)
    return sequence.robust_apply(r, materialise(_fit(r)), ["ret", "vol"])


@query("f25_row_robust_scale", "country asset:i date:d ret_scaled:f vol_scaled:f", ROWS + """,
q AS (SELECT quantile_cont(ret, 0.5) AS rm, quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25) AS ri,
  quantile_cont(vol, 0.5) AS vm, quantile_cont(vol, 0.75) - quantile_cont(vol, 0.25) AS vi FROM rw WHERE split = 'train')""",
       """SELECT country, asset, date, (coalesce(ret, rm) - rm) / ri AS ret_scaled, (coalesce(vol, vm) - vm) / vi AS vol_scaled
  FROM rw CROSS JOIN q""")
def f25(spark, sf):
    r = _rows(spark, sf)
    stats = materialise(sequence.robust_fit(r.where("split = 'train'"), ["ret", "vol"]))
    return sequence.robust_apply(r, stats, ["ret", "vol"], clip=None)


# --- model fits -------------------------------------------------------------------

RETURNS, VOLS = (3, 5, 8), (3, 5, 8)
CELLS = ["ret", *(f"return_{n}" for n in RETURNS), *(f"vol_{n}" for n in VOLS), "log_volume", "log_dollar_volume", "log_price",
         "high_low_proxy", "amihud", "day_of_week", "is_month_end", "is_quarter_end"]
WIDTH = L * len(CELLS)
KEEP = ["country", "asset", "session_id", "date", "split", "target", "label_end_date"]
FITTED, LATER = "model_eligible AND split = 'train'", "model_eligible AND split <> 'train'"


def _training(spark, sf):
    """Purged rows with their cells, and the median and range of the cells of the training windows."""
    p = features.model_features(purged(spark, sf), RETURNS, VOLS, 8)
    # counted in the exchange of the asset's other windows
    p = sequence.window_counts(p, F.expr(FITTED), L)
    p = materialise(p.select(*KEEP, "model_eligible", "freq", *[F.col(c).cast("double").alias(c) for c in CELLS]))
    return p, materialise(sequence.robust_fit(p, CELLS, "freq"))


def _windows(panel, stats, wanted, summaries=False):
    """Scaled flat sequences of the ``wanted`` signals, or their ``summaries``; a missing value or session is the median, so zero."""
    return sequence.window_features(panel, CELLS, L, wanted, KEEP, summaries, stats)


@query("m03_ridge", "country asset:i date:d prediction:f4 target:f4")
def m03(spark, sf):
    p, stats = _training(spark, sf)
    return models.ridge(_windows(p, stats, f"{FITTED} AND target IS NOT NULL"), _windows(p, stats, LATER), width=WIDTH)


@query("m04_boosted_trees", "country asset:i date:d prediction:f4 target:f4")
def m04(spark, sf):
    p, stats = _training(spark, sf)
    return models.boosted_trees(_windows(p, stats, f"{FITTED} AND target IS NOT NULL", True), _windows(p, stats, LATER, True))


def _walk(spark, sf):
    p, stats = _training(spark, sf)
    o = forecast.quarter_origins(p.where(LATER).select("country", "date").distinct())
    known = _windows(p, stats, "model_eligible AND target IS NOT NULL AND label_end_date IS NOT NULL")
    return p, stats, models.walk_forward(known, o, WIDTH)


@query("m05_walk_forward_fits", "country origin:d rows_used:i intercept:f4")
def m05(spark, sf):
    return _walk(spark, sf)[-1]


@query("m05_walk_forward_forecasts", "country asset:i date:d training_cutoff:d prediction:f4 target:f4")
def m05_predict(spark, sf):
    """Origins lie outside the training span, so no row inside has a fit."""
    p, stats, fits = _walk(spark, sf)
    return models.predict_walk_forward(_windows(p, stats, LATER), materialise(fits))
