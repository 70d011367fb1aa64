"""Evaluation of cross-sectional forecasts.

All statistics are grouped moments over (model, country, date); ranks come from
the distributed helpers, so a cross-section may be arbitrarily large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import ranking as rk
from tessera.functions.expr import moment_corr, safe_div
from tessera.session import materialise

CONSTANT = 1e-12
TAIL_SHARE = 0.2
MIN_ASSETS = 3
#: Measures of a date that need its rows in order; the others are plain moments.
ORDERED = ("spearman_ic", "top_minus_bottom")


def usable(forecasts: DataFrame) -> DataFrame:
    """Rows with a known target and a finite prediction."""
    ok = F.col("target").isNotNull() & F.col("prediction").isNotNull() & ~F.isnan("prediction") & ~F.isnan("target")
    return forecasts.where(ok)


def ranked(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Average-tie ranks of prediction and target, position by prediction and group size.

    Action: the first ranking is a stage table, so that the second does not plan it anew.
    """
    rows = usable(forecasts).select(*keys, "asset", "prediction", "target")
    placed = materialise(rk.ordinal(rows, keys, ["prediction", "asset"], "pos", "n_assets", rank="rank_p"))
    return rk.ordinal(placed, keys, ["target", "asset"], "_y", rank="rank_y").drop("_y")


def date_metrics(forecasts: DataFrame, keys: list[str], ordered: tuple[str, ...] = ORDERED) -> DataFrame:
    """Per-group information coefficients, spread, errors and dispersion.

    Groups under three assets have no metrics; a constant forecast has errors but
    no rank metrics.  Of the ``ORDERED`` measures only those in ``ordered`` are made: rows are
    ranked for the information coefficient, put in order of prediction for the spread, else neither.
    """
    if "spearman_ic" in ordered:
        rows = ranked(forecasts, keys)
    else:
        rows = usable(forecasts).select(*keys, "asset", "prediction", "target")
        if ordered:
            rows = rk.ordinal(rows, keys, ["prediction", "asset"], "pos", "n_assets")
    err = F.col("prediction") - F.col("target")
    k = F.greatest(F.lit(1), F.floor(F.col("n_assets") * TAIL_SHARE))
    top = F.avg(F.when(F.col("pos") > F.col("n_assets") - k, F.col("target")))
    bottom = F.avg(F.when(F.col("pos") <= k, F.col("target")))
    of_order = {"spearman_ic": moment_corr("rank_p", "rank_y"), "top_minus_bottom": top - bottom}
    m = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_assets"),
        moment_corr("prediction", "target").alias("pearson_ic"),
        *[of_order[c].alias(c) for c in ordered],
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        F.avg(F.when(F.signum("prediction") == F.signum("target"), 1.0).otherwise(0.0)).alias("directional_accuracy"),
        F.stddev_pop("prediction").alias("dispersion"),
    )
    enough = F.col("n_assets") >= MIN_ASSETS
    varied = enough & (F.col("dispersion") > CONSTANT)
    m = m.withColumn("rank_defined", varied)
    for c in (*ordered, "pearson_ic", "directional_accuracy"):
        m = m.withColumn(c, F.when(varied, F.col(c)))
    for c in ("mae", "rmse", "dispersion"):
        m = m.withColumn(c, F.when(enough, F.col(c)))
    every = forecasts.select(*keys).distinct()
    return every.join(m, keys, "left").fillna({"n_assets": 0, "rank_defined": False})


def _icir(mean: Column, sd: Column) -> Column:
    return F.when(sd > 0, safe_div(mean, sd))


def summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Date metrics to one row per ``keys``; the date axis bounds each group."""
    ic = F.when(F.col("rank_defined"), F.col("spearman_ic"))
    defined = F.count(ic)
    sd = F.when(defined > 1, F.stddev_samp(ic))
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("forecast_dates"),
        F.count_if("rank_defined").alias("rank_defined_dates"),
        F.avg(ic).alias("mean_ic"),
        F.percentile(ic, F.lit(0.5)).alias("median_ic"),
        F.avg(F.when(F.round(ic, 12) > 0, 1.0).when(ic.isNotNull(), 0.0)).alias("hit_rate"),
        _icir(F.avg(ic), sd).alias("icir"),
        F.avg("top_minus_bottom").alias("top_minus_bottom"),
        F.avg("pearson_ic").alias("pearson_ic"),
        F.avg("mae").alias("mae"),
        F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))).alias("rmse"),
        F.avg("directional_accuracy").alias("directional_accuracy"),
        F.percentile("dispersion", F.lit(0.5)).alias("median_dispersion"),
    )


def calibration(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Dispersion ratio and slope of target on prediction, pooled per ``keys``."""
    sp, sy, vp = F.stddev_pop("prediction"), F.stddev_pop("target"), F.var_pop("prediction")
    return usable(forecasts).groupBy(*keys).agg(
        F.when(sy > 0, safe_div(sp, sy)).alias("dispersion_ratio"),
        F.when(vp > CONSTANT, safe_div(F.covar_pop("prediction", "target"), vp)).alias("calibration_slope"))


def bucket_returns(forecasts: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    """Mean target per ordered bucket; groups with fewer rows than buckets are left out."""
    rows = usable(forecasts)
    rows = rk.ordinal(rows, keys, ["prediction", "asset"], "pos", "n").where(F.col("n") >= buckets)
    return rows.withColumn("bucket", rk.ntile_of("pos", "n", buckets)).groupBy(*keys, "bucket").agg(
        F.count(F.lit(1)).alias("n_assets"), F.avg("target").alias("mean_target"))


def bucket_spread(table: DataFrame, keys: list[str], buckets: int = 10) -> DataFrame:
    """Top less bottom bucket and correlation of bucket number with mean target."""
    mean = table.groupBy(*keys, "bucket").agg(F.avg("mean_target").alias("m"))
    return mean.groupBy(*keys).agg(
        (F.max(F.when(F.col("bucket") == buckets, F.col("m"))) - F.max(F.when(F.col("bucket") == 1, F.col("m")))).alias(
            "top_minus_bottom"),
        moment_corr("m", F.col("bucket").cast("double")).alias("monotonicity"))


def across(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean and sample deviation of measures over runs (seeds, countries)."""
    cols = [F.count(F.lit(1)).alias("n_runs")]
    for m in measures:
        cols += [F.avg(m).alias(m + "_mean"), F.when(F.count(m) > 1, F.stddev_samp(m)).alias(m + "_std")]
    return df.groupBy(*keys).agg(*cols)


def compare_models(forecast_summary: DataFrame, portfolio_summary: DataFrame, keys: list[str]) -> DataFrame:
    """Forecast and portfolio metrics side by side per model."""
    return forecast_summary.join(portfolio_summary, keys, "left")
