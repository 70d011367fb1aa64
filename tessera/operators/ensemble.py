"""Combining seed scores and calibrating them to returns.

Input is a long table (country, date, asset, seed, score); an absent row is an
absent seed, never a zero.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import ranking as rk
from tessera.functions.expr import attach_stats, moment_corr, normal_quantile, safe_div

CLIP = (0.001, 0.999)
DIGITS = 12
CROSS = ["country", "date"]


def rank_normal(scores: DataFrame, keys: list[str], value: str = "score", out: str = "z",
                ties: tuple[str | Column, ...] = ("asset",)) -> DataFrame:
    """Normal score of the ascending position; equal scores lie in order of ``ties``, a single asset scores zero."""
    r = rk.ordinal(scores, keys, [value, *ties], "_i", "_n")
    p = F.least(F.greatest((F.col("_i") - 0.5) / F.col("_n"), F.lit(CLIP[0])), F.lit(CLIP[1]))
    # a column of its own, so that the polynomials do not repeat its expression
    z = F.when(F.col("_n") >= 2, normal_quantile("_p")).otherwise(0.0)
    return r.withColumn("_p", p).withColumn(out, z).drop("_i", "_n", "_p")


def common_universe(scores: DataFrame, seeds: int) -> DataFrame:
    """Assets scored by every seed on the date; a window of an asset's few scores, so rows are exchanged once."""
    n = F.size(F.collect_set("seed").over(W.partitionBy("asset", *CROSS)))
    return scores.withColumn("_s", n).where(F.col("_s") == seeds).drop("_s")


def mean_available(scores: DataFrame) -> DataFrame:
    """Mean normal score over the seeds that cover the asset."""
    z = rank_normal(scores, [*CROSS, "seed"])
    return z.groupBy(*CROSS, "asset").agg(F.round(F.avg("z"), DIGITS).alias("ensemble"), F.count(F.lit(1)).alias("n_seeds"))


def _median(values: Column) -> Column:
    """Exact median of a short sorted array, null if empty."""
    last = F.size(values) - 1
    low, high = F.get(values, F.floor(last / 2).cast("int")), F.get(values, F.ceil(last / 2).cast("int"))
    return F.when(low == high, low).otherwise(low * 0.5 + high * 0.5)


def candidates(z: DataFrame, weights: DataFrame, carry: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """Mean, median and the two weighted combinations of seed normal scores.

    ``weights``: one row per seed with ``w_ic`` and ``w_tb``.  Seeds arrive in no
    fixed order, so sums are rounded to make equal scores tie.  An asset's scores are few, so the
    median is taken from their sorted array.  ``carry``: columns that all seeds of an asset share.
    """
    c = z.join(F.broadcast(weights), "seed").groupBy(*CROSS, "asset").agg(
        F.round(F.avg("z"), DIGITS).alias("mean_rank"),
        F.sort_array(F.collect_list("z")).alias("_z"),
        F.round(F.sum(F.col("z") * F.col("w_ic")), DIGITS).alias("ic_weighted"),
        F.round(F.sum(F.col("z") * F.col("w_tb")), DIGITS).alias("tb_weighted"),
        *[F.any_value(name).alias(name) for name in carry])
    return c.withColumn("median_rank", F.round(_median(F.col("_z")), DIGITS)).drop("_z")


def seed_weights(seed_metrics: DataFrame) -> DataFrame:
    """Weights proportional to positive skill, equal when no seed has any.

    One row per seed: the window runs over a handful of rows.
    """
    everything = W.partitionBy(F.lit(1))

    def share(metric: str) -> Column:
        pos = F.greatest(F.coalesce(metric, F.lit(0.0)), F.lit(0.0))
        total = F.sum(pos).over(everything)
        return F.when(total > 0, safe_div(pos, total)).otherwise(1 / F.count(F.lit(1)).over(everything))

    return seed_metrics.select("seed", share("mean_ic").alias("w_ic"), share("top_minus_bottom").alias("w_tb"))


def choose(candidate_metrics: DataFrame, base: str, margin: float = 0.005, max_weight: float = 0.5) -> DataFrame:
    """Apply the selection rule to one row per candidate and mark the winner.

    A candidate must beat the base by ``margin``, have a positive spread, hit
    more than half the time and not lean on one seed; otherwise the base stays.
    """
    everything = W.partitionBy(F.lit(1))
    base_ic = F.max(F.when(F.col("model") == base, F.col("mean_ic"))).over(everything)
    m = candidate_metrics.withColumn("passes", F.coalesce(
        (F.col("mean_ic") >= base_ic + margin) & (F.col("top_minus_bottom") > 0) & (F.col("hit_rate") > 0.5)
        & (F.col("max_weight") <= max_weight), F.lit(False)))
    order = W.partitionBy(F.lit(1)).orderBy(
        F.desc("passes"), F.desc_nulls_last("mean_ic"), F.desc_nulls_last("icir"), F.desc_nulls_last("top_minus_bottom"),
        F.asc("model"))
    m = m.withColumn("_r", F.row_number().over(order)).withColumn("_any", F.bool_or("passes").over(everything))
    chosen = F.when(F.col("_any"), F.col("_r") == 1).otherwise(F.col("model") == base)
    return m.withColumn("selected", chosen).drop("_r", "_any")


def seed_agreement(scores: DataFrame, common: bool = False) -> DataFrame:
    """Rank correlation of every two seeds per date over the assets both cover.

    Seeds are few and fixed by the run, so an asset's seeds form a small map and
    pairs of seeds are expanded per asset, never pairs of assets.  ``common`` scores are known for
    every asset and seed, so a seed has the same ranks in all its pairs and they are made once.
    """
    if common:
        r = rk.ordinal(scores, [*CROSS, "seed"], ["score", "asset"], "_p", rank="_rank")
        scores = r.select(*CROSS, "asset", "seed", F.col("_rank").alias("score"))
    per_asset = scores.groupBy(*CROSS, "asset").agg(
        F.sort_array(F.collect_list(F.struct("seed", "score"))).alias("s"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(
        F.filter("s", lambda b: b.seed > a.seed),
        lambda b: F.struct(a.seed.alias("seed_left"), b.seed.alias("seed_right"), a.score.alias("x"), b.score.alias("y")))))
    long = per_asset.select(*CROSS, "asset", F.inline(pair))
    keys = [*CROSS, "seed_left", "seed_right"]
    long = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    if common:
        r = long.withColumnsRenamed({"x": "rx", "y": "ry"})
    else:
        r = rk.ordinal(long, keys, ["x", "asset"], "_x", rank="rx")
        r = rk.ordinal(r, keys, ["y", "asset"], "_y", rank="ry", source=long)
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_assets"),
        F.when(F.count(F.lit(1)) >= 3, moment_corr("rx", "ry")).alias("rank_corr"))


def consensus(z: DataFrame) -> DataFrame:
    """Mean, spread and their ratio over seeds; rounding keeps equal seeds at spread zero."""
    sd = F.round(F.stddev_pop(F.round("z", DIGITS)), DIGITS)
    return z.groupBy(*CROSS, "asset").agg(
        F.avg("z").alias("mean_rank"), sd.alias("sd_rank"), (F.avg("z") / (sd + 1e-8)).alias("consensus"))


def zscore(df: DataFrame, value: str, out: str, min_n: int, keys: tuple[str, ...] = ("country", "date")) -> DataFrame:
    """Cross-sectional z-score (population deviation); null for small or constant groups."""
    d = attach_stats(df, list(keys), F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    ok = (F.col("_n") >= min_n) & (F.col("_s") > 1e-12)
    return d.withColumn(out, F.when(ok, (F.col(value) - F.col("_m")) / F.col("_s"))).drop("_n", "_m", "_s")


def slopes(df: DataFrame, keys: list[str], value: str = "score") -> DataFrame:
    """Slope through the origin of target (decimals) on the z-score; empty ``keys`` pools."""
    d = zscore(df.where(F.col("target").isNotNull()), value, "_z", 3)
    beta = safe_div(F.sum(F.col("_z") * F.col("target") / 10000), F.sum(F.col("_z") * F.col("_z")))
    return d.groupBy(*keys).agg(F.coalesce(beta, F.lit(0.0)).alias("beta"), F.count("_z").alias("observations"))


def apply_slopes(df: DataFrame, beta: DataFrame, keys: list[str], value: str = "score", positive: bool = True) -> DataFrame:
    """Calibrated alpha in decimals; ``beta`` holds one row per country (or one row)."""
    d = zscore(df, value, "_z", 2)
    if keys:
        d = d.join(F.broadcast(beta.select(*keys, "beta")), keys, "left")
    else:
        d = d.withColumn("beta", beta.select("beta").scalar())
    b = F.coalesce("beta", F.lit(0.0))
    b = F.greatest(b, F.lit(0.0)) if positive else b
    return d.withColumn("alpha", F.coalesce(b * F.col("_z"), F.lit(0.0))).drop("_z")


def gated_choice(runs: DataFrame, param: str, max_fallback: float = 0.10, min_coverage: float = 0.95,
                 min_countries: int = 3) -> DataFrame:
    """Best parameter by eligible countries, then mean Sharpe over them."""
    ok = (F.coalesce("fallback_rate", F.lit(1.0)) <= max_fallback) & (F.coalesce("coverage", F.lit(0.0)) >= min_coverage)
    t = runs.groupBy(param).agg(
        F.count_if(ok).alias("eligible_countries"), F.avg(F.when(ok, F.col("sharpe"))).alias("mean_sharpe"))
    w = W.partitionBy(F.lit(1)).orderBy(F.desc("eligible_countries"), F.desc_nulls_last(F.round("mean_sharpe", 9)), F.asc(param))
    return t.withColumn("selected", (F.row_number().over(w) == 1) & (F.col("eligible_countries") >= min_countries))
