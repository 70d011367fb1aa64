"""Trailing covariance per (country, signal date).

An asset's window is an array column built by one asset window; covariance entries
are folds over two hash tiles of the cross-section at a time, so pairs exist only
as the requested matrix entries.  Shrinkage constants and portfolio variances
use factor forms that never build the matrix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import tiles
from tessera.functions.expr import attach_stats, by_asset, contiguous_diffs, safe_div

# Fixed value: variance of an asset without usable history.
FALLBACK_VARIANCE = 1e-4
GROUP = ["country", "date"]


def windows(panel: DataFrame, n: int, include_signal: bool = True) -> DataFrame:
    """Last ``n`` session returns as an array, oldest first; ``valid`` when all are present."""
    w = by_asset()
    last = 0 if include_signal else -1
    frame = w.rowsBetween(last - n + 1, last)
    full = F.count("ret").over(frame) == n
    run = contiguous_diffs(n - 1 - last, w)
    return panel.select(
        "*", F.collect_list("ret").over(frame).alias("x"), (full & run).alias("valid")
    ).withColumn("x", F.when(F.col("valid"), F.col("x")))


def _dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def _centred(x: str, weights: list[float] | None = None) -> Column:
    n = F.size(x)
    if weights is None:
        mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    else:
        mean = _dot(x, F.array(*[F.lit(w) for w in weights]))
    # the mean is a field of a lambda variable, so it is computed once per window and not once per element
    held = F.array(F.struct(F.col(x).alias("x"), mean.alias("mean")))
    return F.element_at(F.transform(held, lambda h: F.transform(h.x, lambda v: v - h.mean)), 1)


def ewma_weights(n: int, half_life: float) -> list[float]:
    raw = [0.5 ** ((n - 1 - k) / half_life) for k in range(n)]
    total = sum(raw)
    return [r / total for r in raw]


def covariance(rows: DataFrame, weights: list[float] | None = None, size: int = tiles.SIZE) -> DataFrame:
    """Upper triangle (asset_i <= asset_j): sample covariance, or weighted when ``weights`` given."""
    d = rows.where("valid").select(*GROUP, "asset", _centred("x", weights).alias("x"))
    if weights is None:
        d = d.withColumn("wx", F.col("x"))
        scale = lambda x: F.size(x) - 1
    else:
        d = d.withColumn("wx", F.zip_with("x", F.array(*[F.lit(w) for w in weights]), lambda v, w: v * w))
        scale = lambda x: F.lit(1)
    block = tiles.blocks(d, GROUP, "asset", ["asset", "x", "wx"], size)

    def entry(a, b):
        return F.struct(F.least(a.asset, b.asset).alias("asset_i"), F.greatest(a.asset, b.asset).alias("asset_j"), (_dot(a.wx, b.x) / scale(b.x)).alias("value"))

    within = lambda a: F.filter("right", lambda b: (F.col("i") < F.col("j")) | (b.asset >= a.asset))
    entries = F.flatten(F.transform("left", lambda a: F.transform(within(a), lambda b: entry(a, b))))
    return block.select(*GROUP, F.inline(entries))


def shrinkage(rows: DataFrame, size: int = tiles.SIZE) -> DataFrame:
    """Ledoit-Wolf constants per group: assets, scale ``mu``, and intensity ``rho`` (0 for one asset).

    The sums over all asset pairs are folds over every two tiles.
    """
    d = rows.where("valid").select(*GROUP, "asset", _centred("x").alias("x"))
    d = d.withColumn("x2", F.transform("x", lambda v: v * v))
    block = tiles.blocks(d, GROUP, "asset", ["x", "x2"], size)
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("m"))

    def fold(acc, a, b):
        dot = _dot(a.x, b.x)
        return F.struct((acc.s + dot * dot).alias("s"), (acc.m + _dot(a.x2, b.x2)).alias("m"))

    pairs = F.aggregate("left", zero, lambda acc, a: F.aggregate("right", acc, lambda acc2, b: fold(acc2, a, b)))
    times = F.when(F.col("i") < F.col("j"), 2).otherwise(1)  # a block of two tiles stands for both orders
    sums = block.select(*GROUP, times.alias("times"), pairs.alias("f")).groupBy(*GROUP).agg(
        F.sum(F.col("times") * F.col("f.s")).alias("s2"), F.sum(F.col("times") * F.col("f.m")).alias("m4"))
    diag = d.groupBy(*GROUP).agg(
        F.count(F.lit(1)).alias("p"), F.first(F.size("x")).alias("n"), F.sum(_dot("x", "x")).alias("t"))
    p, n = F.col("p"), F.col("n")
    return (
        diag.join(sums, GROUP)
        .withColumn("mu", F.col("t") / n / p)
        .withColumn("delta", F.when(p > 1, (F.col("s2") / (n * n) - p * F.col("mu") * F.col("mu")) / p).otherwise(0.0))
        .withColumn("beta", F.least((F.col("m4") / n - F.col("s2") / (n * n)) / (p * n), "delta"))
        .withColumn("rho", F.coalesce(F.when(F.col("delta") > 0, safe_div("beta", "delta")), F.lit(0.0)))
        .select(*GROUP, "p", "n", "mu", "delta", "rho")
    )


def shrunk_covariance(rows: DataFrame, constants: DataFrame, size: int = tiles.SIZE) -> DataFrame:
    """Upper triangle of ``(1 - rho) S + rho mu I`` with S on divisor n."""
    c = covariance(rows, size=size).join(constants, GROUP)
    same = F.when(F.col("asset_i") == F.col("asset_j"), F.col("rho") * F.col("mu")).otherwise(0.0)
    s = F.col("value") * (F.col("n") - 1) / F.col("n")
    return c.select(*GROUP, "asset_i", "asset_j", ((1 - F.col("rho")) * s + same).alias("value"))


def with_fallback(rows: DataFrame, matrix: DataFrame, min_assets: int) -> DataFrame:
    """Diagonal for groups with too few valid assets, and for invalid assets elsewhere."""
    counted = attach_stats(rows, GROUP, F.count_if("valid").alias("n_valid"))
    enough = counted.where(F.col("n_valid") >= min_assets)
    kept = matrix.join(enough.select(*GROUP).distinct(), GROUP, "left_semi")
    flat = counted.where((F.col("n_valid") < min_assets) | ~F.col("valid")).select(
        *GROUP, F.col("asset").alias("asset_i"), F.col("asset").alias("asset_j"), F.lit(FALLBACK_VARIANCE).alias("value"))
    return kept.unionByName(flat)


def status(rows: DataFrame, dates: DataFrame, min_assets: int) -> DataFrame:
    """Per (country, date) of ``dates``: valid assets of the window and whether the covariance falls back.

    A date without window rows has no valid asset, so it falls back too.
    """
    n = rows.groupBy(*GROUP).agg(F.count_if("valid").alias("n"))
    valid = F.coalesce("n", F.lit(0)).cast("bigint")
    return dates.select(*GROUP).distinct().join(n, GROUP, "left").select(*GROUP, valid.alias("valid_assets"), (valid < min_assets).alias("fallback"))


def portfolio_variance(rows: DataFrame, weights: DataFrame, constants: DataFrame) -> DataFrame:
    """Variance of weights over valid assets under the shrunk covariance, without the matrix.

    ``w'Sw`` is the mean square of the portfolio's centred return path.
    """
    d = rows.where("valid").select(*GROUP, "asset", _centred("x").alias("x"))
    h = d.join(weights.select(*GROUP, "asset", "weight"), [*GROUP, "asset"])
    path = h.select(*GROUP, "weight", F.posexplode("x").alias("t", "v")).groupBy(*GROUP, "t").agg(
        F.sum(F.col("weight") * F.col("v")).alias("r"))
    var = path.groupBy(*GROUP).agg(F.avg(F.col("r") * F.col("r")).alias("sample"))
    ww = h.groupBy(*GROUP).agg(F.sum(F.col("weight") * F.col("weight")).alias("w2"))
    return var.join(ww, GROUP).join(constants, GROUP).select(
        *GROUP, ((1 - F.col("rho")) * F.col("sample") + F.col("rho") * F.col("mu") * F.col("w2")).alias("variance"))


def objective(variance: DataFrame, returns: DataFrame, costs: DataFrame, aversion: float) -> DataFrame:
    """Return, risk and cost terms of the mean-variance objective."""
    o = variance.join(returns, GROUP, "left").join(costs, GROUP, "left")
    risk = F.col("variance") * aversion / 2
    r, c = F.coalesce("expected_return", F.lit(0.0)), F.coalesce("trade_cost", F.lit(0.0))
    return o.select(*GROUP, r.alias("return_term"), risk.alias("risk_term"), c.alias("cost_term"),
                    (r - risk - c).alias("objective"))
