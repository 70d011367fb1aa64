"""Resampling inference on date series.

A series has one row per (key, date), so its length is bounded by the calendar.
Draw indices are hashes of (seed, draw, position): any engine and any retry gives
the same sample.  Draws are spread over tasks before they are expanded, and the
series (bounded) is broadcast to them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import hash_index, safe_div

# Draws, lag and block limits.
DRAWS = 2000
MAX_LAG = 12
BLOCK_LIMITS = (4, 12)
#: Tasks that share a key's draws.
SLICES = 16


def paired_rows(forecasts: DataFrame, label: str = "model") -> DataFrame:
    """Every two models on the same asset and date; models are a short fixed list.

    Pairs are formed inside the asset's own short array, never across assets.
    """
    keys = ["country", "date", "asset"]
    rows = forecasts.where(F.col("prediction").isNotNull() & F.col("target").isNotNull())
    s = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        F.col(label).alias("m"), F.col("prediction").alias("p"), F.col("target").alias("y")))).alias("s"))
    pair = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b.m > a.m), lambda b: F.struct(
        a.m.alias("left"), b.m.alias("right"), a.p.alias("p_left"), b.p.alias("p_right"), a.y.alias("y"), b.y.alias("y_right")))))
    return s.select(*keys, F.inline(pair))


def loss_difference(pairs: DataFrame) -> DataFrame:
    """Mean squared-error difference per date, with the number of disagreeing targets."""
    e = (F.col("p_left") - F.col("y")) * (F.col("p_left") - F.col("y")) - (
        F.col("p_right") - F.col("y_right")) * (F.col("p_right") - F.col("y_right"))
    return pairs.groupBy("left", "right", "date").agg(
        F.avg(e).alias("d"), F.count(F.lit(1)).alias("n_assets"),
        F.count_if(F.abs(F.col("y") - F.col("y_right")) > 1e-8).alias("target_mismatch"))


def indexed(series: DataFrame, keys: list[str], order: str = "date") -> DataFrame:
    """Position ``i`` (0-based) and length ``n`` per key."""
    w = W.partitionBy(*keys)
    return series.withColumn("i", (F.row_number().over(w.orderBy(order)) - 1).cast("bigint")).withColumn(
        "n", F.count(F.lit(1)).over(w))


def mean_test(series: DataFrame, keys: list[str], value: str = "d", order: str = "date") -> DataFrame:
    """Diebold-Mariano statistic with Bartlett weights and the (n - 1) / n factor."""
    w = W.partitionBy(*keys)
    s = indexed(series, keys, order).withColumn("_d", F.col(value) - F.avg(value).over(w))
    o = w.orderBy("i")
    s = s.select("*", *[F.lag("_d", k).over(o).alias(f"_l{k}") for k in range(1, MAX_LAG + 1)])
    root = F.floor(F.pow(F.col("n"), F.lit(1 / 3)) + 1e-9)
    s = s.withColumn("lag", F.least(F.greatest(root, F.lit(1)), F.lit(MAX_LAG)))
    auto = [F.sum(F.col("_d") * F.col(f"_l{k}")) / F.first("n") for k in range(1, MAX_LAG + 1)]
    g = s.groupBy(*keys).agg(
        F.first("n").alias("n"), F.first("lag").alias("lag"), F.avg(value).alias("mean"),
        (F.sum(F.col("_d") * F.col("_d")) / F.first("n")).alias("_g0"), *[a.alias(f"_g{k + 1}") for k, a in enumerate(auto)])
    total = F.col("_g0")
    for k in range(1, MAX_LAG + 1):
        weight = F.when(F.col("lag") >= k, 1 - F.lit(k) / (F.col("lag") + 1)).otherwise(0.0)
        total = total + 2 * weight * F.coalesce(f"_g{k}", F.lit(0.0))
    n = F.col("n")
    stat = F.col("mean") / F.sqrt(F.greatest(total, F.lit(1e-16)) / n) * F.sqrt((n - 1) / n)
    return g.select(*keys, "n", "lag", "mean", total.alias("long_run_variance"), stat.alias("statistic"))


def student_p(t: str | Column, df: str | Column) -> Column:
    """Two-sided Student-t p-value for whole degrees of freedom: a finite sum in the angle atan(t / sqrt(df)).

    Terms of even powers of its cosine for even ``df``, of odd powers for odd ``df``.
    """
    t, df = (F.col(c) if isinstance(c, str) else c for c in (t, df))
    t, nu = F.abs(t.cast("double")), df.cast("bigint")
    odd, c2 = nu % 2 == 1, nu / (nu + t * t)
    steps = F.floor((nu - 2 - (nu % 2)) / 2).cast("int")
    start = F.when(odd, F.sqrt(c2)).otherwise(1.0)
    # the row's constants are fields of a lambda variable, so they are computed once
    row = F.array(F.struct(odd.alias("odd"), c2.alias("c2"), start.alias("start")))

    def series(r: Column) -> Column:
        zero = F.struct(r.start.alias("term"), r.start.alias("total"))

        def add(a: Column, k: Column) -> Column:
            term = a.term * r.c2 * F.when(r.odd, 2 * k / (2 * k + 1.0)).otherwise((2 * k - 1.0) / (2 * k))
            return F.struct(term.alias("term"), (a.total + term).alias("total"))

        return F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>")), zero, add, lambda a: a.total)

    total = F.when(nu > 1, F.element_at(F.transform(row, series), 1)).otherwise(0.0)
    sine = t / F.sqrt(nu + t * t)
    inside = F.when(odd, 2 / math.pi * (F.atan(t / F.sqrt(nu.cast("double"))) + sine * total)).otherwise(sine * total)
    return F.greatest(1 - inside, F.lit(0.0))


def circular_block(n: str | Column) -> Column:
    lo, hi = BLOCK_LIMITS
    n = F.col(n) if isinstance(n, str) else n
    return F.least(F.lit(hi), F.greatest(F.lit(lo), F.floor(n / 8))).cast("bigint")


def _draws(series: DataFrame, keys: list[str], draws: int) -> DataFrame:
    """One row per (key, draw), spread over tasks."""
    return series.select(*keys, "n").distinct().select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(draws - 1).cast("bigint"))).alias("draw")).repartition("draw")


def circular_indices(series: DataFrame, keys: list[str], draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Sample positions ``j`` and source positions ``i`` of circular block draws."""
    d = _draws(series, keys, draws).withColumn("len", circular_block("n"))
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.col("len")) - 1)))
    d = d.withColumn("start", hash_index("n", seed, F.col("draw"), F.col("b")))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)))
    j = F.col("b") * F.col("len") + F.col("o")
    return d.where(j < F.col("n")).select(*keys, "draw", j.alias("j"), ((F.col("start") + F.col("o")) % F.col("n")).alias("i"))


def fixed_block_indices(series: DataFrame, keys: list[str], block: int, draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Draws of whole blocks cut from the start; the last block may be short.

    Blocks are appended until the sample is full and then truncated to ``n``; the
    number generated covers the case of every drawn block being the short one.
    """
    d = _draws(series, keys, draws)
    blocks = F.ceil(F.col("n") / block)
    short = F.when(F.col("n") % block == 0, F.lit(block)).otherwise(F.col("n") % block)
    d = d.withColumn("b", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("n") / F.least(short, F.lit(block))) - 1)))
    d = d.withColumn("start", hash_index(blocks, seed, F.col("draw"), F.col("b")) * block)
    d = d.withColumn("len", F.least(F.lit(block), F.col("n") - F.col("start")))
    w = W.partitionBy(*keys, "draw").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("at", F.coalesce(F.sum("len").over(w), F.lit(0))).where(F.col("at") < F.col("n"))
    d = d.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)))
    j = F.col("at") + F.col("o")
    return d.where(j < F.col("n")).select(*keys, "draw", j.alias("j"), (F.col("start") + F.col("o")).alias("i"))


def iid_indices(series: DataFrame, keys: list[str], draws: int = DRAWS, seed: int = 7) -> DataFrame:
    d = _draws(series, keys, draws).withColumn(
        "j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    return d.select(*keys, "draw", "j", hash_index("n", seed, F.col("draw"), F.col("j")).alias("i"))


def resample(indices: DataFrame, series: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return indices.join(F.broadcast(series.select(*keys, "i", *values)), [*keys, "i"])


def interval(stats: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Percentile interval over draws (their number is fixed)."""
    return stats.groupBy(*keys).agg(
        F.percentile(value, F.lit(0.025)).alias(name + "_low"), F.percentile(value, F.lit(0.975)).alias(name + "_high"))


def mean_interval(indices: DataFrame, series: DataFrame, keys: list[str], value: str, name: str = "ci") -> DataFrame:
    m = resample(indices, series, keys, [value]).groupBy(*keys, "draw").agg(F.avg(value).alias("m"))
    return interval(m, keys, "m", name)


def sign_flip(series: DataFrame, keys: list[str], value: str = "d", draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """Randomisation p-value of the mean under random sign changes."""
    d = _draws(series, keys, draws).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    up = hash_index(F.lit(2), seed, F.col("draw"), F.col("i")) == 0
    j = d.join(F.broadcast(series.select(*keys, "i", value)), [*keys, "i"])
    m = j.groupBy(*keys, "draw").agg(
        F.abs(F.avg(F.when(up, F.col(value)).otherwise(-F.col(value)))).alias("m"), F.abs(F.avg(value)).alias("observed"))
    return m.groupBy(*keys).agg(F.avg(F.when(F.col("m") >= F.col("observed"), 1.0).otherwise(0.0)).alias("p_value"))


def holm(df: DataFrame, keys: list[str], family: list[str], p: str = "p_value") -> DataFrame:
    """Step-down adjusted p-values within a family of comparisons; unknown ones are not counted."""
    g = W.partitionBy(*family) if family else W.partitionBy(F.lit(1))
    order = g.orderBy(F.col(p).isNull(), F.col(p), *keys)
    m = F.count(p).over(g)
    step = F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p))
    d = df.withColumn("_s", step)
    run = F.max("_s").over(order.rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("holm_p", F.when(F.col(p).isNotNull(), run)).drop("_s")


def _sharpe(x: str, periods: int) -> Column:
    sd = F.stddev_samp(x)
    return F.when(sd > 0, safe_div(F.avg(x), sd) * F.sqrt(F.lit(float(periods))))


def sharpe_difference(indices: DataFrame, series: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """Interval of the Sharpe difference of ``a`` and ``b``, resampled on the same dates."""
    s = resample(indices, series, keys, ["a", "b"]).groupBy(*keys, "draw").agg(
        (_sharpe("a", periods) - _sharpe("b", periods)).alias("ds"))
    return interval(s.where(F.col("ds").isNotNull()), keys, "ds", "delta_sharpe")


def _single(x: Column, values: list[str], paths: list[str]) -> Column:
    """Summary of one date."""
    out = [F.lit(1.0).alias("m")]
    for v in values:
        known = x[v].isNotNull()
        out += [F.when(known, 1.0).otherwise(0.0).alias("c_" + v), F.coalesce(x[v], F.lit(0.0)).alias("s_" + v), F.coalesce(x[v] * x[v], F.lit(0.0)).alias("q_" + v)]
    for v in paths:
        g = 1 + F.coalesce(x[v], F.lit(0.0))
        out += [g.alias("g_" + v), g.alias("p_" + v), g.alias("l_" + v), F.lit(1.0).alias("w_" + v)]
    return F.struct(*out)


def _nothing(values: list[str], paths: list[str]) -> Column:
    """Summary of no date, the identity of ``_then``."""
    inf = F.lit(float("inf"))
    out = [F.lit(0.0).alias("m")] + [F.lit(0.0).alias(k + v) for v in values for k in ("c_", "s_", "q_")]
    for v in paths:
        out += [F.lit(1.0).alias("g_" + v), F.lit(0.0).alias("p_" + v), inf.alias("l_" + v), inf.alias("w_" + v)]
    return F.struct(*out)


def _then(a: Column, b: Column, values: list[str], paths: list[str]) -> Column:
    """Summary of the dates of ``a`` followed by those of ``b``.

    Of a path: growth g, highest and lowest wealth p and l on the way, worst ratio w of wealth to its
    running peak.  Wealth over the larger of two peaks is the smaller of the two ratios.
    """
    out = [(a[c] + b[c]).alias(c) for c in ["m"] + [k + v for v in values for k in ("c_", "s_", "q_")]]
    for v in paths:
        g, p, low, w = (k + v for k in ("g_", "p_", "l_", "w_"))
        out += [(a[g] * b[g]).alias(g), F.greatest(a[p], a[g] * b[p]).alias(p), F.least(a[low], a[g] * b[low]).alias(low),
                F.least(a[w], F.try_divide(a[g] * b[low], a[p]), b[w]).alias(w)]
    return F.struct(*out)


def block_draws(series: DataFrame, keys: list[str], values: list[str], paths: list[str] = [], block: int | None = None,
                draws: int = DRAWS, seed: int = 7) -> DataFrame:
    """One summary per (key, draw): ``m`` dates, per value count, sum and sum of squares, per path growth and drawdown.

    Blocks are summarised once per place where one can start; a draw then composes its blocks'
    summaries, so it costs its blocks and no sampled date becomes a row.  Without ``block`` the
    blocks are circular and as long as ``circular_block`` says, the last one cut to fill ``n``; with it
    they are cut from the start and a short one counts its own dates; blocks of one date are independent
    draws.  Samples are those of ``circular_indices``, ``fixed_block_indices`` and ``iid_indices``.  Path returns are not below -100 %; a missing
    value is left out of its sums and leaves wealth as it is.  Rows of a key are bounded by the calendar.
    """
    names = list(dict.fromkeys([*values, *paths]))
    merge = lambda a, b: _then(a, b, values, paths)
    zero = _nothing(values, paths)
    fold = lambda part: F.aggregate(part, zero, lambda a, x: merge(a, _single(x, values, paths)))
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)
    n, length, parts = F.col("n"), F.col("_len"), F.col("_parts")

    table = series.groupBy(*keys, "n").agg(F.sort_array(F.collect_list(F.struct("i", *[F.col(c).cast("double").alias(c) for c in names]))).alias("_all"))
    table = table.withColumn("_len", circular_block("n") if block is None else F.lit(block).cast("bigint")).withColumn("_blocks", F.ceil(n / length))
    if block is None:
        # a series may be shorter than a block, so it goes round as often as that takes
        turns = F.flatten(F.array_repeat("_all", (F.ceil(length / n) + 1).cast("int")))
        lengths = F.array(length, n - (F.col("_blocks") - 1) * length)
        starts = upto(n)
    else:
        turns, lengths, starts = F.col("_all"), upto(length + 1), F.transform(upto(F.col("_blocks")), lambda b: b * length)
        lengths = F.filter(lengths, lambda k: k > 0)
    cut = lambda at, k: fold(F.slice("_turns", (at + 1).cast("int"), k.cast("int")))
    table = table.withColumn("_turns", turns).withColumn("_parts", F.transform(starts, lambda at: F.transform(lengths, lambda k: cut(at, k))))
    table = table.select(*keys, "n", "_len", "_blocks", "_parts")

    def circular(draw: Column) -> Column:
        last = F.col("_blocks") - 1
        kind = lambda b: F.when(b == last, 2).otherwise(1)
        at = lambda b: hash_index("n", seed, draw, b).cast("int") + 1
        return F.aggregate(F.transform(upto(F.col("_blocks")), lambda b: F.element_at(F.element_at(parts, at(b)), kind(b))), zero, merge)

    def fixed(draw: Column) -> Column:
        short = F.when(n % length == 0, length).otherwise(n % length)
        chosen = F.transform(upto(F.ceil(n / short)), lambda b: hash_index("_blocks", seed, draw, b))

        def add(a: Column, b: Column) -> Column:
            take = F.least(length, n - b * length, n - a["m"].cast("bigint")).cast("int")
            part = F.when(take > 0, F.element_at(F.element_at(parts, b.cast("int") + 1), F.greatest(take, F.lit(1)))).otherwise(zero)
            # as a lambda variable the part is looked up once
            return F.element_at(F.transform(F.array(part), lambda x: merge(a, x)), 1)

        return F.aggregate(chosen, zero, add)

    one = circular if block is None else fixed
    dealt = table.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(min(SLICES, draws) - 1)))).repartition(*keys, "_slice")
    mine = F.sequence(F.col("_slice"), F.lit(draws - 1), F.lit(SLICES))
    return dealt.select(*keys, F.explode(F.transform(mine, lambda d: F.struct(d.alias("draw"), one(d).alias("sum")))).alias("_d")).select(*keys, "_d.draw", "_d.sum.*")


def _mean_of(v: str) -> Column:
    return F.try_divide(F.col("s_" + v), F.col("c_" + v))


def _sharpe_of(v: str, periods: int) -> Column:
    """Sharpe ratio from a summary; deviations below rounding of the squares count as none."""
    c, s, q = (F.col(k + v) for k in ("c_", "s_", "q_"))
    spread = q - F.try_divide(s * s, c)
    sd = F.when((c > 1) & (spread > 1e-13 * q), F.sqrt(F.try_divide(spread, c - 1)))
    return F.try_divide(_mean_of(v), sd) * F.sqrt(F.lit(float(periods)))


def block_mean_interval(series: DataFrame, keys: list[str], value: str, block: int | None = None, name: str = "ci") -> DataFrame:
    """Percentile interval of a mean under circular blocks, or under blocks of ``block`` dates."""
    return interval(block_draws(series, keys, [value], block=block).withColumn("_m", _mean_of(value)), keys, "_m", name)


def block_sharpe_difference(series: DataFrame, keys: list[str], periods: int, block: int | None = None) -> DataFrame:
    """As ``sharpe_difference``, under blocks."""
    d = block_draws(series, keys, ["a", "b"], block=block).withColumn("ds", _sharpe_of("a", periods) - _sharpe_of("b", periods))
    return interval(d.where(F.col("ds").isNotNull()), keys, "ds", "delta_sharpe")


def portfolio_bootstrap(series: DataFrame, keys: list[str], periods: int) -> DataFrame:
    """Intervals of paired differences in mean, Sharpe, turnover and maximum drawdown under circular blocks.

    ``series`` has returns ``a``, ``b`` and turnovers ``ta``, ``tb``.
    """
    s = series.withColumn("d", F.col("a") - F.col("b")).withColumn("t", F.col("ta") - F.col("tb"))
    d = block_draws(s, keys, ["a", "b", "d", "t"], ["a", "b"]).select(
        *keys, _mean_of("d").alias("mean"), (_sharpe_of("a", periods) - _sharpe_of("b", periods)).alias("sharpe"),
        _mean_of("t").alias("turnover"), (F.col("w_a") - F.col("w_b")).alias("drawdown"))
    aggs = []
    for c in ("mean", "sharpe", "turnover", "drawdown"):
        aggs += [F.percentile(c, F.lit(0.025)).alias(c + "_low"), F.percentile(c, F.lit(0.975)).alias(c + "_high")]
    return d.groupBy(*keys).agg(*aggs)
