"""Store of pair moments, from which the covariance of any window, date or kind is a difference of two prefixes.

Sessions are cut at every border of a wanted window.  Sums of a pair of assets are
formed once per stretch between two cuts, two hash tiles of the cross-section at a
time, and cumulated over the stretches.  A window is the sum up to its last session
less the sum up to the session before its first; so the work is one pass over the
sessions for all windows together, where a fold per window reads each session once
for every window that covers it.

Sums are raw and centred afterwards from the assets' own sums: ``p11`` of x_i x_j,
``p21`` of x_i^2 x_j, ``p12`` of x_i x_j^2, ``p22`` of x_i^2 x_j^2, and ``w11`` of
x_i x_j weighted by 2^(session / half-life), which leaves any window's exponential
weights up to a factor.  That weight stays finite for 1,000 half-lives of sessions.

Missing returns add nothing to a sum, and an asset is valid in a window only where
every session of it has a return, so windows with gaps never reach a result.  Equal
rows of one asset and session are an error of the panel and would count twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import tiles
from tessera.functions.expr import safe_div
from tessera.operators.risk import FALLBACK_VARIANCE

GROUP = ["country", "date", "window"]
PAIR = ["p11", "p21", "p12", "p22", "w11"]
OWN = ["c", "s1", "s2", "w1"]


def _prefix_differences(sums: list[str], windows: list[int], keys: list[str]) -> Column:
    """One struct per window: cumulated sums at the row's session less those ``window`` sessions before."""
    w = W.partitionBy(*keys).orderBy("session_id")

    def upto(name: str, end: int) -> Column:
        return F.coalesce(F.sum(name).over(w.rangeBetween(W.unboundedPreceding, end)), F.lit(0.0))

    return F.array(*[F.struct(F.lit(n).alias("window"), *[(upto(s, 0) - upto(s, -n)).alias(s) for s in sums]) for n in windows])


def asset_windows(panel: DataFrame, signals: DataFrame, windows: list[int], half_life: float) -> DataFrame:
    """Per signal date, window and asset with a row on that date: ``valid``, mean, weighted mean and sum of squares."""
    age = F.pow(F.lit(2.0), F.col("session_id") / half_life)
    known = F.col("ret").isNotNull()
    value = lambda c: F.when(known, c).otherwise(0.0)
    d = panel.select(
        "country", "asset", "session_id", F.when(known, 1.0).otherwise(0.0).alias("c"), value(F.col("ret")).alias("s1"),
        value(F.col("ret") * F.col("ret")).alias("s2"), value(F.col("ret") * age).alias("w1"))
    d = d.withColumn("sums", _prefix_differences(OWN, windows, ["country", "asset"]))
    d = d.join(F.broadcast(signals.select("country", "date", "session_id")), ["country", "session_id"])
    n = F.col("window")
    return d.select("country", "date", "session_id", "asset", F.inline("sums")).select(
        *GROUP, "asset", (F.col("c") == n).alias("valid"), (F.col("s1") / n).alias("mean"), F.col("s2").alias("square"),
        (F.col("w1") / _weight_sum(half_life, n, F.col("session_id"))).alias("weighted_mean"))


def _weight_sum(half_life: float, n: Column, session: Column) -> Column:
    """Sum of 2^(t / half_life) over the ``n`` sessions up to ``session``."""
    q = 0.5 ** (1 / half_life)
    return F.pow(F.lit(2.0), session / half_life) * (1 - F.pow(F.lit(q), n)) / (1 - q)


def _stretches(panel: DataFrame, signals: DataFrame, windows: list[int]) -> DataFrame:
    """Rows with a return, each with the first cut at or after it; later sessions serve no window."""
    borders = F.array(*[F.col("session_id").cast("bigint") - n for n in (0, *windows)])
    cuts = signals.select("country", F.explode(borders).alias("cut")).groupBy("country").agg(F.sort_array(F.collect_set("cut")).alias("cuts"))
    days = panel.select("country", "session_id").distinct().join(F.broadcast(cuts), "country")
    days = days.select("country", "session_id", F.element_at(F.filter("cuts", lambda c: c >= F.col("session_id")), 1).alias("cut"),
                       F.array_max(F.filter("cuts", lambda c: c < F.col("session_id"))).alias("start"))
    days = days.withColumn("start", F.coalesce("start", F.min("session_id").over(W.partitionBy("country", "cut")) - 1))
    return panel.where("ret IS NOT NULL").join(F.broadcast(days.where("cut IS NOT NULL")), ["country", "session_id"])


def pair_sums(panel: DataFrame, signals: DataFrame, windows: list[int], half_life: float, size: int = tiles.SIZE) -> DataFrame:
    """The store: (country, asset_i <= asset_j, cut as session_id) with the sums of the stretch that ends there.

    ``signals``: (country, date, session_id); they and the cuts are bounded by the calendar.
    """
    with_cut = _stretches(panel.select("country", "asset", "session_id", "ret"), signals, windows)
    values = F.map_from_entries(F.collect_list(F.struct("session_id", "ret")))
    d = with_cut.groupBy("country", "cut", "start", "asset").agg(values.alias("v"))
    days = F.sequence(F.col("start").cast("bigint") + 1, F.col("cut").cast("bigint"))
    at = F.transform(days, lambda t: F.coalesce(F.try_element_at("v", t.cast(panel.schema["session_id"].dataType)), F.lit(0.0)))
    age = F.transform(days, lambda t: F.pow(F.lit(2.0), t / half_life))
    d = d.withColumn("x", at).withColumn("wx", F.zip_with("x", age, lambda x, a: x * a))
    d = d.select("country", "cut", "asset", F.arrays_zip("x", "wx").alias("x"))
    block = tiles.blocks(d, ["country", "cut"], "asset", ["asset", "x"], size)
    zero = F.struct(*[F.lit(0.0).alias(n) for n in PAIR])

    def add(s: Column, t: Column) -> Column:
        a, b, both = t.a, t.b, t.a * t.b
        terms = dict(p11=both, p21=both * a, p12=both * b, p22=both * both, w11=t.w * b)
        return F.struct(*[(s[n] + terms[n]).alias(n) for n in PAIR])

    def entry(l: Column, r: Column) -> Column:
        first, second = F.when(l.asset <= r.asset, l).otherwise(r), F.when(l.asset <= r.asset, r).otherwise(l)
        both = F.zip_with(first.x, second.x, lambda p, q: F.struct(p.x.alias("a"), q.x.alias("b"), p.wx.alias("w")))
        return F.struct(first.asset.alias("asset_i"), second.asset.alias("asset_j"), F.aggregate(both, zero, add).alias("s"))

    within = lambda l: F.filter("right", lambda r: (F.col("i") < F.col("j")) | (r.asset >= l.asset))
    entries = F.flatten(F.transform("left", lambda l: F.transform(within(l), lambda r: entry(l, r))))
    return block.select("country", F.col("cut").alias("session_id"), F.inline(entries)).select("country", "session_id", "asset_i", "asset_j", "s.*")


def pair_windows(store: DataFrame, assets: DataFrame, signals: DataFrame, windows: list[int], half_life: float) -> DataFrame:
    """Centred moments of every valid pair per signal date and window: ``m2``, ``m4`` and weighted covariance ``ewma``."""
    d = store.withColumn("sums", _prefix_differences(PAIR, windows, ["country", "asset_i", "asset_j"]))
    d = d.join(F.broadcast(signals.select("country", "date", "session_id")), ["country", "session_id"])
    d = d.select("country", "date", "session_id", "asset_i", "asset_j", F.inline("sums"))
    for side in ("i", "j"):
        own = assets.where("valid").select(
            *GROUP, F.col("asset").alias(f"asset_{side}"), F.col("mean").alias(f"mean_{side}"),
            F.col("square").alias(f"square_{side}"), F.col("weighted_mean").alias(f"weighted_{side}"))
        d = d.join(own, [*GROUP, f"asset_{side}"])
    n, mi, mj = F.col("window"), F.col("mean_i"), F.col("mean_j")
    m4 = (F.col("p22") - 2 * mj * F.col("p21") - 2 * mi * F.col("p12") + mj * mj * F.col("square_i") + mi * mi * F.col("square_j")
          + 4 * mi * mj * F.col("p11") - 3 * n * mi * mi * mj * mj)
    weighted = F.col("w11") / _weight_sum(half_life, n, F.col("session_id")) - F.col("weighted_i") * F.col("weighted_j")
    return d.select(*GROUP, "asset_i", "asset_j", (F.col("p11") - n * mi * mj).alias("m2"), m4.alias("m4"), weighted.alias("ewma"))


def constants(pairs: DataFrame) -> DataFrame:
    """Ledoit-Wolf constants per signal date and window, from sums over pairs (0 for one asset)."""
    same = F.col("asset_i") == F.col("asset_j")
    times = F.when(same, 1.0).otherwise(2.0)
    n, p = F.col("window"), F.col("p")
    d = pairs.groupBy(*GROUP).agg(
        F.count_if(same).alias("p"), F.sum(F.when(same, F.col("m2"))).alias("t"),
        F.sum(times * F.col("m2") * F.col("m2")).alias("s2"), F.sum(times * F.col("m4")).alias("m4"))
    d = d.withColumn("mu", F.col("t") / n / p)
    d = d.withColumn("delta", F.when(p > 1, (F.col("s2") / (n * n) - p * F.col("mu") * F.col("mu")) / p).otherwise(0.0))
    d = d.withColumn("beta", F.least((F.col("m4") / n - F.col("s2") / (n * n)) / (p * n), "delta"))
    return d.select(*GROUP, "p", "mu", "delta", F.coalesce(F.when(F.col("delta") > 0, safe_div("beta", "delta")), F.lit(0.0)).alias("rho"))


def matrices(pairs: DataFrame, shrinkage: DataFrame, assets: DataFrame, min_assets: int) -> DataFrame:
    """Upper triangles of all kinds (``sample``, ``ewma``, ``shrunk``) in one table.

    Dates and windows with fewer than ``min_assets`` valid assets, and invalid assets
    elsewhere, get the fallback variance on the diagonal only.
    """
    n, rho = F.col("window"), F.col("rho")
    d = pairs.join(shrinkage.where(F.col("p") >= min_assets).select(*GROUP, "mu", "rho"), GROUP)
    shrunk = (1 - rho) * F.col("m2") / n + F.when(F.col("asset_i") == F.col("asset_j"), rho * F.col("mu")).otherwise(0.0)
    kinds = {"sample": F.col("m2") / (n - 1), "ewma": F.col("ewma"), "shrunk": shrunk}
    every = lambda value: F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), value(k).alias("value")) for k in kinds]))
    full = d.select(*GROUP, "asset_i", "asset_j", every(lambda k: kinds[k]))
    enough = shrinkage.select(*GROUP, (F.col("p") >= min_assets).alias("enough"))
    flat = assets.join(enough, GROUP, "left").where(~F.coalesce("enough", F.lit(False)) | ~F.col("valid"))
    return full.unionByName(flat.select(*GROUP, F.col("asset").alias("asset_i"), F.col("asset").alias("asset_j"), every(lambda k: F.lit(FALLBACK_VARIANCE))))
