"""Baseline forecasts, forecast tables, cutoff audit and the pairwise loss."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import tiles
from tessera.functions.expr import attach_stats, by_asset, col
from tessera.session import materialise, ship_package

MIN_ASSETS = 3


def zero() -> Column:
    return F.lit(0.0)


def expanding_mean(df: DataFrame, realised_after: int, train: Column, out: str = "hist_mean") -> DataFrame:
    """Mean of the asset's own past targets that were already realised.

    A label spanning ``realised_after`` sessions is known that many sessions
    later, hence the range frame.  Without history a row outside the training set
    takes the mean of the training targets (one number); a training row, whose
    own and later targets are in that mean, takes zero.  Action: rows with their own mean are a
    stage table, made in the exchange of the asset's other windows.
    """
    w = by_asset().rangeBetween(W.unboundedPreceding, -realised_after)
    d = materialise(df.withColumn(out, F.avg("target").over(w)))
    overall = d.where(train).agg(F.avg("target")).scalar()
    return d.withColumn(out, F.coalesce(F.col(out), F.when(~train, overall), F.lit(0.0)))


def long_table(df: DataFrame, models: dict[str, str], keep: list[str]) -> DataFrame:
    """One row per model: ``models`` maps a model name to its prediction column."""
    cells = [F.struct(F.lit(m).alias("model"), F.col(c).cast("double").alias("prediction")) for m, c in models.items()]
    return df.select(*keep, F.inline(F.array(*cells)))


def training_cutoff(forecasts: DataFrame, expanding: bool, train: str = "train") -> DataFrame:
    """Latest signal date a forecast could have been trained on.

    Fixed: the last training date.  Expanding: the previous signal date after
    that.  Decided on the (country, date) axis, which is bounded by the calendar.
    """
    days = forecasts.select("country", "date", "split").distinct()
    last = F.max(F.when(F.col("split") == train, F.col("date"))).over(W.partitionBy("country"))
    previous = F.lag("date").over(W.partitionBy("country").orderBy("date"))
    days = days.select("country", "date", last.alias("_l"), previous.alias("_p"))
    cut = F.greatest("_l", "_p") if expanding else F.col("_l")
    days = days.select("country", "date", cut.alias("training_cutoff"))
    return forecasts.where(F.col("split") != train).join(F.broadcast(days), ["country", "date"], "left")


def cutoff_audit(labels: DataFrame, origins: DataFrame) -> DataFrame:
    """Per refit origin: candidate rows, rows whose label was realised, rows excluded.

    Rows are reduced to counts per date first; running sums over the date axis
    then answer every origin at once, without pairing origins with rows.
    """
    known = labels.where(F.col("label_end_date").isNotNull() & F.col("target").isNotNull())
    zero_ = F.lit(0).cast("bigint")
    seen = known.groupBy("country", F.col("date").alias("d")).agg(F.count(F.lit(1)).alias("s")).select(
        "country", "d", F.lit(1).alias("kind"), "s", zero_.alias("e"))
    ended = known.groupBy("country", F.col("label_end_date").alias("d")).agg(F.count(F.lit(1)).alias("e")).select(
        "country", "d", F.lit(-1).alias("kind"), zero_.alias("s"), "e")
    marks = origins.select("country", F.col("date").alias("d"), F.lit(0).alias("kind"), zero_.alias("s"), zero_.alias("e"))
    # labels ending on the origin count as realised, signals of the origin date do not
    w = W.partitionBy("country").orderBy("d", "kind").rowsBetween(W.unboundedPreceding, 0)
    axis = seen.unionByName(ended).unionByName(marks).select(
        "country", "d", "kind", F.sum("s").over(w).alias("candidate_rows"), F.sum("e").over(w).alias("rows_used"),
        F.max(F.when(F.col("e") > 0, F.col("d"))).over(w).alias("last_label_used"))
    return axis.where("kind = 0").select(
        "country", F.col("d").alias("origin"), "candidate_rows", "rows_used",
        (F.col("candidate_rows") - F.col("rows_used")).alias("rows_excluded"), "last_label_used")


def quarter_origins(dates: DataFrame) -> DataFrame:
    """First signal date of each quarter."""
    return dates.groupBy("country", F.trunc("date", "quarter").alias("q")).agg(F.min("date").alias("date")).drop("q")


def replay(universe: DataFrame, scores: DataFrame, unit: str, min_assets: int = MIN_ASSETS) -> DataFrame:
    """Align outside scores with the current universe; dates with too few matches are left out."""
    scale = 10000.0 if unit == "bps" else 1.0
    s = scores.where(F.col("prediction").isNotNull() & ~F.isnan("prediction")).select(
        "country", "date", "asset", (F.col("prediction") / scale).alias("alpha"))
    hit = universe.join(s, ["country", "date", "asset"])
    return attach_stats(hit, ["country", "date"], F.count(F.lit(1)).alias("n_matched")).where(
        F.col("n_matched") >= min_assets)


def intake(scores: DataFrame, keep_types: tuple[str, ...] = ("asset",)) -> DataFrame:
    """Outside model scores under the forecast contract.  Action: one score per model, seed, date and asset is asserted."""
    schema.require_columns(scores, ["model", "country", "date", "asset", "prediction"])
    schema.assert_unique(scores, [c for c in ("model", "seed", "country", "date", "asset") if c in scores.columns])
    return schema.enforce_schema(scores, schema.FORECASTS, keep_types)


def hybrid_loss(forecasts: DataFrame, keys: list[str], point: float = 0.25, order: float = 0.75,
                size: int = tiles.SIZE) -> DataFrame:
    """Huber point loss and pairwise logistic order loss per ``keys``.

    Order loss averages ``softplus(-(p_i - p_j))`` over pairs with
    ``y_i > y_j`` of a (country, date), then over dates.  Targets are in basis
    points, predictions in per cent.  Pairs are counted from the ties of targets.  Where
    predictions of a date are all equal each pair costs ln 2, and one pair whose exponential
    overflows makes the mean infinite; only what is left folds its pairs.
    """
    group = [*keys, "country", "date"]
    rows = forecasts.where(F.col("target").isNotNull() & F.col("prediction").isNotNull()).select(
        *group, "asset", F.col("prediction").alias("p"), (F.col("target") / 100).alias("y"))
    gap = F.abs(F.col("p") - F.col("y"))
    huber = rows.groupBy(*keys).agg(
        F.avg(F.when(gap <= 1, gap * gap / 2).otherwise(gap - 0.5)).alias("huber"), F.count(F.lit(1)).alias("n_rows"))
    dates = materialise(_order_dates(rows, group))
    # a mean over dates with an infinite one is infinite, unless a prediction is no number
    endless = dates.groupBy(*keys).agg(F.max("endless").alias("e"), F.max("strange").alias("x")).where("e AND NOT x").select(*keys)
    folded = dates.where("NOT even AND pairs > 0 AND (strange OR NOT endless)").join(F.broadcast(endless), keys, "left_anti").select(*group)
    sums = _pair_losses(rows.join(folded, group, "left_semi"), group, size)
    loss = F.when(F.col("even"), F.log1p(F.exp(F.lit(0.0)))).when(F.col("endless") & ~F.col("strange"), float("inf")).otherwise(F.col("s") / F.col("pairs"))
    ranked = dates.where("pairs > 0").join(sums, group, "left").groupBy(*keys).agg(F.avg(loss).alias("rank_loss"), F.sum("pairs").alias("n_pairs"))
    ranked = ranked.join(F.broadcast(endless.withColumn("endless", F.lit(True))), keys, "left").withColumn(
        "rank_loss", F.when(F.col("endless"), float("inf")).otherwise(F.col("rank_loss"))).drop("endless")
    return huber.join(ranked, keys, "left").withColumn(
        "hybrid", point * F.col("huber") + order * F.coalesce("rank_loss", F.lit(0.0)))


def _order_dates(rows: DataFrame, group: list[str]) -> DataFrame:
    """Per group: ``pairs`` of unequal targets, whether its predictions are ``even`` (all equal), whether one is ``strange`` (no
    finite number) and whether it is ``endless``: a row above the mean target lies so far below one at or under it that their pair overflows."""
    spread = attach_stats(rows, group, F.avg("y").alias("_mean"))
    high = F.col("y") > F.col("_mean")
    tied = spread.groupBy(*group, "y").agg(
        F.count(F.lit(1)).alias("n"), F.min("p").alias("low"), F.max("p").alias("top"), F.min(F.when(high, F.col("p"))).alias("above"),
        F.max(F.when(F.col("y") < F.col("_mean"), F.col("p"))).alias("under"), F.max(F.isnan("p") | (F.abs("p") == float("inf"))).alias("strange"))
    out = tied.groupBy(*group).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min("low").alias("low"), F.max("top").alias("top"),
        (F.max("under") - F.min("above")).alias("far"), F.max("strange").alias("strange"))
    return out.select(
        *group, F.expr("(n * n - squares) DIV 2").alias("pairs"), "strange",
        ((F.col("low") == F.col("top")) & ~F.col("strange")).alias("even"),
        F.coalesce(F.exp("far") == float("inf"), F.lit(False)).alias("endless"))


def _pair_losses(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """``s``: sum over the pairs of a group, one block of two tiles at a time."""
    spark = rows.sparkSession
    ship_package(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    block = tiles.blocks(rows, group, "asset", ["p", "y"], size, parts)
    sides = [F.transform(side, lambda m: m[c]).alias(f"{side}_{c}") for side in ("left", "right") for c in ("p", "y")]
    block = block.select(*group, (F.col("i") < F.col("j")).alias("across"), *sides)
    schema = rows.select(*group).withColumn("s", F.lit(0.0)).schema

    def run(batches):
        for b in batches:
            cells = [[np.asarray(x.values) for x in b.column(f"{side}_{c}")] for side in ("left", "right") for c in ("p", "y")]
            sums = [_block_loss(*arrays, across) for *arrays, across in zip(*cells, b.column("across").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in group], pa.array(sums, pa.float64())], [*group, "s"])

    return block.mapInArrow(run, schema).groupBy(*group).agg(F.sum("s").alias("s"))


def _block_loss(p: np.ndarray, y: np.ndarray, q: np.ndarray, z: np.ndarray, across: bool) -> float:
    """Each pair of the two sides once: the member with the larger target should have the larger prediction.  NaN is the largest target."""
    y, z = (np.where(np.isnan(x), np.inf, x)[:, None] for x in (y, z))
    with np.errstate(over="ignore", invalid="ignore"):
        ahead = q - p[:, None]
        total = np.log1p(np.exp(ahead[y > z.T])).sum()
        if across:
            total += np.log1p(np.exp(-ahead[z.T > y])).sum()
    return float(total)
