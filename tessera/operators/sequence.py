"""Trailing sequences per signal and train-only robust scaling.

Signals are merged into the asset's own ordered run, so one range window yields
the trailing slice of every signal: the panel is shuffled once and never
multiplied by the sequence length.  ``window_features`` makes the arrays that models
read in the tasks that hold an asset's rows, so they are neither shuffled nor stored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset
from tessera.functions.ranking import exact_quantiles
from tessera.session import ship_package

# Clip of scaled features, smallest usable spread.
CLIP = 10.0
MIN_SPREAD = 1e-8


def assemble(signals: DataFrame, panel: DataFrame, measures: list[str], length: int) -> DataFrame:
    """``slots``: one struct per session of the last ``length``, null where the asset has no row.

    A signal of an asset the panel does not know keeps an all-null window.
    """
    keys = ["country", "asset", "session_id"]
    cell = F.struct(*measures)
    p = panel.select(*keys, F.struct(F.col("session_id").alias("k"), cell.alias("v")).alias("c"), F.lit(False).alias("sig"))
    s = signals.select(*keys).distinct().select(*keys, F.lit(None).cast(p.schema["c"].dataType).alias("c"), F.lit(True).alias("sig"))
    w = by_asset().rangeBetween(-length + 1, 0)
    run = p.unionByName(s).withColumn("run", F.collect_list("c").over(w)).where("sig")
    known = F.map_from_entries("run")
    steps = F.sequence(F.lit(0), F.lit(length - 1))
    slots = F.transform(steps, lambda k: F.try_element_at(known, F.col("session_id") - (length - 1) + k))
    return run.select(*keys, slots.alias("slots"))


def long_form(assembled: DataFrame) -> DataFrame:
    """One row per step."""
    return assembled.select("country", "asset", "session_id", F.posexplode("slots").alias("step", "cell")).select(
        "country", "asset", "session_id", "step", F.col("cell").isNotNull().alias("present"), "cell.*")


def complete(assembled: DataFrame) -> DataFrame:
    """Windows without an empty slot."""
    return assembled.where(F.forall("slots", lambda s: s.isNotNull()))


def summarise(assembled: DataFrame, measures: list[str]) -> DataFrame:
    """Last value, mean, population deviation, minimum and maximum of present values, inside the array."""
    cols: list[Column] = []
    for m in measures:
        cols += _moments(m)
    return assembled.select("country", "asset", "session_id", *cols)


def _moments(m: str) -> list[Column]:
    every = F.transform("slots", lambda s: s.getField(m))
    vals = F.filter(every, lambda x: x.isNotNull())
    n = F.size(vals)

    def mean_of(arr: Column) -> Column:
        return F.when(n > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n)

    mean = mean_of(vals)
    # held in a struct of a lambda variable, so the mean is computed once and not per element
    held = F.array(F.struct(vals.alias("x"), mean.alias("mean")))
    squares = F.element_at(F.transform(held, lambda h: F.transform(h.x, lambda x: (x - h.mean) * (x - h.mean))), 1)
    spread = F.sqrt(mean_of(squares))
    parts = {"last": F.element_at(every, -1), "mean": mean, "std": spread, "min": F.array_min(vals), "max": F.array_max(vals)}
    return [c.alias(f"{m}_{k}") for k, c in parts.items()]


def flat_cells(measures: list[str], fill: float = 0.0) -> Column:
    """Array of length steps times measures; empty cells take ``fill``."""
    return F.flatten(F.transform("slots", lambda s: F.array(*[F.coalesce(s.getField(m), F.lit(fill)) for m in measures])))


def flatten(assembled: DataFrame, measures: list[str], fill: float = 0.0) -> DataFrame:
    """One ML vector per signal of its flat cells."""
    from pyspark.ml.functions import array_to_vector

    return assembled.select("country", "asset", "session_id", array_to_vector(flat_cells(measures, fill)).alias("features"))


def _cells(batches, measures: list[str], length: int, scale: tuple | None = None):
    """Each batch with its wanted rows and their cells (row, step, measure), NaN where the asset has no value.

    Rows come by asset and session; the last ``length - 1`` of a batch are kept for the next one.
    """
    run, session, x = np.empty(0, dtype=int), np.empty(0, dtype=int), np.empty((0, len(measures)))
    before = None
    for b in batches:
        if not b.num_rows:
            continue
        names = [b.column(c) for c in ("asset", "country")]
        other = np.zeros(b.num_rows, dtype=bool)
        for c in names:
            other[1:] |= pc.not_equal(c.slice(1), c.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        other[0] = before != [c[0] for c in names]
        before = [c[-1] for c in names]
        run = np.concatenate([run, (run[-1] if len(run) else 0) + np.cumsum(other)])
        session = np.concatenate([session, b.column("session_id").to_numpy(zero_copy_only=False)])
        new = np.column_stack([b.column(m).to_numpy(zero_copy_only=False) for m in measures])
        if scale:
            centre, spread, clip = scale
            new = np.clip((np.where(np.isnan(new), centre, new) - centre) / spread, -clip, clip)
        x = np.concatenate([x, new])
        rows = np.flatnonzero(b.column("_wanted").to_numpy(zero_copy_only=False))
        own = rows + len(x) - b.num_rows
        cells = np.full((len(rows), length, len(measures)), np.nan)
        for back in range(min(length, len(x))):
            at = np.maximum(own - back, 0)
            step = length - 1 - (session[own] - session[at])
            held = np.flatnonzero((own >= back) & (run[at] == run[own]) & (step >= 0))
            cells[held, step[held]] = x[at[held]]
        yield b, rows, cells
        kept = slice(max(0, len(x) - length + 1), None)
        run, session, x = run[kept], session[kept], x[kept]


def _flat(cells: np.ndarray) -> np.ndarray:
    return cells.reshape(len(cells), -1)


def _summary(cells: np.ndarray) -> np.ndarray:
    """Per measure the last value and the mean, population deviation, minimum and maximum of its values."""
    has = ~np.isnan(cells)
    n = np.maximum(has.sum(axis=1), 1)
    mean = np.where(has, cells, 0.0).sum(axis=1) / n
    spread = np.sqrt((np.where(has, cells - mean[:, None], 0.0) ** 2).sum(axis=1) / n)
    low, high = np.where(has, cells, np.inf).min(axis=1), np.where(has, cells, -np.inf).max(axis=1)
    parts = np.stack([cells[:, -1], mean, spread, low, high], axis=2)
    parts[~has.any(axis=1)] = np.nan
    return parts.reshape(len(cells), -1)


def window_features(panel: DataFrame, measures: list[str], length: int, wanted: str, keep: list[str], summaries: bool = False,
                    stats: DataFrame | None = None, clip: float = CLIP, fill: float = 0.0) -> DataFrame:
    """``keep`` and ``features`` of the rows that meet the condition ``wanted``: their last ``length`` sessions as ``flatten`` has them, or the ``summaries`` of ``summarise`` by measure.

    Every row of the panel can be part of a window.  With ``stats``, the row of ``robust_fit``, measures are scaled as
    ``robust_apply`` does.  Nulls and NaN are no values; what still has none takes ``fill``.
    """
    ship_package(panel.sparkSession)
    keys = ["asset", "country", "session_id"]
    held = panel.select(*dict.fromkeys([*keys, *keep, *measures]), F.coalesce(F.expr(wanted), F.lit(False)).alias("_wanted"))
    schema = panel.select(*keep).withColumn("features", F.array(F.lit(0.0))).schema
    shape = _summary if summaries else _flat
    fixed = None if stats is None else stats.select(*[f"{m}_{k}" for k in ("median", "iqr") for m in measures]).first()
    scale = None if fixed is None else (*np.array(fixed, dtype=float).reshape(2, -1), clip)

    def run(batches):
        for b, rows, cells in _cells(batches, measures, length, scale):
            if not len(rows):
                continue
            x = shape(cells)
            x = np.where(np.isnan(x), fill, x)
            ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c).take(pa.array(rows)) for c in keep], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], [*keep, "features"])

    return held.repartition(*keys[:2]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def window_counts(rows: DataFrame, fit: Column, length: int) -> DataFrame:
    """How many fitted windows of ``length`` sessions contain each row of the asset."""
    w = by_asset().rangeBetween(0, length - 1)
    return rows.withColumn("freq", F.count_if(fit).over(w))


def robust_fit(rows: DataFrame, measures: list[str], weight: str | None = None) -> DataFrame:
    """One row: median and interquartile range per measure; a degenerate range counts as one."""
    picks = {}
    for m in measures:
        picks |= {m + "_q1": (m, 0.25), m + "_q2": (m, 0.5), m + "_q3": (m, 0.75)}
    q = exact_quantiles(rows if weight is None else rows.where(F.col(weight) > 0), [], picks, weight)
    out = []
    for m in measures:
        iqr = F.col(m + "_q3") - F.col(m + "_q1")
        out += [F.coalesce(m + "_q2", F.lit(0.0)).alias(m + "_median"),
                F.when(iqr >= MIN_SPREAD, iqr).otherwise(1.0).alias(m + "_iqr")]
    return q.select(*out)


def robust_apply(rows: DataFrame, stats: DataFrame, measures: list[str], clip: float | None = CLIP) -> DataFrame:
    """Nulls to the median, centre, scale and clip with the fitted statistics (a single row)."""
    fixed = {c: stats.select(c).scalar() for m in measures for c in (m + "_median", m + "_iqr")}
    cols = []
    for m in measures:
        x = (F.coalesce(F.col(m), fixed[m + "_median"]) - fixed[m + "_median"]) / fixed[m + "_iqr"]
        if clip is not None:
            x = F.least(F.greatest(x, F.lit(-clip)), F.lit(clip))
        cols.append(x.alias(m + "_scaled"))
    return rows.select("*", *cols)
