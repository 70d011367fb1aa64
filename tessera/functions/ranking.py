"""Exact ordering statistics over groups of any size.

A window over a group sorts the whole group in one task.  Cross-sections can hold
an arbitrary number of rows, so rows of a group above ``RANGE_ROWS`` are dealt by (group, range),
where ranges are cut from the order of the group.  Rows are counted per group first; only large groups have cut
points, the keys of one row in ``RANGE_ROWS`` chosen by hash and of these about ``CUTS`` in
all, so the table that rows look their group up in is bounded.  A row of a small group is compared
with nothing, one of a large group finds its range by halving.  Rows are exchanged
once.  A window inside each (group, range) gives running sums; a large group
has its earlier ranges' sums carried on to the later ones, a few rows per
cut point, which bounds that broadcast too.  Counts, cut points and carried sums are
branches of the same lazy plan: nothing runs before the action, and every input
takes the same way.

Group keys may be null; order keys must be a total order where positions matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.expr import col

#: One in this many order keys of a large group is a cut point, the mean size of a range; smaller groups have none.
RANGE_ROWS = 500_000
#: About as many cut points at most; beyond, ranges grow with the table.
CUTS = 4096
#: Steps of the search by halving; any cut points beyond their sum are left out.
STEPS = [2**k for k in range(13, -1, -1)]


def _same(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [x.eqNullSafe(y) for x, y in zip(a, b)], F.lit(True))


def _cut_points(raw: DataFrame, keys: list[str], kept: list[str], range_rows: int) -> DataFrame:
    """Groups of more than ``range_rows`` rows, their keys named ``kept``, with their sorted cut points ``_cuts``."""
    n = F.count(F.lit(1)).alias("_n")
    large = raw.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, kept)]).agg(n).where(F.col("_n") > range_rows)
    # one row per large group, so at most one in range_rows of the table
    every = F.ceil(F.sum("_n").over(W.partitionBy(F.lit(1))) / CUTS)
    large = large.select(*kept, F.greatest(F.lit(range_rows).cast("bigint"), every).alias("_every"))
    rows = raw.select(*keys, "_at").join(F.broadcast(large), _same([F.col(k) for k in keys], [F.col(c) for c in kept]))
    cuts = F.sort_array(F.collect_set("_at"))
    return rows.where(F.pmod(F.xxhash64("_at"), "_every") == 0).groupBy(*kept).agg(F.slice(cuts, 1, sum(STEPS)).alias("_cuts"))


def _in_ranges(d: DataFrame, keys: list[str], kept: list[str], cuts: DataFrame, how: str = "left") -> DataFrame:
    """Rows with their range, the number of cut points of the group below them, and the group's ``_cuts``, null without any."""
    d = d.join(F.broadcast(cuts), _same([F.col(k) for k in keys], [F.col(c) for c in kept]), how).drop(*kept)
    below = lambda k: (k <= F.size("_cuts")) & (F.get(F.col("_cuts"), k - 1) < F.col("_at"))
    found = F.aggregate(F.array(*[F.lit(k) for k in STEPS]), F.lit(0), lambda n, k: F.when(below(n + k), n + k).otherwise(n))
    return d.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(found))


def _tied() -> Column:
    """Whether a cut point next to the row has its first order key too."""
    next_to = [F.get(F.col("_cuts"), place) for place in (F.col("_range") - 1, F.col("_range"))]
    same = [c.isNotNull() & c["o0"].eqNullSafe(F.col("_o0")) for c in next_to]
    return F.coalesce(same[0] | same[1], F.lit(False))


def _carried(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """Per large group and range, ``_r``: weight of the range ``_t``, of the ranges before, of the group."""
    parts = rows.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, kept)], F.col("_range").alias("_r")).agg(F.sum("_w").alias("_t"))
    group = W.partitionBy(*kept)
    before = F.sum("_t").over(group.orderBy("_r").rowsBetween(W.unboundedPreceding, -1))
    return parts.select(*kept, "_r", "_t", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_t").over(group).alias("_whole"))


def prefix_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str | Column],
    weight: str | Column,
    out: str,
    total: str | None = None,
    rank: str | None = None,
    range_rows: int = RANGE_ROWS,
    source: tuple[DataFrame, Column] | None = None,
) -> DataFrame:
    """Inclusive running sum of ``weight`` per ``keys`` in ascending ``order``, and the group's sum as ``total``.

    ``order`` must be a total order within the group (negate a number for descending).
    With weights of 1, ``rank`` is the mean position of the rows that share the first order
    key; a key that a cut point divides has its counts carried too.  ``source`` is a table of
    the same rows, or one that ``df`` sums up by keys and order, and its weight: cut points and
    carried sums are taken from there, so that what made ``df`` is not done again for them.
    """
    names, kept = [f"_o{i}" for i in range(len(order))], [f"_k{i}" for i in range(len(keys))]
    at = F.struct(*[F.col(n).alias(n[1:]) for n in names]).alias("_at")
    ordered = lambda x, w: x.select("*", *[col(c).alias(n) for c, n in zip(order, names)], w.alias("_w")).select("*", at)
    raw = ordered(*source) if source else ordered(df, col(weight))
    raw = raw.select(*dict.fromkeys(keys), *names, "_w", "_at")
    cuts = _cut_points(raw, keys, kept, range_rows)
    d = _in_ranges(ordered(df, col(weight)), keys, kept, cuts)
    d = d.withColumn("_tied", _tied()).drop("_at", "_cuts")
    here = [F.col(k) for k in keys]
    # without large groups nothing is carried, and these branches read nothing
    large = _in_ranges(raw, keys, kept, cuts, "inner")
    carried = _carried(large, keys, kept)
    d = d.join(F.broadcast(carried.drop("_t")), _same([*here, F.col("_range")], [*[F.col(n) for n in kept], F.col("_r")]), "left").drop(*kept, "_r")
    part = W.partitionBy(*keys, "_range")
    d = d.withColumn(out, F.sum("_w").over(part.orderBy(*names).rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0)))
    if rank:
        # a divided key ends the first range that it lies in, so what is before it there is all that is not it
        tied = large.where(_tied()).groupBy(*[F.col(k).alias(f"_v{i}") for i, k in enumerate(keys)], F.col("_o0").alias("_v"), "_range").agg(F.sum("_w").alias("_c"))
        held = [F.col(f"_v{i}") for i in range(len(keys))]
        tied = tied.join(F.broadcast(carried), _same([*held, F.col("_range")], [*[F.col(n) for n in kept], F.col("_r")]))
        tied = tied.groupBy(*held, "_v").agg(F.min_by(F.col("_before") + F.col("_t") - F.col("_c"), "_range").alias("_below"), F.sum("_c").alias("_ties"))
        d = d.join(F.broadcast(tied), _same([*here, F.col("_o0"), F.col("_tied")], [*held, F.col("_v"), F.lit(True)]), "left")
        inside = F.avg(out).over(W.partitionBy(*keys, "_range", "_o0"))
        d = d.withColumn(rank, F.coalesce(F.col("_below") + (F.col("_ties") + 1) / 2, inside)).drop(*[f"_v{i}" for i in range(len(keys))], "_v", "_below", "_ties")
    if total:
        d = d.withColumn(total, F.coalesce("_whole", F.sum("_w").over(part)))
    return d.drop(*names, "_w", "_range", "_tied", "_before", "_whole")


def ordinal(
    df: DataFrame, keys: list[str], order: list[str | Column], out: str, total: str | None = None, rank: str | None = None, source: DataFrame | None = None, **kw
) -> DataFrame:
    """1-based position per ``keys`` in ascending total ``order``, the group's size as ``total``, the average rank of the first order key as ``rank``.

    ``source``: a table of the same rows, if making ``df`` again for the cut points is dear.
    """
    one = F.lit(1).cast("bigint")
    return prefix_sum(df, keys, order, one, out, total, rank, source=None if source is None else (source, one), **kw)


def ntile_of(position: str | Column, n: str | Column, k: int) -> Column:
    """Bucket 1..k of a 1-based position among ``n``: the first ``n % k`` buckets hold one more."""
    i, n = col(position).cast("bigint") - 1, col(n).cast("bigint")
    small = F.floor(n / k)
    extra = n % k
    edge = extra * (small + 1)
    return (
        F.when(i < edge, F.floor(i / (small + 1)))
        .otherwise(extra + F.floor(F.try_divide(i - edge, small)))
        .cast("int")
        + 1
    )


def average_rank(df: DataFrame, keys: list[str], value: str, out: str, **kw) -> DataFrame:
    """Rows with the ascending rank of their value, ties sharing their mean rank; rows with a null value are dropped.

    Ties lie in order of a hash of the row, so ranges divide a value that most rows share.
    """
    known = df.where(F.col(value).isNotNull())
    return ordinal(known, keys, [value, F.xxhash64(*known.columns)], "_p", rank=out, **kw).drop("_p")


def exact_quantiles(
    df: DataFrame, keys: list[str], picks: dict[str, tuple[str, float]], weight: str | None = None, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Exact linear-interpolated percentiles, ``picks`` mapping output to (column, share).

    Columns are reduced to (value, count) and positions taken from the running
    count; of a large group only the ranges that hold a wanted position are exchanged.
    ``weight`` repeats a row that many times.  A group without a value has
    nulls; without keys there is one row.
    """
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    columns = sorted({c for c, _ in picks.values()})
    cells = [F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v"), one.alias("_one")) for c in columns]
    long = df.select(*keys, F.inline(F.array(*cells)))
    # a row without a value keeps its group, by a count of zero before all values
    counted = F.col("_v").isNotNull() & (F.col("_one") > 0)
    by = [*keys, "_m"]
    rows = long.select(*by, F.when(counted, F.col("_v")).alias("_v"), F.when(counted, F.col("_one")).otherwise(0).alias("_w"))
    rows = rows.withColumn("_at", F.struct(F.col("_v").alias("o0")))
    kept = [f"_k{i}" for i in range(len(by))]
    cuts = _cut_points(rows, by, kept, range_rows)

    def holds(c: str, p: float) -> Column:
        pos = (F.col("_whole") - 1) * F.lit(float(p))
        inside = [(F.col("_before") <= k) & (k < F.col("_before") + F.col("_t")) for k in (F.floor(pos), F.ceil(pos))]
        return (F.col(kept[-1]) == c) & (inside[0] | inside[1])

    ranges = _carried(_in_ranges(rows, by, kept, cuts, "inner"), by, kept)
    # a large group without a counted value keeps its row
    ranges = ranges.where(reduce(lambda x, y: x | y, [holds(c, p) for c, p in picks.values()], F.col("_whole") == 0)).drop("_t")
    d = _in_ranges(rows, by, kept, cuts)
    d = d.join(F.broadcast(ranges), _same([*[F.col(k) for k in by], F.col("_range")], [*[F.col(n) for n in kept], F.col("_r")]), "left")
    d = d.where(F.col("_cuts").isNull() | F.col("_whole").isNotNull())
    summed = d.groupBy(*by, "_range", "_before", "_whole", "_v").agg(F.sum("_w").alias("_c"))
    part = W.partitionBy(*by, "_range")
    running = F.sum("_c").over(part.orderBy("_v").rowsBetween(W.unboundedPreceding, 0)) + F.coalesce("_before", F.lit(0))
    cum = summed.select("*", running.alias("_cum"), F.coalesce("_whole", F.sum("_c").over(part)).alias("_total"))
    first = F.col("_cum") - F.col("_c")

    def pick(c: str, p: float) -> Column:
        pos = (F.col("_total") - 1) * F.lit(float(p))
        mine = F.col("_m") == c

        def at(k: Column) -> Column:
            return F.max(F.when(mine & (first <= k) & (k < F.col("_cum")), F.col("_v")))

        lo, hi = at(F.floor(pos)), at(F.ceil(pos))
        return lo + (hi - lo) * F.max(F.when(mine, pos - F.floor(pos)))

    return cum.groupBy(*keys).agg(*[pick(c, p).alias(out) for out, (c, p) in picks.items()])
