"""Sharding by histogram sort: equal bytes per shard, one exchange.

Rows are ordered by (hash of the text, hash of the id, row number of the staged
table).  A splitter is a position in that order.  Each round counts the exact
bytes below a fixed number of probes inside every open splitter's interval, in
one aggregation over a narrow staged table; the driver sees only those sums
(``probes`` per splitter, whatever the input).  Intervals shrink until a probe
lies within ``tolerance`` of its target.  Equal texts share the first key, so a
group of copies is cut only where no group border is near enough, and then by
the second key; a group may therefore hold any share of the table.

Defined results: a null text counts one byte and has the checksum of an empty
one; null ids and repeated rows are ordinary rows; an empty table gives no rows;
columns of the input that are not named are left out unless listed in ``carry``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

#: Largest value of a key; keys are hashes cut to 62 bits, so ``value + 1`` never overflows.
KEY_MAX = (1 << 62) - 1
LEVELS = ("k_text", "k_id", "k_row")


@dataclass
class Splitter:
    """Rows at or after (prefix, cut) lie right of it; while open, the cut is within [lo, hi]."""

    target: float
    prefix: tuple[int, ...] = ()
    lo: int = 0
    hi: int = KEY_MAX
    below: int = 0
    cut: int | None = None

    @property
    def interval(self) -> tuple:
        return (self.prefix, self.lo, self.hi)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus one; null has no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def keyed(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """Narrow table of keys, staged once: texts are read here and not again."""
    text, key = F.col(text_col), lambda c: F.shiftrightunsigned(F.xxhash64(c), 2)
    return materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            text_bytes(text).alias("size"),
            F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
            key(text).alias("k_text"),
            key(F.col(id_col)).alias("k_id"),
            F.monotonically_increasing_id().alias("k_row"),
            F.struct(*carry).alias("carried") if carry else F.lit(None).cast("string").alias("carried"),
        )
    )


def _at(prefix: tuple[int, ...]) -> Column:
    cond = F.lit(True)
    for name, value in zip(LEVELS, prefix):
        cond = cond & (F.col(name) == value)
    return cond


def _count_below(rows: DataFrame, intervals: list[tuple], probes: int) -> dict[int, list]:
    """Bytes, rows and key range between neighbouring probes of each interval: one aggregation."""
    cell = F.lit(None).cast("struct<i:int,j:bigint,v:bigint>")
    for i, (prefix, lo, hi) in enumerate(intervals):
        name, width = LEVELS[len(prefix)], (hi - lo) // probes + 1
        v = F.col(name)
        inside = _at(prefix) & (v >= lo) & (v <= hi)
        cell = F.when(inside, F.struct(F.lit(i).alias("i"), F.expr(f"({name} - {lo}L) div {width}L").alias("j"), v.alias("v"))).otherwise(cell)
    sums = (
        rows.select(cell.alias("cell"), "size")
        .where("cell is not null")
        .groupBy("cell.i", "cell.j")
        .agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("cell.v").alias("first"), F.max("cell.v").alias("last"))
    )
    out: dict[int, list] = {i: [] for i in range(len(intervals))}
    for r in sorted(sums.collect(), key=lambda r: (r.i, r.j)):
        out[r.i].append(r)
    return out


def _refine(s: Splitter, cells: list, slack: float) -> None:
    """Close the splitter on a probe within the slack, or narrow it to the cell that holds its target."""
    below, here = s.below, None
    for k, c in enumerate(cells):
        if below + c["bytes"] > s.target:
            here = k
            break
        below += c["bytes"]
    if here is None:
        s.cut = s.hi + 1
        return
    c = cells[here]
    left, right = s.target - below, below + c["bytes"] - s.target
    if min(left, right) <= slack or c["n"] == 1:
        s.cut = c["first"] if left <= right else c["last"] + 1
    elif c["first"] == c["last"]:
        s.prefix, s.lo, s.hi, s.below = (*s.prefix, c["first"]), 0, KEY_MAX, below
    else:
        s.lo, s.hi, s.below = c["first"], c["last"], below


def find_splitters(rows: DataFrame, shards: int, total: int, tolerance: float, probes: int) -> list[Splitter]:
    """Splitters of equal byte shares; each round is one scan of the narrow table."""
    out = [Splitter(target=total * k / shards) for k in range(1, shards)]
    slack = tolerance * total / shards
    while todo := [s for s in out if s.cut is None]:
        intervals = list(dict.fromkeys(s.interval for s in todo))
        cells = _count_below(rows, intervals, probes)
        place = {x: i for i, x in enumerate(intervals)}
        for s, i in [(s, place[s.interval]) for s in todo]:
            _refine(s, cells[i], slack)
    return out


def _right_of(s: Splitter) -> Column:
    """True for rows at or after the splitter in the order of the keys."""
    level = len(s.prefix)
    cond = F.col(LEVELS[level]) >= s.cut
    for name, value in reversed(list(zip(LEVELS, s.prefix))):
        cond = (F.col(name) > value) | ((F.col(name) == value) & cond)
    return cond


def shard_by_bytes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = 16,
    tolerance: float = 0.01,
    probes: int = 256,
    slot_rows: int = 65_536,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (and ``carried``).

    ``slot`` counts the rows of a shard from 0 without gaps.  Inside a shard, rows
    fall into hash buckets of about ``slot_rows`` (never by text, so copies
    spread); only a bucket is sorted in one task, and a running sum of bucket
    counts gives its first slot.
    """
    rows = keyed(docs, id_col, text_col, carry)
    sums = rows.agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).first()
    total, n = sums["b"] or 0, sums["n"]
    splitters = find_splitters(rows, shards, total, tolerance, probes) if n else []
    shard = sum((_right_of(s).cast("int") for s in splitters), F.lit(0))
    parts = max(8, -(-n // (shards * slot_rows)))
    placed = rows.withColumn("shard", shard).withColumn("part", F.pmod(F.xxhash64(*LEVELS), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = first.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_slot"))
    inside = Window.partitionBy("shard", "part").orderBy(*LEVELS)
    return placed.join(first, ["shard", "part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("first_slot") + F.row_number().over(inside) - 1).alias("slot"),
        *(["carried"] if carry else []),
    )


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, **options) -> None:
    """Write all columns of the documents into ``path/shard=k``, rows spread over files by slot."""
    out = shard_by_bytes(docs, id_col, text_col, shards, carry=tuple(docs.columns), **options)
    out.select("carried.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot")).write.partitionBy("_shard").parquet(path)
