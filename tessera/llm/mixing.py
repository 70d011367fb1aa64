"""Mixing sources to target weights.

Words are summed per source, targets follow from weights with a ceiling per
source, and each document is emitted floor(rate) times plus one Bernoulli copy
with probability equal to the fraction.  The draw is a window of hex digits of
a hash of (id, text), so reruns agree whatever the partitioning.  Heavy-tailed
sizes make a single draw stray by several per cent, so one aggregation evaluates
``DRAWS`` such windows per source and the one whose words come nearest to the
target is taken; every window has the same probability per document.

Defined results: null texts have no words and are taken zero times in words;
null sources form one source, ordered last; sources without words get target 0;
repeated rows draw alike; an empty table gives no rows; columns that clash with
the computed ones are untouched, since results are built from the id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
DRAWS = 25
SHARE = 1.5
CEILING = 2


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def draw(digest: Column, k: Column) -> Column:
    """The k-th uniform number in [0, 1) of a hex digest: eight digits from place k on."""
    return F.conv(F.substr(digest, k + 1, F.lit(8)), 16, 10).cast("double") / F.lit(float(1 << 32))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = SHARE, ceiling: int = CEILING) -> DataFrame:
    """Target words per source (source, source_size, target), one row per source.

    Weights repeat over the sources in code point order.  With shares
    least(ceiling * size, level * weight), sources sorted by ceiling * size / weight
    reach their ceiling in that order, so the level is the first
    (words left) / (weight left) that the next source's ratio is not below.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    place = Window.orderBy(F.asc_nulls_last("source"))
    s = sizes.withColumn("weight", F.element_at(cycle, (F.pmod(F.row_number().over(place) - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.lit(ceiling) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weight_left)
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.struct(F.col("source").isNull(), F.col("source")), "level"))).over(every)["level"]
    s = s.withColumn("level", level)
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap").cast("double")))
    return s.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    text = F.col(text_col)
    rows = materialise(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            words(text).alias("size"),
            F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))).cast("binary")).alias("digest"),
            *([F.struct(*carry).alias("carried")] if carry else []),
        )
    )
    goal = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    goal = materialise(goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))))
    same = rows["source"].eqNullSafe(goal["source"])
    full = rows.join(goal, same).select(rows["*"], goal["source_size"], goal["target"], goal["rate"])
    fraction = F.col("rate") - F.floor("rate")
    trials = [F.sum(F.when(draw(F.col("digest"), F.lit(k)) < fraction, F.col("size")).otherwise(0)).alias(f"t{k}") for k in range(DRAWS)]
    tried = full.groupBy("source", "rate", "target", "source_size").agg(*trials)
    wanted = F.col("target") - F.floor("rate") * F.col("source_size")
    best = F.array_min(F.array(*[F.struct(F.abs(F.col(f"t{k}") - wanted).alias("off"), F.lit(k).alias("k")) for k in range(DRAWS)]))["k"]
    chosen = materialise(tried.select("source", "source_size", "target", "rate", best.alias("k")))
    same = rows["source"].eqNullSafe(chosen["source"])
    copies = (F.floor("rate") + (draw(F.col("digest"), F.col("k")) < fraction).cast("bigint")).cast("bigint")
    out = rows.join(chosen, same).select(rows["*"], "source_size", "target", copies.alias("copies"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["carried"] if carry else []))
