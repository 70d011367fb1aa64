"""Labelled rows for the trained operators: the fold rule and a bounded training sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialise

#: Parts of the staged sample; partial sums that reach the driver are one per part.
PARTS = 16


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; fold 1 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 1, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, bound: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Staged (doc_id, text, label, half) of labelled rows outside the held-out fold.

    At most about ``bound`` labelled ids, chosen by a hash of the id when there are
    more; that many rows of two numbers are broadcast, so texts are not shuffled.
    An id labelled twice has its largest label.  ``half`` is a uniform number in
    [0, 1) for splits within the sample.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label_col).cast("int").alias("_label"))
    n = known.count()
    spread = lambda salt: F.pmod(F.xxhash64(F.lit(salt), F.col("_id")), F.lit(1 << 30)) / float(1 << 30)
    known = known.withColumnRenamed("doc_id", "_id")
    if n > bound:
        known = known.where(spread("sample") < bound / n)
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    picked = rows.join(F.broadcast(known), "_id")
    return materialise(picked.select(F.col("_id").alias("doc_id"), "text", F.col("_label").alias("label"), spread("half").alias("half")).repartition(PARTS))
