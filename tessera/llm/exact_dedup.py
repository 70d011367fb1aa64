"""Exact deduplication against a persistent digest index.

The index is a parquet table bucketed and sorted by digest.  A batch is reduced
to one row per digest (combined before the exchange, so a group of copies may
hold any share of it), dealt into the index's buckets, and anti-joined with the
index by sort-merge without moving the index; what is new is appended.  The batch's
digests then meet the index again in the same buckets, and only what the batch has
copies of, or an earlier batch brought, is joined with the batch's rows, whose hot
keys adaptive execution can split.

``dedup`` takes one table in batches of falling id ranges through an index of its
own, so the batch that brings a digest holds its largest id, and later batches
lose to the index by the anti-join.

Defined results: null texts equal empty ones; ids that are null rank below all
others; of rows that repeat an id and a text, one stays; an empty batch adds
nothing; further columns of the input are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialise, stage_folder

COLUMNS = "digest BINARY, keep_id BIGINT, keep_row BIGINT, copies BIGINT, batch BIGINT"


def buckets_for(rows: int, rows_per_bucket: int = 4_000_000, least: int = 16) -> int:
    """Buckets for an index that is to hold that many digests: a power of two."""
    n = least
    while n * rows_per_bucket < rows:
        n *= 2
    return n


class DigestIndex:
    """Digests seen so far, with the row that stands for each."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        """Open the index at ``path`` (created if absent); ``buckets`` must be as at its creation."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.table} ({COLUMNS}) USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    @classmethod
    def scratch(cls, spark: SparkSession, buckets: int) -> DigestIndex:
        """An empty index in the shared folder of the session."""
        return cls(spark, f"{stage_folder(spark)}/digest-index-{uuid.uuid4().hex}", buckets)

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the table; its files stay."""
        self.spark.sql(f"DROP TABLE {self.table}")

    def fresh(self, groups: DataFrame) -> DataFrame:
        """The groups (one row per digest) that the index does not hold."""
        return groups.repartition(self.buckets, "digest").hint("merge").join(self.rows().select("digest"), "digest", "left_anti")

    def held(self, groups: DataFrame) -> DataFrame:
        """The index's rows of these digests."""
        return self.rows().hint("merge").join(groups.select("digest").repartition(self.buckets, "digest"), "digest")

    def add(self, rows: DataFrame) -> tuple[int, DataFrame]:
        """Append the new digests of ``rows`` (doc_id, row, digest); the batch's number and its groups."""
        batch = (self.rows().agg(F.max("batch")).first()[0] or 0) + 1
        groups = materialise(rows.groupBy("digest").agg(F.max(F.struct("doc_id", "row")).alias("top"), F.count(F.lit(1)).alias("copies")))
        self.fresh(groups).select("digest", "top.doc_id", "top.row", "copies", F.lit(batch).cast("bigint")).write.insertInto(self.table)
        return batch, groups

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
        """Append the batch's new digests; one row per document of the batch.

        Columns: doc_id, digest, keep_id, group_size, kept, and ``carried`` if asked
        for.  Within a batch the largest id of equal texts stays; a text that an
        earlier batch holds is not kept.  ``group_size`` counts the batch that
        brought the digest.
        """
        rows = _digested(docs, id_col, text_col, carry)
        batch, groups = self.add(rows)
        return _decided(rows, materialise(self.held(groups).where((F.col("copies") > 1) | (F.col("batch") < batch))), carry, batch)


def _digested(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """Staged rows: doc_id, row, digest, and ``carried`` if asked for."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return materialise(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
            *([F.struct(*carry).alias("carried")] if carry else []),
        )
    )


def _decided(rows: DataFrame, several: DataFrame, carry: tuple[str, ...], batch: int | None = None) -> DataFrame:
    """Each row by its group of ``several``; a row without one is its digest's only one, and a group of an earlier batch keeps none."""
    joined = rows.hint("merge").join(several, "digest", "left")
    own = F.lit(True) if batch is None else F.col("batch") == batch
    return joined.select(
        "doc_id",
        "digest",
        F.when(F.col("batch").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1)).cast("bigint").alias("group_size"),
        (F.col("batch").isNull() | (own & (F.col("keep_row") == F.col("row")))).alias("kept"),
        *(["carried"] if carry else []),
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), batches: int = 2) -> DataFrame:
    """Deduplicate one table against itself, in batches through an index of its own; ``group_size`` counts the whole table.

    The ranges of ids may be uneven: where they are cut changes no result.
    """
    spark = docs.sparkSession
    rows = _digested(docs, id_col, text_col, carry)
    shares = [k / batches for k in range(batches - 1, 0, -1)]
    seen = rows.agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx("doc_id", s).alias(f"c{k}") for k, s in enumerate(shares)]).first()
    index = DigestIndex.scratch(spark, buckets_for(seen.n))
    above = None
    for cut in [*seen[1:], None]:
        batch = rows if cut is None else rows.where(F.col("doc_id") > cut)
        if above is not None:
            batch = batch.where(F.coalesce(F.col("doc_id") <= above, F.lit(True)))
        index.add(batch.select("doc_id", "row", "digest"))
        above = cut if cut is not None else above
    sizes = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    several = index.rows().hint("merge").join(sizes.repartition(index.buckets, "digest"), "digest").withColumn("copies", F.col("_n")).drop("_n")
    several = materialise(several)
    index.close()
    return _decided(rows, several, carry)
