"""Group members as bounded arrays, for sums over pairs without emitting pairs.

A group is spread over hash tiles of about ``size`` members, and each two of its
tiles meet in a block of their own, keyed by (group, i, j) with i <= j.  A block
folds over its two tiles inside an expression, so the members moved are
``n * ceil(n / size)`` rather than ``n * n``, no row meets a bare group key once
tiles are built, and a task's unit of work is one block of ``size * size`` pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256


def tiles(df: DataFrame, keys: list[str], member: str, fields: list[str], size: int = SIZE) -> DataFrame:
    """One row per (keys, tile) with ``members``: an array of structs of ``fields``; ``tiles`` is the group's number of them."""
    n = df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_tiles"))
    spread = df.join(n, keys).withColumn("_tile", F.pmod(F.xxhash64(member), F.col("_tiles")))
    return spread.groupBy(*keys, F.col("_tile").alias("tile")).agg(F.collect_list(F.struct(*fields)).alias("members"), F.first("_tiles").alias("tiles"))


def blocks(df: DataFrame, keys: list[str], member: str, fields: list[str], size: int = SIZE, parts: int | None = None) -> DataFrame:
    """One row per (keys, i, j), i <= j, with the members of both tiles as ``left`` and ``right`` (the same where i = j).

    Blocks are small for the work in them, so by their bytes few tasks would get them all; ``parts`` deals them to that many.
    """
    t = tiles(df, keys, member, fields, size)
    dealt = t.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tiles").cast("bigint") - 1)))
    dealt = dealt.select(*keys, F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"), "tile", "members")
    dealt = dealt.repartition(parts, *keys, "i", "j") if parts else dealt
    side = lambda c: F.first(F.when(F.col("tile") == F.col(c), F.col("members")), ignorenulls=True)
    return dealt.groupBy(*keys, "i", "j").agg(side("i").alias("left"), side("j").alias("right"))
