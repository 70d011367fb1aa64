"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_by_country(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one directory per country.

    Rows keep their partitioning, so a large country is written by many tasks.
    """
    df.write.mode(mode).partitionBy("country").parquet(path)


def write_by_month(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet with one directory and one file per country and month of ``date``; months are bounded, countries are not."""
    months = df.withColumn("month", F.date_format("date", "yyyy-MM")).repartition("country", "month")
    months.write.mode(mode).option("maxRecordsPerFile", 0).partitionBy("country", "month").parquet(path)


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Twin parquet and CSV copies; an empty ledger still writes its schema."""
    df.write.mode(mode).parquet(f"{path}.parquet")
    df.write.mode(mode).option("header", True).csv(f"{path}.csv")
