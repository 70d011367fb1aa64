"""Sources: typed scans, schema tolerance, aliases and report ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import schema


def read_bars(spark: SparkSession, path: str, columns: list[str], where: str | None = None) -> DataFrame:
    """Parquet scan of the named columns; the filter is pushed to the files."""
    df = spark.read.parquet(path)
    return (df.where(where) if where else df).select(*columns)


def read_tolerant(spark: SparkSession, paths: list[str], contract: T.StructType, keep_types: tuple[str, ...] = ()) -> DataFrame:
    """Files of differing vintage under one contract; columns a file lacks are null."""
    out = None
    for p in paths:
        part = schema.enforce_schema(spark.read.parquet(p), contract, keep_types)
        out = part if out is None else out.unionByName(part)
    return out


def read_csv(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Headed CSV with a given schema (never inferred)."""
    return spark.read.csv(path, header=True, schema=contract)


def read_table(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """Parquet or CSV by file name."""
    return read_csv(spark, path, contract) if path.rstrip("/").endswith(".csv") else spark.read.schema(contract).parquet(path)


def pick(df: DataFrame, names: list[str], label: str) -> str:
    """First of several accepted column names that the table has."""
    for n in names:
        if n in df.columns:
            return n
    raise ValueError(f"no {label} column among {names}; have {df.columns}")


def resolve(df: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """Rename the first present alias of each canonical column."""
    return df.withColumnsRenamed({pick(df, names, c): c for c, names in aliases.items()})


def canonical(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Provider column names to canonical ones; names that are absent are ignored."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def json_fields(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Typed fields of a JSON text column under a stated schema."""
    spec = ", ".join(f"{n} {t}" for n, t in fields.items())
    return df.select("*", F.from_json(column, spec).alias("_j")).select("*", *[F.col(f"_j.{n}").alias(n) for n in fields]).drop("_j")


def to_metrics(df: DataFrame, ids: list[str], measures: list[str]) -> DataFrame:
    """Wide measures as (metric, value) rows."""
    return df.unpivot(ids, [F.col(m).cast("double").alias(m) for m in measures], "metric", "value")


def union_runs(runs: list[tuple[dict[str, str], DataFrame]]) -> DataFrame:
    """Tables of several runs under each other, tagged with constants; absent columns become null."""
    out = None
    for tags, df in runs:
        part = df.withColumns({k: F.lit(v) for k, v in tags.items()})
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pending(planned: DataFrame, landed: DataFrame, keys: list[str]) -> DataFrame:
    """Planned partitions that have not landed."""
    return planned.join(landed.select(*keys), keys, "left_anti")
