"""Logical table contracts: column lists, casting and key checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def struct(spec: str) -> T.StructType:
    """``"asset:bigint close:double"`` as a StructType."""
    out = T.StructType()
    for name, kind in (p.split(":") for p in spec.split()):
        out = out.add(name, kind)
    return out


BARS = struct(
    "country:string asset:string date:date open:double high:double low:double close:double "
    "volume:double bid:double ask:double total_return_pct:double currency:string extract_ts:timestamp"
)
CAPS = struct("country:string asset:string snapshot_date:date market_cap:double")
CASH = struct("country:string date:date rf_daily:double rf_source:string")
FORECASTS = struct(
    "model:string seed:integer country:string date:date asset:string split:string "
    "training_cutoff:date prediction:double target:double target_available:boolean"
)
WEIGHTS = struct(
    "strategy:string country:string signal_date:date execution_date:date asset:string target_weight:double"
)
MANIFEST = struct("path:string bytes:long sha256:string")


def enforce_schema(df: DataFrame, schema: T.StructType, keep_types: tuple[str, ...] = ()) -> DataFrame:
    """Cast to the contract, add absent columns as null, drop the rest.

    ``keep_types`` names columns whose own type is kept (an id may be text or
    integer).  Bad text becomes null instead of raising.
    """
    present = dict(df.dtypes)

    def one(field: T.StructField) -> Column:
        if field.name not in present:
            return F.lit(None).cast(field.dataType).alias(field.name)
        if field.name in keep_types or present[field.name] == field.dataType.simpleString():
            return F.col(field.name)
        return F.col(field.name).try_cast(field.dataType).alias(field.name)

    return df.select(*[one(f) for f in schema.fields])


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Fail while the plan is being built when a required column is absent."""
    absent = missing_columns(df, required)
    if absent:
        raise ValueError(f"missing required columns: {absent}")
    return df


def column_report(df: DataFrame, required: list[str]) -> DataFrame:
    """One row per required column: how many rows carry a value, and whether it exists."""
    cells = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(c in df.columns).alias("present"),
            (F.count(F.col(c)) if c in df.columns else F.lit(0).cast("bigint")).alias("non_null"),
        )
        for c in required
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key combinations that occur more than once (empty when the key is unique)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Action: raise when ``keys`` do not identify rows; return ``df`` unchanged."""
    bad = duplicate_keys(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"duplicate key {keys}: {[r.asDict() for r in bad]}")
    return df
