"""Cleaning, de-duplication and row-level derivations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.expr import by_asset, col, safe_div

# Identifier format, share-class wording, fold boundaries are parameters elsewhere.
TICKER_PATTERN = "^[A-Z0-9]{2,10}$"
ORDINARY = "ordinary share"


def local_date(ts: str | Column, tz: str) -> Column:
    """Market-local date of a UTC instant."""
    return F.to_date(F.from_utc_timestamp(col(ts), tz))


def numeric(c: str | Column) -> Column:
    """Text as double; anything that is not a number becomes null."""
    return col(c).try_cast("double")


def clean_ids(df: DataFrame, c: str) -> DataFrame:
    """Trimmed upper-case identifiers of the accepted form, each once."""
    return (
        df.select(F.upper(F.trim(F.col(c))).alias(c)).where(F.col(c).rlike(TICKER_PATTERN)).distinct()
    )


def ordinary_shares(df: DataFrame, kind: str, code: str, wording: str = ORDINARY) -> DataFrame:
    """Rows described as ordinary shares whose root code has no lower-case letter."""
    root = F.split_part(F.col(code), F.lit("."), F.lit(1))
    return df.where(F.lower(F.col(kind)).contains(wording) & ~root.rlike("[a-z]"))


def _keep(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = pick(F.struct(*order, *[c for c in rest if c not in order]))
    return (
        df.groupBy(*keys)
        .agg(best.alias("_r"))
        .select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])
    )


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by ``order`` (then by the other columns).

    A struct maximum combines before the shuffle, so a key with very many copies
    moves one row per task instead of being sorted whole.
    """
    return _keep(df, keys, order, F.max)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _keep(df, keys, order, F.min)


def valid_bar(strict: bool = True) -> Column:
    """Complete bar with a positive close and non-negative volume; loose form asks close and volume only."""
    need = ["open", "high", "low", "close", "volume"] if strict else ["close", "volume"]
    ok = (F.col("close") > 0) & (F.col("volume") >= 0)
    for c in need:
        ok = ok & F.col(c).isNotNull()
    return F.coalesce(ok, F.lit(False))


def returns_with_source(df: DataFrame) -> DataFrame:
    """Total return where quoted, price return otherwise, and which one was used."""
    price = safe_div("close", F.lag("close").over(by_asset())) - 1
    total = F.col("total_return_pct") / 100
    return df.withColumn("_price", price).withColumn("return", F.coalesce(total, "_price")).withColumn(
        "return_source",
        F.when(total.isNotNull(), "total_return").when(F.col("_price").isNotNull(), "price").otherwise("missing"),
    ).drop("_price")


def quotes(df: DataFrame) -> DataFrame:
    """Quote validity, mid and spread; invalid quotes leave nulls."""
    mid = (F.col("bid") + F.col("ask")) / 2
    ok = F.coalesce((F.col("bid") >= 0) & (F.col("bid") <= F.col("ask")) & (mid > 0), F.lit(False))
    return (
        df.withColumn("quote_valid", ok)
        .withColumn("mid", F.when(F.col("quote_valid"), mid))
        .withColumn("quoted_spread", safe_div(F.col("ask") - F.col("bid"), "mid"))
        .withColumn("quoted_spread_bps", F.col("quoted_spread") * 10000)
    )


def combine(prices: DataFrame, returns: DataFrame, keys: list[str], how: str) -> DataFrame:
    """One-to-one combine of a price and a return table: ``left`` or ``full``."""
    return prices.join(returns, keys, how)


def missing_dates(calendar: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Calendar entries the series lacks; empty means complete coverage."""
    return calendar.join(series, keys, "left_anti")


def map_with_default(df: DataFrame, lookup: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left lookup of a static attribute with a default."""
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def split_by_date(date: str | Column, bounds: list[tuple[str, str, str]], default: str) -> Column:
    """Label of the first ``(name, first, last)`` range that holds the date."""
    d, out = col(date), None
    for name, lo, hi in bounds:
        test = d.between(F.to_date(F.lit(lo)), F.to_date(F.lit(hi)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)


def split_by_span(signal: str, leave: str, bounds: list[tuple[str, str, str]], default: str) -> Column:
    """As :func:`split_by_date`, but the exit must also fall inside the range."""
    out = None
    for name, lo, hi in bounds:
        test = (F.col(signal) >= F.to_date(F.lit(lo))) & (F.col(leave) <= F.to_date(F.lit(hi)))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise(default)
