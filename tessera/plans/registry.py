"""Registry of runnable queries and their SQL twins.

``cols`` declares the result: ``name:type`` with type ``f`` (double, rounded to
six decimals, ``f2`` to two, and from 1 up to eight significant digits), ``g``
(double, five decimals and six digits, for tables so large that some value lies
within the engines' difference of a finer tie), ``i`` (bigint), ``b`` (boolean), ``d`` (date) or nothing (taken as is).  The same casts
apply to both engines so results compare by value; the data is not rounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: From here on results are compared by significant digits; a factor moves decimal ties, which engines round unlike, off the tie.
LARGE, OFF_TIE = 1, 1.000000000003


def _parse(cols: str) -> list[tuple[str, str]]:
    return [(n, t) for n, _, t in (c.partition(":") for c in cols.split())]


def _precision(kind: str) -> tuple[int, str]:
    return (5, "%.5e") if kind == "g" else (int(kind[1:] or 6), "%.7e")


def _spark_col(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith(("f", "g")):
        places, shape = _precision(kind)
        c = F.round(c.cast("double"), places)
        c = F.when(F.abs(c) >= LARGE, F.format_string(shape, c * OFF_TIE).cast("double")).otherwise(c)
    elif kind == "i":
        c = c.cast("bigint")
    elif kind == "d":
        c = c.cast("date")
    return c.alias(name)


def _sql_col(name: str, kind: str) -> str:
    if kind.startswith(("f", "g")):
        places, shape = _precision(kind)
        r = f"round(CAST({name} AS DOUBLE), {places})"
        return f"CASE WHEN abs({r}) >= {LARGE} THEN CAST(printf('{shape}', {r} * CAST({OFF_TIE} AS DOUBLE)) AS DOUBLE) ELSE {r} END + 0.0 AS {name}"
    if kind == "i":
        return f"CAST({name} AS BIGINT) AS {name}"
    if kind == "d":
        return f"CAST({name} AS DATE) AS {name}"
    return name


def query(name: str, cols: str, ctes: str = "", sql: str | None = None):
    """Register a query; ``ctes`` precede ``sql`` in the oracle statement."""
    spec = _parse(cols)

    def wrap(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).select(*[_spark_col(n, k) for n, k in spec])

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if sql is not None:
            head = f"WITH {ctes}\n" if ctes else ""
            picks = ", ".join(_sql_col(n, k) for n, k in spec)
            ORACLES[name] = f"{head}SELECT {picks} FROM (\n{sql.strip()}\n) AS q"
        return fn

    return wrap
