"""Column expressions shared by the operators.  All stay on the JVM side."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: str | Column, b: str | Column) -> Column:
    """Quotient, null when the divisor is zero or null."""
    return F.try_divide(col(a), col(b))


def finite(c: str | Column) -> Column:
    """NaN and infinities as null."""
    x = col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def all_present(names: Iterable[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).isNotNull()
    return out


def by_asset(order: str = "session_id", keys: tuple[str, ...] = ("asset", "country")):
    """Rows of an asset in order.  The asset comes first, as a sort compares the start of its first key at little cost and few countries differ."""
    return W.partitionBy(*keys).orderBy(order)


def full_frame(agg: Callable[[Column], Column], x: str | Column, n: int, window) -> Column:
    """``agg`` over the last ``n`` rows, null unless all ``n`` hold a value."""
    frame = window.rowsBetween(-n + 1, 0)
    return F.when(F.count(col(x)).over(frame) == n, agg(col(x)).over(frame))


#: Up to so many rows a product names its rows one by one, as a sliding frame is folded anew for every row.
SHORT = 8


def growth(x: str | Column, first: int, last: int, window) -> Column:
    """Product of ``1 + x`` over the rows ``first..last`` from the current one, null unless all hold a value."""
    n = last - first + 1
    if n > SHORT:
        frame = window.rowsBetween(first, last)
        return F.when(F.count(col(x)).over(frame) == n, F.product(1 + col(x)).over(frame))
    return reduce(lambda a, b: a * b, [1 + (F.lead(col(x), k).over(window) if k else col(x)) for k in range(first, last + 1)])


def compounded(x: str | Column, n: int, window) -> Column:
    return growth(x, -n + 1, 0, window) - 1


def contiguous_diffs(n: int, window, session: str = "session_id") -> Column:
    """True when the last ``n`` session steps of the asset were all exactly one.

    The first row of an asset has no step, so this needs ``n + 1`` sessions; and
    rows are one per session, so the span of ids decides it without counting.
    """
    return F.coalesce(F.col(session) - F.lag(session, n).over(window) == n, F.lit(False))


def hash_index(n: str | Column, *parts) -> Column:
    """Deterministic index in ``[0, n)`` from the parts, same in any SQL engine."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint"), col(n).cast("bigint"))


# Coefficients of the published rational approximation of the
# inverse normal distribution (P. J. Acklam, relative error below 1.15e-9).
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
      1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
      6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
      -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]
_TAIL = 0.02425


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[0])
    for c in coefs[1:]:
        out = out * x + c
    return out


def normal_quantile(p: str | Column) -> Column:
    """Inverse of the standard normal distribution for ``0 < p < 1``."""
    p = col(p)
    q = p - 0.5
    centre = _poly(_A, q * q) * q / (_poly(_B, q * q) * (q * q) + 1)

    def tail(u: Column) -> Column:
        t = F.sqrt(-2 * F.ln(u))
        return _poly(_C, t) / (_poly(_D, t) * t + 1)

    return F.when(p < _TAIL, tail(p)).when(p > 1 - _TAIL, -tail(1 - p)).otherwise(centre)


def moment_corr(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation as a grouped aggregate, null for a constant side.

    ``F.corr`` divides by zero under ANSI mode; covariance and deviations use
    the same one-pass updates without that hazard.
    """
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.when((sx > 1e-12) & (sy > 1e-12), F.try_divide(F.covar_pop(x, y), sx * sy))


def attach_stats(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    """Add group aggregates to every row.

    Aggregating first and joining back combines map-side, so a group holding a
    large share of the rows never lands in one task as a window would put it;
    AQE broadcasts the aggregate when it is small and splits skewed keys when not.
    """
    return df.join(df.groupBy(*keys).agg(*aggs), keys, "left")
