"""Path-dependent rebalancing: the operator that needs state between executions.

A book (strategy, country, scenario) is one row: its executions in order, each
with its names.  ``F.aggregate`` folds them on the JVM with a map state, name to
weight; books run in parallel.  Names per execution are bounded by the top-n
universe and executions by the calendar, which bounds the row.

At an execution a name is valid (it has a target weight), frozen (it is in the
universe but cannot be traded, say for want of a covariance history) or gone.  A
frozen name keeps its weight from before the trade, valid names share what frozen
ones leave, and a held name that is gone is sold.  Without a valid name only
frozen ones stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ledger import book_of, rebalances

BOOK = ["strategy", "country", "scenario"]


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, as a lambda variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(array: Column, of: Callable[[Column], Column]) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + of(x))


def names_between(names: DataFrame, weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Names of each execution with the growth since the one before.

    ``names``: (strategy, country, execution_session, asset, target_weight, frozen), a
    target for valid names and none for frozen ones.  A name of the previous execution
    that is in neither state appears with neither.  Returns are compounded over each
    holding period; an unknown one carries the value.
    """
    book = book_of(weights)
    keys = [*book, "execution_session", "asset"]
    spans = rebalances(weights).where(F.col("next_session").isNotNull()).select(*book, "execution_session", "next_session")
    days = spans.select("*", F.explode(F.sequence(F.col("execution_session") + 1, F.col("next_session"))).alias("session_id"))
    before = names.select(*keys).join(F.broadcast(spans), [*book, "execution_session"])
    moves = returns.where(F.col("ret").isNotNull()).join(F.broadcast(days), ["country", "session_id"])
    growth = moves.groupBy(*keys).agg((F.product(1 + F.col("ret")) - 1).alias("growth"))
    carried = before.join(growth, keys, "left").select(*book, F.col("next_session").alias("execution_session"), "asset", "growth")
    out = names.select(*keys, "target_weight", "frozen").join(carried, keys, "full")
    return out.fillna({"growth": 0.0, "frozen": False})


def _before(weights: Column, e: Column) -> Column:
    """Rows (asset, pre, want, frozen) of an execution: carried weights grown and normalised."""
    grown = F.transform(e.names, lambda x: F.struct(
        x.asset.alias("asset"), (F.coalesce(F.try_element_at(weights, x.asset), F.lit(0.0)) * (1 + x.growth)).alias("pre"),
        x.target_weight.alias("want"), x.frozen.alias("frozen")))
    return _let(grown, lambda g: _let(_sum(g, lambda x: x.pre), lambda total: F.transform(g, lambda x: F.struct(
        x.asset.alias("asset"), F.when(total > 0, x.pre / total).otherwise(0.0).alias("pre"), x.want.alias("want"), x.frozen.alias("frozen")))))


def _totals(rows: Column) -> Column:
    part = lambda of: _sum(rows, of)
    valid = lambda x: x.want.isNotNull()
    return F.struct(
        part(lambda x: F.when(x.frozen, x.pre).otherwise(0.0)).alias("fixed"),
        part(lambda x: F.when(valid(x), x.pre).otherwise(0.0)).alias("kept"),
        part(lambda x: F.when(~valid(x) & ~x.frozen, x.pre).otherwise(0.0)).alias("left"),
        part(lambda x: F.coalesce(x.want, F.lit(0.0))).alias("want"),
        F.size(F.filter(rows, valid)).alias("n"))


def _blended(cap: Column, first: Column) -> Callable[[Column, Column], tuple[Column, Callable[[Column], Column]]]:
    """Blend from the carried weights toward the wanted ones within a turnover cap, as (blend, weight of a valid row)."""
    def rule(rows: Column, t: Column):
        room = 1 - t.fixed
        want = lambda x: F.try_divide(x.want, t.want) * room
        start = lambda x: F.try_divide(x.pre, t.kept) * room
        distance = _sum(rows, lambda x: F.coalesce(F.abs(want(x) - start(x)), F.lit(0.0)))
        free = first | (t.kept <= 0)
        blend = F.when(free, 1.0).otherwise(_let(distance, lambda d: F.when(d <= 1e-15, 1.0).otherwise(
            F.least(F.greatest((cap - 2 * t.left) / d, F.lit(0.0)), F.lit(1.0)))))
        return blend, lambda x, b: F.when(free, want(x)).otherwise(start(x) + b * (want(x) - start(x)))

    return rule


def _held(cap: Column, first: Column):
    """Keep drifted weights after an equal start; the weight of names that are gone is shared equally by the valid ones."""
    def rule(rows: Column, t: Column):
        room = 1 - t.fixed
        return F.lit(1.0), lambda x, b: F.when(first, F.try_divide(x.want, t.want) * room).otherwise(x.pre + t.left / t.n)

    return rule


def _fold(targets: DataFrame, cap: str, make_rule) -> DataFrame:
    kind = "array<struct<execution_session:bigint,asset:string,pre_weight:double,target_weight:double,turnover:double,blend:double,capped:boolean>>"
    start = F.struct(F.expr("CAST(map() AS map<string,double>)").alias("weights"), F.lit(True).alias("first"), F.expr(f"CAST(array() AS {kind})").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        def decided(rows: Column, t: Column) -> Column:
            blend, weight = make_rule(e.cap, acc.first)(rows, t)
            new = lambda b: F.transform(rows, lambda x: F.struct(
                x.asset.alias("asset"), x.pre.alias("pre"),
                F.when(x.frozen, x.pre).when(x.want.isNotNull(), weight(x, b)).otherwise(0.0).alias("new")))
            return _let(blend, lambda b: _let(new(b), lambda rows2: _let(_sum(rows2, lambda x: F.abs(x.new - x.pre)), lambda turnover: after(rows2, b, turnover))))

        def after(rows: Column, blend: Column, turnover: Column) -> Column:
            seen = F.filter(rows, lambda x: (x.new > 0) | (x.pre > 0))
            lines = F.transform(seen, lambda x: F.struct(
                e.execution_session.alias("execution_session"), x.asset.alias("asset"), x.pre.alias("pre_weight"), x.new.alias("target_weight"),
                turnover.alias("turnover"), blend.alias("blend"), (blend < 1).alias("capped")))
            held = F.filter(rows, lambda x: x.new > 0)
            weights = F.map_from_arrays(F.transform(held, lambda x: x.asset), F.transform(held, lambda x: x.new))
            return F.struct(weights.alias("weights"), (acc.first & (F.size(held) == 0)).alias("first"), F.concat(acc.out, lines).alias("out"))

        return _let(_before(acc.weights, e), lambda rows: _let(_totals(rows), lambda t: decided(rows, t)))

    names = F.sort_array(F.collect_list(F.struct(F.col("asset").cast("string").alias("asset"), "target_weight", "frozen", "growth")))
    each = targets.groupBy(*BOOK, "execution_session").agg(names.alias("names"), F.first(F.col(cap).cast("double")).alias("cap"))
    books = each.groupBy(*BOOK).agg(F.sort_array(F.collect_list(F.struct(F.col("execution_session").cast("bigint").alias("execution_session"), "names", "cap"))).alias("path"))
    folded = F.aggregate("path", start, step, lambda acc: acc.out)
    return books.select(*BOOK, F.inline(folded))


def rebalance(targets: DataFrame, cap: str = "turnover_cap") -> DataFrame:
    """Turnover-capped path. ``targets``: book keys, execution_session, asset, target_weight, frozen, growth, cap.

    ``growth`` is the asset's return since the previous execution.  The weight of a name
    that is gone is sold first and counts twice, as what replaces it is bought.
    """
    return _fold(targets, cap, _blended)


def buy_and_hold(targets: DataFrame, cap: str = "turnover_cap") -> DataFrame:
    """Targets once, then drift; the weight of names that leave is shared equally by the valid names."""
    return _fold(targets, cap, _held)
