"""Draws from block summaries against the same samples taken date by date."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import inference as inf


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(3)
    rows = []
    for key, n in (("one", 1), ("short", 3), ("even", 40), ("odd", 53), ("flat", 21)):
        for i in range(n):
            a, b = (0.01, 0.01) if key == "flat" else rng.normal(0.001, 0.05, 2).tolist()
            rows.append((key, i, n, a, None if key == "odd" and i == 30 else b, float(rng.uniform()), float(rng.uniform())))
    return spark.createDataFrame(rows, "k string, i bigint, n bigint, a double, b double, ta double, tb double")


def explicit(indices, series):
    """Values of every draw in order."""
    rows = inf.resample(indices, series, ["k"], ["a", "b"]).groupBy("k", "draw").agg(F.sort_array(F.collect_list(F.struct("j", "a", "b"))).alias("s")).collect()
    return {(r.k, r.draw): r.s for r in rows}


@pytest.mark.parametrize("block", [None, 1, 5, 7])
def test_draws(spark, series, block):
    draws = 25
    index = inf.circular_indices(series, ["k"], draws) if block is None else inf.iid_indices(series, ["k"], draws) if block == 1 else inf.fixed_block_indices(series, ["k"], block, draws)
    want = explicit(index, series)
    got = {(r.k, r.draw): r for r in inf.block_draws(series, ["k"], ["a", "b"], ["a"], block, draws).collect()}
    assert got.keys() == want.keys() and len(got) == 5 * draws
    for at, sample in want.items():
        a, b = np.array([x.a for x in sample]), np.array([x.b for x in sample if x.b is not None])
        wealth = np.cumprod(1 + a)
        r = got[at]
        assert (r.m, r.c_a, r.c_b) == (len(sample), len(a), len(b))
        np.testing.assert_allclose(
            [r.s_a, r.q_a, r.s_b, r.g_a, r.w_a], [a.sum(), (a * a).sum(), b.sum(), wealth[-1], (wealth / np.maximum.accumulate(wealth)).min()], rtol=1e-10, atol=1e-14)


def test_intervals(spark, series):
    got = {r.k: r for r in inf.block_sharpe_difference(series, ["k"], 252, block=5).collect()}
    want = {r.k: r for r in inf.sharpe_difference(inf.fixed_block_indices(series.where("k <> 'flat'"), ["k"], 5), series, ["k"], 252).collect()}
    assert got.keys() == want.keys() and "flat" not in got
    for k in want:
        np.testing.assert_allclose(list(got[k][1:]), list(want[k][1:]), rtol=1e-7)
    assert inf.portfolio_bootstrap(series.limit(0), ["k"], 252).count() == 0
