"""Covariances from the store of pair moments against numpy, and a hand-sized grid of variants."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import moments, risk, robustness

WINDOWS, HALF_LIFE = [3, 7, 20], 6.0
DAY = dt.date(2020, 1, 1)


def _date(s):
    return DAY + dt.timedelta(days=s)


@pytest.fixture(scope="module")
def returns():
    """40 sessions of 9 names: gaps, a late name, one that leaves, one constant; and a market of one name."""
    rng = np.random.default_rng(5)
    x = {f"n{i}": rng.normal(0.01, 0.1 * (i + 1), 40) for i in range(9)}
    x["n1"][[4, 17]] = np.nan
    x["n2"][:11] = np.nan
    x["n3"][25:] = np.nan
    x["n4"][:] = 0.5
    return {"A": x, "B": {"only": rng.normal(0, 1, 40)}}


@pytest.fixture(scope="module")
def store(spark, returns):
    rows = [(c, a, s, _date(s), None if np.isnan(v) else float(v)) for c, names in returns.items()
            for a, x in names.items() for s, v in enumerate(x) if not (a == "n3" and s >= 25)]
    panel = spark.createDataFrame(rows, "country string, asset string, session_id bigint, date date, ret double")
    signals = spark.createDataFrame([(c, _date(s), s) for c in "AB" for s in (2, 9, 21, 22, 39)], "country string, date date, session_id bigint")
    assets = moments.asset_windows(panel, signals, WINDOWS, HALF_LIFE).cache()
    sums = {size: moments.pair_sums(panel, signals, WINDOWS, HALF_LIFE, size) for size in (2, 256)}
    pairs = {size: moments.pair_windows(s, assets, signals, WINDOWS, HALF_LIFE) for size, s in sums.items()}
    return panel, signals, assets, pairs


def _expected(returns):
    for c, names in returns.items():
        for s in (2, 9, 21, 22, 39):
            for n in WINDOWS:
                block = {a: x[s - n + 1:s + 1] for a, x in names.items() if s - n + 1 >= 0}
                yield c, _date(s), n, {a: b for a, b in block.items() if not np.isnan(b).any()}


@pytest.mark.parametrize("size", [2, 256])
def test_pairs_of_every_window(store, returns, size):
    got = {(r.country, r.date, r.window, r.asset_i, r.asset_j): r for r in store[3][size].collect()}
    seen = 0
    for c, d, n, block in _expected(returns):
        w = np.array(risk.ewma_weights(n, HALF_LIFE))
        for i in block:
            for j in block:
                if i <= j:
                    a, b = block[i] - block[i].mean(), block[j] - block[j].mean()
                    ewma = (w * (block[i] - w @ block[i]) * (block[j] - w @ block[j])).sum()
                    r = got[c, d, n, i, j]
                    np.testing.assert_allclose([r.m2, r.m4, r.ewma], [a @ b, (a * a) @ (b * b), ewma], rtol=1e-8, atol=1e-12)
                    seen += 1
    assert seen == len(got) and seen > 100


def test_matrices_and_fallback(spark, store, returns):
    _, _, assets, pairs = store
    constants = moments.constants(pairs[256])
    rows = moments.matrices(pairs[256], constants, assets, 5).collect()
    got = {(r.country, r.date, r.window, r.kind, r.asset_i, r.asset_j): r.value for r in rows}
    assert len(got) == len(rows)
    present = {(r.country, r.date, r.window, r.asset) for r in assets.collect()}
    rho = {(r.country, r.date, r.window): r for r in constants.collect()}
    for c, d, n, block in _expected(returns):
        names = sorted(a for x, y, z, a in present if (x, y, z) == (c, d, n))
        valid = sorted(block)
        if len(valid) < 5:
            want = {(a, a): risk.FALLBACK_VARIANCE for a in names}
            shrunk = sample = want
        else:
            x = np.array([block[a] for a in valid])
            s = np.cov(x, bias=True)
            k = rho[c, d, n]
            z = x - x.mean(1, keepdims=True)
            p, mu = len(valid), np.trace(s) / len(valid)
            delta = ((s ** 2).sum() - p * mu * mu) / p
            beta = min((((z ** 2) @ (z ** 2).T).sum() / n - (s ** 2).sum()) / (p * n), delta)
            np.testing.assert_allclose([k.mu, k.delta, k.rho], [mu, delta, beta / delta], rtol=1e-7)
            flat = {(a, a): risk.FALLBACK_VARIANCE for a in names if a not in block}
            tri = lambda m: {(valid[i], valid[j]): m[i, j] for i in range(p) for j in range(i, p)} | flat
            shrunk, sample = tri((1 - k.rho) * s + k.rho * k.mu * np.eye(p)), tri(s * n / (n - 1))
        for kind, want in (("shrunk", shrunk), ("sample", sample)):
            have = {(i, j): v for (x, y, z, q, i, j), v in got.items() if (x, y, z, q) == (c, d, n, kind)}
            assert have.keys() == want.keys()
            np.testing.assert_allclose([have[q] for q in want], list(want.values()), rtol=1e-7, atol=1e-12)


def test_empty_panel(spark, store):
    panel, signals, _, _ = store
    none = panel.where("ret > 1e9")
    assets = moments.asset_windows(none, signals, WINDOWS, HALF_LIFE)
    pairs = moments.pair_windows(moments.pair_sums(none, signals, WINDOWS, HALF_LIFE), assets, signals, WINDOWS, HALF_LIFE)
    assert moments.matrices(pairs, moments.constants(pairs), assets, 5).count() == 0


def test_variants_differ_where_they_should(spark):
    """Two names, two executions: the cap binds the second trade of one variant only, cost is rate times turnover."""
    one = dict(k=1, kind="sample", window=3, max_weight=1.0)
    grid = robustness.table(spark, [dict(one, variant="free", cost_bps=0, turnover_cap=2.0), dict(one, variant="capped", cost_bps=100, turnover_cap=0.5)])
    signals = spark.createDataFrame([("A", _date(1), a, 2, s) for a, s in (("x", 2.0), ("y", 1.0))] + [("A", _date(4), a, 5, s) for a, s in (("x", 1.0), ("y", 2.0))],
                                    "country string, date date, asset string, execution_session bigint, score double")
    assets = signals.select("country", "date", F.lit(3).alias("window"), "asset", F.lit(True).alias("valid"))
    variances = assets.select("country", "date", "window", F.lit("sample").alias("kind"), "asset", F.lit(1.0).alias("variance"))
    returns = spark.createDataFrame([("A", a, s, 0.0) for a in "xy" for s in range(9)], "country string, asset string, session_id bigint, ret double")
    calendar = spark.createDataFrame([("A", s, _date(s)) for s in range(9)], "country string, session_id bigint, date date")
    names = robustness.targets(signals, assets, variances, grid, "score")
    weights = robustness.path(names, returns)
    held = {(r.strategy, r.execution_session, r.asset): r.target_weight for r in weights.collect()}
    assert held["free", 2, "x"] == 1 and held["free", 5, "y"] == 1 and ("free", 5, "x") not in held
    assert held["capped", 2, "x"] == 1
    out = {r.variant: r for r in robustness.summary(*robustness.run(weights, returns, calendar)).collect()}
    assert out["free"].total_cost == 0 and out["free"].executions == 2 and out["free"].mean_turnover == pytest.approx(1.5)
    assert out["capped"].total_cost == pytest.approx(0.01 * out["capped"].mean_turnover * out["capped"].executions)
    assert out["capped"].sessions == out["free"].sessions == 7
