"""Hand-computed fixtures and properties of the operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera import schema
from tessera.functions import expr
from tessera.functions.expanding import expanding_quantile
from tessera.operators import (
    analytics, calendar as cal, clean, ensemble, evaluate, features, fold, forecast, inference, labels, ledger, models, portfolio,
    quality, risk, universe,
)

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def panel(spark, rows):
    """rows: (asset, session, ret)"""
    pdf = pd.DataFrame([("X", a, day(s), s, r) for a, s, r in rows], columns=["country", "asset", "date", "session_id", "ret"])
    return spark.createDataFrame(pdf).withColumn("session_id", F.col("session_id").cast("bigint"))


def test_constant_forecast_has_no_rank_metrics(spark):
    pdf = pd.DataFrame({"country": "X", "date": D0, "asset": range(4), "prediction": 1.0, "target": [1.0, 2, 3, 4]})
    m = evaluate.date_metrics(spark.createDataFrame(pdf), ["country", "date"]).first()
    assert m.spearman_ic is None and m.top_minus_bottom is None and m.directional_accuracy is None
    assert not m.rank_defined and m.mae == pytest.approx(1.5) and m.n_assets == 4


def test_small_group_has_no_metrics(spark):
    pdf = pd.DataFrame({"country": "X", "date": D0, "asset": range(2), "prediction": [1.0, 2], "target": [1.0, 2]})
    m = evaluate.date_metrics(spark.createDataFrame(pdf), ["country", "date"]).first()
    assert m.n_assets == 2 and m.rmse is None and m.spearman_ic is None


def test_position_earns_only_after_execution(spark):
    """Closes 100, 120, 121: a position taken at the second close earns 1/120."""
    p = panel(spark, [("a", 0, None), ("a", 1, 0.2), ("a", 2, 121 / 120 - 1)])
    w = spark.createDataFrame([("s", "X", day(0), 1, "a", 1.0, 0.001)],
                              "strategy string, country string, signal_date date, execution_session bigint, asset string, target_weight double, rate double")
    c = p.select("country", "session_id", "date")
    held = ledger.positions(w, p, c)
    led = ledger.weight_ledger(w, ledger.drifted(held))
    rows = ledger.daily_pnl(held, ledger.turnover(led, w, 0.4), c).orderBy("session_id").collect()
    assert [r.session_id for r in rows] == [1, 2]
    assert rows[0].gross_return == 0 and rows[0].net_return == pytest.approx(-0.001)
    assert rows[1].gross_return == pytest.approx(1 / 120) and rows[1].net_return == pytest.approx(1 / 120)


def test_ledger_equals_step_loop(spark):
    rng = np.random.default_rng(5)
    names, n = list("abcd"), 12
    rets = {(a, s): (None if rng.random() < 0.15 else float(rng.normal(0, 0.05))) for a in names for s in range(n)}
    p = panel(spark, [(a, s, r) for (a, s), r in rets.items()])
    books = {2: {"a": 0.5, "b": 0.5}, 6: {"b": 0.2, "c": 0.8}, 9: {"a": 0.3, "d": 0.7}}
    rate = {2: 0.001, 6: 0.002, 9: 0.003}
    w = spark.createDataFrame([("s", "X", day(e - 1), e, a, x, rate[e]) for e, b in books.items() for a, x in b.items()],
                              "strategy string, country string, signal_date date, execution_session bigint, asset string, target_weight double, rate double")
    c = p.select("country", "session_id", "date").distinct()
    held = ledger.positions(w, p, c)
    led = ledger.weight_ledger(w, ledger.drifted(held))
    trades = ledger.turnover(led, w, 0.4)
    got = {r.session_id: r for r in ledger.daily_pnl(held, trades, c).collect()}
    hold, last = {}, {}
    for s in range(2, n):
        r = {a: rets[(a, s)] for a in hold}
        gross = sum(x * (r[a] or 0.0) for a, x in hold.items())
        missing = sum(v is None for v in r.values())
        grown = {a: x * (1 + (r[a] or 0.0)) for a, x in hold.items()}
        tot = sum(grown.values())
        hold = {a: x / tot for a, x in grown.items()} if hold else {}
        cost = turn = 0.0
        if s in books:
            new = books[s]
            for a in set(new) | set(hold):
                d = abs(new.get(a, 0) - hold.get(a, 0))
                turn += d
                cost += d * (rate[s] if a in new else last.get(a, 0.001))
            hold, last = dict(new), {a: rate[s] for a in new}
        g = got[s]
        assert g.gross_return == pytest.approx(gross, abs=1e-12) and g.cost == pytest.approx(cost, abs=1e-12)
        assert g.turnover == pytest.approx(turn, abs=1e-12) and g.missing_valuations == missing and g.positions == len(hold)
    for t in trades.collect():
        assert t.continuing_turnover + t.entry_turnover + t.exit_turnover == pytest.approx(t.turnover)
        assert (t.cap_utilization is None) == (t.rebalance_type == "initial_deployment")


def test_turnover_of_exit_counts_once(spark):
    """pre (.20, .30, .10) to (.25, .25, 0): turnover .20."""
    cols = "strategy string, country string, signal_date date, execution_session bigint, asset string, target_weight double, rate double"
    w = spark.createDataFrame([("s", "X", day(0), 1, a, x, 0.001) for a, x in (("a", 0.2), ("b", 0.3), ("c", 0.1))]
                              + [("s", "X", day(1), 2, a, x, 0.001) for a, x in (("a", 0.25), ("b", 0.25))], cols)
    t = {r.execution_session: r.l1_turnover for r in ledger.target_turnover(w).collect()}
    assert t[2] == pytest.approx(0.2)


def test_unchanged_weights_cost_nothing(spark):
    cols = "strategy string, country string, signal_date date, execution_session bigint, asset string, target_weight double, rate double"
    w = spark.createDataFrame([("s", "X", day(e), e, "a", 1.0, 0.001) for e in (1, 2)], cols)
    p = panel(spark, [("a", s, 0.01) for s in range(4)])
    c = p.select("country", "session_id", "date")
    t = ledger.turnover(ledger.weight_ledger(w, ledger.drifted(ledger.positions(w, p, c))), w, 0.4).where("execution_session = 2").first()
    assert t.cost == pytest.approx(0) and t.turnover == pytest.approx(0)


def test_gap_voids_only_gated_horizon(spark):
    rows = [("a", s, 0.01) for s in range(70) if s != 40]
    f = features.rolling_features(panel(spark, rows)).where("session_id = 69").first()
    assert f.return_5 == pytest.approx(1.01**5 - 1) and f.return_20 is not None
    assert f.return_60 is None and f.vol_60 is None and not f.continuous_60


def test_contiguity_needs_one_more_session(spark):
    p = panel(spark, [("a", s, 0.01) for s in range(6)])
    got = [r.ok for r in p.select("session_id", expr.contiguous_diffs(4, expr.by_asset()).alias("ok")).orderBy("session_id").collect()]
    assert got == [False] * 4 + [True, True]


def test_future_does_not_change_past_features(spark):
    rng = np.random.default_rng(2)
    rows = [("a", s, float(rng.normal(0, 0.02))) for s in range(90)]
    cut = features.rolling_features(panel(spark, rows[:80])).drop("date")
    whole = features.rolling_features(panel(spark, rows)).where("session_id < 80").drop("date")
    assert cut.exceptAll(whole).count() == 0 and whole.exceptAll(cut).count() == 0


def test_missing_session_voids_label(spark):
    p = panel(spark, [("a", s, 0.01) for s in range(12) if s != 7]).withColumn("rf_daily", F.lit(0.0))
    got = {r.session_id: r.target for r in labels.forward_excess(p).collect()}
    assert got[1] == pytest.approx((1.01**5 - 1) * 1e4) and got[2] is None and got[6] is None


def test_purge_at_boundary(spark):
    df = spark.createDataFrame([("train", dt.date(1998, 1, 2)), ("train", dt.date(1997, 12, 30)), ("train", None)],
                               "split string, label_end_date date")
    got = [(r.purged, r.model_eligible) for r in labels.purge(df, "1998-01-01", "train", ["train"]).collect()]
    assert got == [(True, False), (False, True), (False, True)]


def test_dedupe_prefers_known_size(spark):
    df = spark.createDataFrame([("X", dt.date(2024, 2, 1), "a", None, dt.date(2024, 1, 31)), ("X", dt.date(2024, 2, 1), "a", 5.0, dt.date(2024, 1, 15))],
                               "country string, universe_month date, asset string, market_cap double, snapshot_date date")
    assert universe.dedupe_snapshots(df, "largest").first().market_cap == 5.0
    assert universe.dedupe_snapshots(df, "latest").first().market_cap is None


def test_name_without_quote_pays_country_rate(spark):
    q = panel(spark, [("a", 0, 0.0), ("a", 1, 0.0), ("b", 1, 0.0)]).withColumn(
        "spread_bps", F.when(F.col("asset") == "a", 20.0 + 20 * F.col("session_id")))
    s = spark.createDataFrame([("X", 2, "a"), ("X", 2, "b"), ("X", 0, "a")], "country string, session_id bigint, asset string")
    got = {(r.asset, r.session_id): r for r in portfolio.cost_rates(s, q).collect()}
    assert got[("a", 2)].c1 == pytest.approx(30 / 20000) and got[("a", 2)].c2 == pytest.approx(40 / 20000)
    assert got[("b", 2)].c2 == pytest.approx(30 / 20000)
    assert got[("a", 0)].c1 == got[("a", 0)].c2 == 0.001


@pytest.mark.parametrize("width", [0.05, 10.0])
def test_expanding_quantile(spark, width):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 600), "t": rng.integers(0, 40, 600), "v": np.round(rng.gamma(2, 3, 600), 1)})
    o = pd.DataFrame([(g, t) for g in "ab" for t in (0, 3, 10, 39, 60)], columns=["g", "t"])
    got = expanding_quantile(spark.createDataFrame(pdf), spark.createDataFrame(o), "g", "t", "v", 0.5, width).collect()
    assert len(got) == 10
    for r in got:
        x = pdf[(pdf.g == r.g) & (pdf.t < r.t)].v
        assert (r.q is None) == x.empty and (x.empty or r.q == pytest.approx(x.median()))


@pytest.mark.parametrize("scores", [[3, 2, 1, 0, 0, -1], [0] * 6, [9] + [0] * 29, list(range(30)), [5.0] * 30])
def test_capped_weights(spark, scores):
    pdf = pd.DataFrame({"country": "X", "date": D0, "asset": range(len(scores)), "s": np.array(scores, float), "v": 1.0})
    got = portfolio.risk_scaled(spark.createDataFrame(pdf), "s", "v").toPandas()
    assert got.target_weight.sum() == pytest.approx(1) and (got.target_weight >= -1e-12).all()
    assert (got.target_weight <= got["cap"] + 1e-9).all()
    order = got.sort_values("s").target_weight.to_numpy()
    assert (np.diff(order) >= -1e-12).all()


def test_covariance_and_shrinkage(spark):
    rng = np.random.default_rng(8)
    n, p = 6, 5
    x = rng.normal(0, 0.02, (n, p))
    pn = panel(spark, [(f"a{i}", t, float(x[t, i])) for t in range(n) for i in range(p)])
    rows = risk.windows(pn, n).where(F.col("session_id") == n - 1)
    for size in (2, 256):
        got = risk.covariance(rows, size=size).toPandas()
        want = np.cov(x.T)
        assert len(got) == p * (p + 1) // 2
        for r in got.itertuples():
            assert r.value == pytest.approx(want[int(r.asset_i[1]), int(r.asset_j[1])])
        xc = x - x.mean(0)
        s = xc.T @ xc / n
        mu = np.trace(s) / p
        delta = ((s - mu * np.eye(p)) ** 2).sum() / p
        beta = min(sum(((np.outer(r, r) - s) ** 2).sum() for r in xc) / (p * n * n), delta)
        k = risk.shrinkage(rows, size=size)
        c = k.first()
        assert (c.mu, c.delta, c.rho) == pytest.approx((mu, delta, beta / delta))
        full = (1 - c.rho) * s + c.rho * mu * np.eye(p)
        w = np.arange(1, p + 1) / 15
        wd = spark.createDataFrame(pd.DataFrame({"country": "X", "date": day(n - 1), "asset": [f"a{i}" for i in range(p)], "weight": w}))
        assert risk.portfolio_variance(rows, wd, k).first().variance == pytest.approx(w @ full @ w)


def test_turnover_capped_path(spark):
    rng = np.random.default_rng(4)
    rows = []
    for e in (1, 2, 3):
        w = rng.random(6)
        rows += [("s", "X", "c", e, a, float(x), float(rng.normal(0, 0.02)), 0.3) for a, x in zip("abcdef", w / w.sum())]
    df = spark.createDataFrame([(*r, False) for r in rows], "strategy string, country string, scenario string, execution_session bigint, asset string, target_weight double, growth double, turnover_cap double, frozen boolean")
    got = fold.rebalance(df).toPandas()
    assert np.allclose(got.groupby("execution_session").target_weight.sum(), 1)
    later = got[got.execution_session > 1]
    assert (later.turnover <= 0.3 + 1e-9).all() and later.capped.any()
    bh = fold.buy_and_hold(df).toPandas()
    assert np.allclose(bh[bh.execution_session > 1].turnover, 0)


def test_leavers_are_shared_equally(spark):
    kind = "strategy string, country string, scenario string, execution_session bigint, asset string, target_weight double, growth double, turnover_cap double"
    rows = [("s", "X", "c", 1, a, w, 0.0, 1.0) for a, w in (("a", 0.5), ("b", 0.25), ("c", 0.25))]
    rows += [("s", "X", "c", 2, a, w, 0.0, 1.0) for a, w in (("a", 0.5), ("b", 0.5), ("c", None))]
    rows += [("s", "X", "c", 3, a, w, 0.0, 1.0) for a, w in (("a", None), ("b", 0.5), ("d", 0.5))]
    rows, kind = [(*r, False) for r in rows], kind + ", frozen boolean"
    got = {(r.execution_session, r.asset): r.target_weight for r in fold.buy_and_hold(spark.createDataFrame(rows, kind)).collect()}
    assert (got[2, "a"], got[2, "b"], got[2, "c"]) == pytest.approx((0.625, 0.375, 0))
    assert (got[3, "a"], got[3, "b"], got[3, "d"]) == pytest.approx((0, 0.375 + 0.3125, 0.3125))


def test_coverage_counts_sessions_before_nulls_become_zero(spark):
    """Two of four sessions after the deployment value no held name, so three of five had a return."""
    book = {"strategy": "s", "country": "X"}
    w = spark.createDataFrame([("s", "X", day(0), 1, "a", 1.0, 0.0)], "strategy string, country string, signal_date date, execution_session int, asset string, target_weight double, rate double")
    c = spark.createDataFrame([("X", k, day(k)) for k in range(6)], "country string, session_id int, date date")
    r = spark.createDataFrame([("X", "a", 2, 0.1), ("X", "a", 5, 0.1)], "country string, asset string, session_id int, ret double")
    held = ledger.positions(w, r, c)
    trades = ledger.turnover(ledger.weight_ledger(w, ledger.drifted(held)), w, 0.4)
    daily = ledger.daily_pnl(held, trades, c)
    risk_rows = spark.createDataFrame([("X", day(0), 0, True)], "country string, signal_date date, valid_assets int, fallback boolean")
    got = analytics.reliability(daily, trades, risk_rows, list(book)).first()
    assert (got.coverage, got.fallback_rate, got.missing_events, got.held_asset_days) == (pytest.approx(0.6), 1.0, 2, 5)


def test_gates_fail_on_low_coverage_and_on_fallback(spark):
    runs = [(2, c, 0.0, 0.9, 9.0) for c in "abc"] + [(5, c, 0.2, 1.0, 8.0) for c in "abc"] + [(10, c, 0.1, 0.95, 1.0) for c in "abc"] + [(20, c, None, None, 7.0) for c in "abc"]
    df = spark.createDataFrame(runs, "risk_aversion int, country string, fallback_rate double, coverage double, sharpe double")
    got = {r.risk_aversion: (r.eligible_countries, r.selected) for r in ensemble.gated_choice(df, "risk_aversion").collect()}
    assert got == {2: (0, False), 5: (0, False), 10: (3, True), 20: (0, False)}
    assert not any(r.selected for r in ensemble.gated_choice(df.where("country < 'c'"), "risk_aversion").collect())


def test_risk_status_falls_back_with_few_or_no_assets(spark):
    rows = spark.createDataFrame([("X", day(0), a, v) for a, v in (("a", True), ("b", True), ("c", False))], "country string, date date, asset string, valid boolean")
    dates = spark.createDataFrame([("X", day(0)), ("X", day(1))], "country string, date date")
    got = {r.date: (r.valid_assets, r.fallback) for r in risk.status(rows, dates, 2).collect()}
    assert got == {day(0): (2, False), day(1): (0, True)}


def test_frozen_names_keep_their_weight(spark):
    """Entry, exit and a frozen name by hand: valid names share what the frozen one leaves."""
    kind = "strategy string, country string, scenario string, execution_session bigint, asset string, target_weight double, growth double, turnover_cap double, frozen boolean"
    rows = [("s", "X", "c", 1, a, 1 / 3, 0.0, 9.0, False) for a in "abz"]
    rows += [("s", "X", "c", 2, "a", 0.5, 0.0, 9.0, False), ("s", "X", "c", 2, "b", None, 0.5, 9.0, True), ("s", "X", "c", 2, "z", None, 0.0, 9.0, False), ("s", "X", "c", 2, "d", 0.5, 0.0, 9.0, False)]
    rows += [("s", "X", "c", 3, "b", None, 0.0, 9.0, True), ("s", "X", "c", 3, "a", None, 0.0, 9.0, False), ("s", "X", "c", 3, "d", None, 0.0, 9.0, False)]
    df = spark.createDataFrame(rows, kind)
    out = {(r.execution_session, r.asset): r for r in fold.rebalance(df).collect()}
    b = 1.5 / 3.5
    assert out[2, "b"].pre_weight == out[2, "b"].target_weight == pytest.approx(b)
    assert out[2, "a"].target_weight == out[2, "d"].target_weight == pytest.approx((1 - b) / 2) and out[2, "z"].target_weight == 0
    assert out[2, "a"].turnover == pytest.approx(2 / 3.5)
    assert out[3, "b"].target_weight == pytest.approx(b) and out[3, "a"].target_weight == 0
    held = {(r.execution_session, r.asset): r.target_weight for r in fold.buy_and_hold(df).collect()}
    assert (held[2, "a"], held[2, "b"], held[2, "d"]) == pytest.approx((1.5 / 3.5, b, 0.5 / 3.5))


@pytest.mark.parametrize("size", [3, 256])
def test_hybrid_loss_matches_pairs(spark, size):
    rng = np.random.default_rng(6)
    pdf = pd.DataFrame({"model": "m", "country": "X", "date": np.repeat([day(0), day(1)], 10), "asset": list(range(10)) * 2,
                        "prediction": rng.normal(size=20), "target": np.round(rng.normal(size=20) * 100, -1)})
    got = forecast.hybrid_loss(spark.createDataFrame(pdf), ["model"], size=size).first()
    e = (pdf.prediction - pdf.target / 100).abs()
    huber = np.where(e <= 1, e * e / 2, e - 0.5).mean()
    ranks = []
    for _, g in pdf.groupby("date"):
        p, y = g.prediction.to_numpy(), g.target.to_numpy()
        ranks.append(np.mean([np.log1p(np.exp(-np.sign(y[i] - y[j]) * (p[i] - p[j]))) for i in range(10) for j in range(i) if y[i] != y[j]]))
    assert got.huber == pytest.approx(huber) and got.rank_loss == pytest.approx(np.mean(ranks))
    assert got.hybrid == pytest.approx(0.25 * huber + 0.75 * np.mean(ranks))


def test_student_p(spark):
    df = spark.createDataFrame([(2.228139, 10.0), (1.959964, 1e6), (0.0, 5.0), (-12.706205, 1.0), (0.5, 30.0)], "t double, df double")
    got = [r[0] for r in df.select(inference.student_p("t", "df")).collect()]
    assert got == pytest.approx([0.05, 0.05, 1.0, 0.05, 0.620730], abs=1e-5)


def test_normal_quantile(spark):
    df = spark.createDataFrame([(0.001,), (0.025,), (0.5,), (0.975,), (0.999,)], "p double")
    got = [r[0] for r in df.select(expr.normal_quantile("p")).collect()]
    assert got == pytest.approx([-3.090232306, -1.959963985, 0.0, 1.959963985, 3.090232306], abs=1e-7)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p_value double")
    got = {r.k: r.holm_p for r in inference.holm(df, ["k"], []).collect()}
    assert got["a"] == pytest.approx(0.03) and got["c"] == pytest.approx(0.06) and got["b"] == pytest.approx(0.06) and got["d"] is None


@pytest.mark.parametrize("n", [17, 20])
def test_fixed_blocks_fill_exactly(spark, n):
    s = inference.indexed(spark.range(n).withColumn("k", F.lit("k")), ["k"], "id")
    ix = inference.fixed_block_indices(s, ["k"], 5, draws=30).toPandas()
    for _, g in ix.groupby("draw"):
        g = g.sort_values("j")
        assert g.j.tolist() == list(range(n)) and g.i.between(0, n - 1).all()


def test_ridge_equals_closed_form(spark):
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(9)
    x = rng.normal(size=(80, 3))
    y = x @ [1.0, -2.0, 0.5] + 4 + rng.normal(size=80)
    pdf = pd.DataFrame(x, columns=["f0", "f1", "f2"]).assign(target=y, country="X", date=day(9), label_end_date=day(3))
    df = spark.createDataFrame(pdf).withColumn("features", array_to_vector(F.array("f0", "f1", "f2")))
    xc, yc = x - x.mean(0), y - y.mean()
    beta = np.linalg.solve(xc.T @ xc + 10 * np.eye(3), xc.T @ yc)
    want = (x - x.mean(0)) @ beta + y.mean()
    got = models.ridge(df, df).select("prediction", "target").toPandas().sort_values("target").prediction.to_numpy()
    assert np.allclose(got, want[np.argsort(y)], atol=1e-6)
    df = df.withColumn("features", F.array("f0", "f1", "f2"))
    fit = models.walk_forward(df, spark.createDataFrame([("X", day(3)), ("X", day(2))], "country string, date date"), 3)
    rows = fit.collect()
    assert len(rows) == 1 and rows[0].rows_used == 80 and np.allclose(rows[0].beta, beta)


def test_walk_forward_on_wide_sequences_equals_closed_form(spark, monkeypatch):
    """60 steps of 15 measures, two countries, an origin without new labels, parts of a few rows."""
    monkeypatch.setattr(models, "PARTIAL_ROWS", 40)
    rng, width = np.random.default_rng(3), 900
    rows = [("XY"[k % 2], day(1 + k % 3), day(1 + k % 3), float(rng.normal()), rng.normal(size=width).tolist()) for k in range(240)]
    df = spark.createDataFrame(rows, "country string, date date, label_end_date date, target double, features array<double>").repartition(5)
    o = spark.createDataFrame([(c, day(k)) for c in "XY" for k in (2, 3, 9)], "country string, date date")
    fits = {(r.country, r.origin): r for r in models.walk_forward(df, o, width).collect()}
    assert len(fits) == 6
    for (c, at), r in fits.items():
        mine = [x for x in rows if x[0] == c and x[2] <= at]
        x, y = np.array([m[4] for m in mine]), np.array([m[3] for m in mine])
        xc, yc = x - x.mean(0), y - y.mean()
        beta = np.linalg.solve(xc.T @ xc + 10 * np.eye(width), xc.T @ yc)
        assert r.rows_used == len(mine) and np.allclose(r.beta, beta) and r.intercept == pytest.approx(y.mean() - x.mean(0) @ beta)
    scored = models.predict_walk_forward(df, models.walk_forward(df, o, width)).where("date = '2024-01-04'").first()
    fit = fits[scored.country, day(3)]
    assert scored.training_cutoff == day(3) and scored.prediction == pytest.approx(fit.intercept + np.dot(fit.beta, scored.features))


def test_forward_fill_flags(spark):
    c = spark.createDataFrame([("X", day(k), k) for k in range(4)], "country string, date date, session_id bigint")
    r = spark.createDataFrame([("X", day(1), 0.5)], "country string, date date, rf_daily double")
    got = [(x.rf_daily, x.rf_known) for x in cal.fill_rate(c, r).orderBy("date").collect()]
    assert got == [(0.0, False), (0.5, True), (0.5, True), (0.5, True)]


def test_week_ending(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 5),), (dt.date(2024, 1, 6),)], "d date")
    assert [r[0] for r in df.select(cal.week_ending("d")).collect()] == [dt.date(2024, 1, 5), dt.date(2024, 1, 12)]


def test_contract_helpers(spark):
    df = spark.createDataFrame([("1", "x")], "asset string, close string")
    out = schema.enforce_schema(df, schema.struct("asset:string close:double volume:double"))
    assert out.first().close is None and out.columns == ["asset", "close", "volume"]
    with pytest.raises(ValueError):
        schema.require_columns(df, ["nope"])
    with pytest.raises(ValueError):
        schema.assert_unique(df.union(df), ["asset"])


def test_nearest_event_matches_brute_force(spark):
    rng = np.random.default_rng(12)
    m = pd.DataFrame({"country": "X", "asset": rng.integers(0, 4, 40), "date": [day(int(k)) for k in rng.integers(0, 60, 40)]}).drop_duplicates()
    e = pd.DataFrame({"asset": rng.integers(0, 4, 50), "event_id": [f"e{k:02d}" for k in range(50)], "date_kind": "ex",
                      "event_date": [day(int(k)) for k in rng.integers(0, 60, 50)]})
    got = {(r.asset, r.date): r for r in quality.nearest_event(spark.createDataFrame(m), spark.createDataFrame(e)).collect()}
    assert len(got) == len(m)
    for r in m.itertuples():
        c = sorted((abs((x.event_date - r.date).days), x.event_id) for x in e.itertuples() if x.asset == r.asset and abs((x.event_date - r.date).days) <= 3)
        g = got[(r.asset, r.date)]
        assert (g.event_id, g.n_events) == ((c[0][1], len(c)) if c else (None, 0))


def test_absent_seed_is_not_zero(spark):
    df = spark.createDataFrame([("X", D0, a, s, v) for a, s, v in (("a", 1, 1.0), ("b", 1, 2.0), ("c", 1, 3.0), ("a", 2, 5.0), ("c", 2, 9.0))],
                               "country string, date date, asset string, seed int, score double")
    got = {r.asset: r for r in ensemble.mean_available(df).collect()}
    assert got["b"].n_seeds == 1 and got["b"].ensemble == pytest.approx(0, abs=1e-9) and got["c"].ensemble > 0 > got["a"].ensemble


def test_keep_last_is_total(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0), ("a", 2, 7.0), ("b", 1, None)], "k string, t int, v double")
    got = {r.k: r.v for r in clean.keep_last(df, ["k"], ["t"]).collect()}
    assert got == {"a": 7.0, "b": None}


@pytest.mark.parametrize("per_batch", [3, 10_000])
def test_window_features_equal_the_assembled_sequences(spark, per_batch):
    """Gaps, nulls and assets that go on in the next batch; the same slots as ``assemble`` and the same numbers as ``summarise``."""
    from tessera.operators import sequence

    rng = np.random.default_rng(12)
    rows = [("XY"[a % 2], a, s, float(rng.normal()), None if rng.random() < 0.2 else float(rng.normal()), bool(rng.random() < 0.7))
            for a in range(9) for s in range(14) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "country string, asset bigint, session_id bigint, u double, v double, ok boolean").repartition(3)
    keys, names = ["country", "asset", "session_id"], ["u_scaled", "v_scaled"]
    stats = sequence.robust_fit(df, ["u", "v"])
    a = sequence.assemble(df.where("ok").select(*keys), sequence.robust_apply(df, stats, ["u", "v"]), names, 4)
    parts = ("last", "mean", "std", "min", "max")
    wide = sequence.summarise(a, names).select(*keys, F.array(*[f"{m}_{k}" for m in names for k in parts]).alias("features"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", per_batch)
    try:
        for want, summaries in ((a.select(*keys, sequence.flat_cells(names).alias("features")), False), (wide, True)):
            got = sequence.window_features(df, ["u", "v"], 4, "ok", keys, summaries, stats).collect()
            want = {tuple(r[:3]): r.features for r in want.collect()}
            assert len(got) == len(want) == sum(r[5] for r in rows)
            assert all(np.allclose(r.features, want[tuple(r[:3])], atol=1e-12) for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ridge_with_a_constant_measure_equals_closed_form(spark):
    """A constant column makes the cross products singular; the penalty does not."""
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=(60, 2)), np.zeros(60)])
    x = np.column_stack([x, x[:, 0] + 1e-3 * x[:, 1]])
    y = 300 * x[:, 0] - 200 * x[:, 1] + rng.normal(size=60) * 1000
    df = spark.createDataFrame([(float(b), a.tolist()) for a, b in zip(x, y)], "target double, features array<double>")
    xc = x - x.mean(0)
    want = xc @ np.linalg.solve(xc.T @ xc + 10 * np.eye(4), xc.T @ (y - y.mean())) + y.mean()
    got = {r.target: r.prediction for r in models.ridge(df, df).collect()}
    assert np.allclose([got[b] for b in y], want, rtol=1e-9)


def test_boosted_trees_learn_from_arrays_in_few_partitions(spark, monkeypatch):
    """The rows of a job lie in as many partitions as there are cores, or a multiple; each one costs every level of every tree."""
    held = []
    monkeypatch.setattr(models, "materialise", lambda df: held.append(df.cache()) or held[0])
    rows = [(float(10 * (k % 4 > 1)), [float(k % 4), float(k % 7)]) for k in range(400)]
    df = spark.createDataFrame(rows, "target double, features array<double>").repartition(40)
    out = models.boosted_trees(df, df, maxIter=3, stepSize=1.0, subsamplingRate=1.0, featureSubsetStrategy="all").collect()
    assert all(r.prediction == pytest.approx(r.target, abs=1e-6) for r in out) and len(out) == 400
    assert models._few(held[0], 400, 1000).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert models._few(held[0], 400, 20).rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def test_hybrid_loss_folds_only_pairs_that_decide(spark, monkeypatch):
    """Equal predictions and a pair that overflows need no fold; the rest equals every pair, ties and infinite predictions too."""
    folded = []
    whole = forecast._pair_losses
    monkeypatch.setattr(forecast, "_pair_losses", lambda rows, group, size: folded.append({r.model for r in rows.collect()}) or whole(rows, group, size))
    rng = np.random.default_rng(4)
    cases = {"even": np.full(24, 0.5), "plain": rng.normal(size=24) * 9, "far": rng.normal(size=24) * 900, "odd": rng.normal(size=24), "low": rng.normal(size=24)}
    cases["odd"][3], cases["low"][5] = np.nan, -np.inf
    target = np.round(rng.normal(size=24), 1) * 100
    target[:2] = 1000, -1000
    cases["far"][:2] = -900, 900
    pdf = pd.concat([pd.DataFrame({"model": m, "country": "X", "date": np.repeat([day(0), day(1)], 12), "asset": list(range(12)) * 2,
                                   "prediction": p, "target": target}) for m, p in cases.items()])
    df = spark.createDataFrame([tuple(r) for r in pdf.itertuples(index=False)], "model string, country string, date date, asset bigint, prediction double, target double")
    got = {r.model: r for r in forecast.hybrid_loss(df, ["model"], size=5).collect()}
    assert folded == [{"plain", "odd", "low"}]
    with np.errstate(over="ignore"):
        for m, p in cases.items():
            losses, pairs = [], 0
            for k in (slice(0, 12), slice(12, 24)):
                every = [np.log1p(np.exp(b - a)) for a, y in zip(p[k], target[k]) for b, z in zip(p[k], target[k]) if y > z]
                losses.append(np.mean(every))
                pairs += len(every)
            assert got[m].n_pairs == pairs and got[m].rank_loss == pytest.approx(np.mean(losses), nan_ok=True)


def test_manifest_streams_files_of_any_bytes(spark, tmp_path):
    """Line ends anywhere, a byte order mark, one line, odd names and packed files; parts of a few hundred bytes, each file also as one value."""
    import gzip
    import hashlib

    from tessera.sources import inventory

    rng = np.random.default_rng(8)
    noise = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    files = {"noise.bin": noise, "sub/ended.bin": noise[:50_000] + b"\n", "sub/lines.txt": b"\n" * 5_000, "mark [1] 50%.txt": b"\xef\xbb\xbf" + noise[:40_000],
             "mark ended.txt": b"\xef\xbb\xbfab\r\n" * 900, "one line.txt": b"x" * 30_000, "packed.gz": gzip.compress(noise), "small.txt": b"ab\n",
             "zeros": bytes(20_000) + b"\n\n", "two+marks.txt": b"\xef\xbb\xbf" * 2 + b"\n" * 300}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    want = {(name, len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items()}
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        assert {tuple(r) for r in inventory.file_manifest(spark, str(tmp_path), whole_bytes=100).collect()} == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert {tuple(r) for r in inventory.file_manifest(spark, f"file://{tmp_path}").collect()} == want
