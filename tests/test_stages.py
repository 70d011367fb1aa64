"""Queries read their large tables few times and move only rows that their result depends on."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import expr
from tessera.operators import ensemble, evaluate, forecast, universe
from tessera.plans import catalog, views
from tessera.plans.catalog import ensembles, forecasts, portfolios, risks, sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture
def reads(monkeypatch):
    """Names of the tables that plans read, in order."""
    seen, table = [], views.table
    monkeypatch.setattr(views, "table", lambda spark, sf, name: seen.append(name) or table(spark, sf, name))
    return seen


def test_calendar_moves_nations_not_assets(spark):
    plan = views.calendar(spark, SF, "sup")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert "hashpartitioning(s_nationkey" in plan and "hashpartitioning(asset" not in plan


@pytest.mark.parametrize("name", ["p13_missing_valuations", "p18_event_log", "p19_observed_cost_rerun", "p02_buy_and_hold"])
def test_ledger_reads_lines_for_panel_and_sizes_only(spark, reads, name):
    """Bars, two calendars of the panel's cash rate, and sizes."""
    catalog.QUERIES[name](spark, SF)
    assert reads.count("lineitem") == 4


def test_pool_holds_every_row_of_its_names(spark):
    b = portfolios.Books(spark, SF)
    names = {(r.country, r.asset) for r in b.pool.select("country", "asset").distinct().collect()}
    want = [r for r in b.panel.collect() if (r.country, r.asset) in names]
    key = lambda r: (r.country, r.asset, r.session_id)
    assert sorted(want, key=key) == sorted(b.members.collect(), key=key)
    alone, shared = risks.window_rows(spark, SF), risks.window_rows(spark, SF, b.members, b.pool)
    assert alone.count() == shared.count() and alone.drop("x").exceptAll(shared.drop("x")).isEmpty()


def test_largest_are_the_first_size_ranks(spark):
    rows = [("A", "m", i, s) for i, s in enumerate([5.0, None, 7.0, 5.0, 0.0, float("inf")])] + [("B", "m", 9, None)]
    u = spark.createDataFrame(rows, "country string, universe_month string, asset int, market_cap double")
    ranks = universe.size_rank(u).where("market_cap_rank <= 3").select("country", "asset", "market_cap_rank")
    assert sorted(ranks.collect()) == sorted(universe.largest(u, 3).select("country", "asset", "market_cap_rank").collect())


def test_metrics_without_order_rank_nothing(spark):
    rows = [("a", i % 3, i, float(i * 7 % 5), float(i * 3 % 11)) for i in range(40)]
    f = spark.createDataFrame(rows, "country string, date int, asset int, prediction double, target double")
    whole = evaluate.date_metrics(f, ["country", "date"])
    plain = evaluate.date_metrics(f, ["country", "date"], ())
    spread = evaluate.date_metrics(f, ["country", "date"], ("top_minus_bottom",))
    assert "Window" not in plain._jdf.queryExecution().toString() and "spearman_ic" not in plain.columns
    for part in (plain, spread):
        same = [F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in part.dtypes]
        assert sorted(part.select(*same).collect()) == sorted(whole.select(*part.columns).select(*same).collect())


def _columns_read(monkeypatch, spark, module, make):
    """Optimised plans of the stage tables that ``make`` writes, as text."""
    plans, write = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda d: plans.append(d._jdf.queryExecution().optimizedPlan().toString()) or write(d))
    make(spark, SF)
    return "".join(plans)


@pytest.mark.parametrize("module, make", [(forecast, forecasts.forecasts), (ensembles, ensembles.seed_scores), (sequences, sequences._rows)])
def test_stage_tables_hold_no_quotes(spark, monkeypatch, module, make):
    """The bars' quotes, volumes and extremes are not made for tables whose readers want returns only."""
    plan = _columns_read(monkeypatch, spark, module, make)
    aggregates = [line for line in plan.splitlines() if "max_by" in line]
    assert aggregates and not any("min_by" in line or "sum(" in line for line in aggregates)


def test_seed_scores_make_no_expanding_mean(spark, monkeypatch):
    assert _columns_read(monkeypatch, spark, forecast, ensembles.seed_scores) == ""


def test_candidates_of_any_number_of_seeds(spark):
    rows = [("a", 1, i, s, float((i * 7 + s * 5) % 11), i / 2, "v") for i in range(12) for s in range(1 + i % 5)]
    z = spark.createDataFrame(rows, "country string, date int, asset int, seed int, z double, target double, split string")
    w = spark.createDataFrame([(s, 0.1 * s, 0.2) for s in range(5)], "seed int, w_ic double, w_tb double")
    c = ensemble.candidates(z, w, ["target", "split"])
    want = z.groupBy("asset").agg(F.round(F.percentile("z", F.lit(0.5)), 12), F.max("target"), F.max("split"))
    assert sorted(c.select("asset", "median_rank", "target", "split").collect()) == sorted(want.collect())


def test_common_scores_are_the_common_universe(spark):
    want = ensemble.common_universe(ensembles._scores(spark, SF), len(ensembles.SEEDS))
    got = ensembles.common(spark, SF)
    assert got.count() == want.count() > 0 and got.exceptAll(want.select(*got.columns)).isEmpty()


@pytest.mark.parametrize("name", ["n05_seed_weights", "n06_candidate_choice", "n09_country_slope", "n10_pooled_slope"])
def test_validation_results_rank_validation_dates_only(spark, monkeypatch, name):
    """Ranks are of one date, so what is read of the validation dates needs no other."""
    seen, rank = set(), ensemble.rank_normal
    monkeypatch.setattr(ensemble, "rank_normal", lambda d, keys: seen.update(r.split for r in d.select("split").distinct().collect()) or rank(d, keys))
    catalog.QUERIES[name](spark, SF)
    assert seen == {"validation"}


def test_agreement_of_common_scores_ranks_each_seed_once(spark):
    rows = [("a", d, i, s, float((i * 7 + s * 5 + d * i) % 5)) for d in range(3) for i in range(2 + 9 * d) for s in (7, 19, 42)]
    s = spark.createDataFrame(rows, "country string, date int, asset int, seed int, score double")
    once, each = ensemble.seed_agreement(s, common=True), ensemble.seed_agreement(s)
    assert once._jdf.queryExecution().optimizedPlan().toString().count("Window [sum") < each._jdf.queryExecution().optimizedPlan().toString().count("Window [sum")
    same = lambda d: sorted(tuple(r) for r in d.withColumn("rank_corr", F.round("rank_corr", 9)).select(*each.columns).collect())
    assert same(once) == same(each)


def test_measures_make_no_label_dates(spark, monkeypatch):
    plan = _columns_read(monkeypatch, spark, forecast, lambda spark, sf: forecasts.metrics(spark, sf, ()))
    assert "lead(session_id" in plan and "lead(date" not in plan


@pytest.mark.parametrize("make", [lambda s: views.panel(s, SF, "sup"), lambda s: forecasts.base(s, SF, history=False)])
def test_asset_windows_sort_by_asset_first(spark, make):
    """Country is text that few values share out, so a sort that starts with it compares whole rows."""
    plan = make(spark)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "session_id" in line and "asset" in line]
    assert sorts and all("Sort [asset" in line for line in sorts)


@pytest.mark.parametrize("first, last", [(1, 5), (-2, 0), (0, 0), (-3, 1)])
def test_short_growth_folds_no_frame_and_equals_one(spark, monkeypatch, first, last):
    values = [0.5, -0.25, None, 0.1, 0.2, 0.3, -1.0, 0.7, 0.01, 0.02, 0.03, float("nan"), 0.4]
    rows = [(a, "c", i, x) for a in (1, 2) for i, x in enumerate(values[a - 1:])]
    d = spark.createDataFrame(rows, "asset int, country string, session_id int, x double")
    short = d.select("asset", "session_id", expr.growth("x", first, last, expr.by_asset()).alias("g"))
    monkeypatch.setattr(expr, "SHORT", 0)
    long = d.select("asset", "session_id", expr.growth("x", first, last, expr.by_asset()).alias("g"))
    assert "product" not in short._jdf.queryExecution().toString() and "product" in long._jdf.queryExecution().toString()
    assert sorted(map(str, short.collect())) == sorted(map(str, long.collect()))


def test_common_universe_counts_distinct_seeds(spark):
    rows = [("a", 1, 1, 7), ("a", 1, 1, 19), ("a", 1, 2, 7), ("a", 1, 2, 7), ("a", 2, 1, 19)]
    s = spark.createDataFrame(rows, "country string, date int, asset int, seed int")
    assert sorted(ensemble.common_universe(s, 2).collect()) == rows[:2]
