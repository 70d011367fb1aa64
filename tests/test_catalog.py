"""Registered queries against their SQL twins.

The default run takes a cross-section of every family at the smallest scale;
``TESSERA_FULL=1`` runs all of them, ``TESSERA_SF`` picks the data folder.
"""

import os

import pytest

from tests.compare import connect, diff, oracle_rows, spark_rows
from tessera.plans import catalog

SF = os.environ.get("TESSERA_SF", "/root/testdata/sf0.001")
SAMPLE = [
    "flagship_liquidity_momentum", "s02_filtered_scan", "s08_twin_ledger_sink", "s10_manifest_check", "c05_dedupe_keep_last",
    "c08_return_with_source", "c14_duplicate_keys", "k03_weekly_signal", "k05_densify_listed", "k06_fill_rate", "u03_size_rank",
    "u08_full_cross_section", "u13_universe_churn", "f02_compounded_return_gaps", "f13_market_stats", "f18_sequence_long",
    "f22_robust_fit", "l01_entry_exit_label", "l04_delayed_label", "l09_split_audit", "q06_price_jumps", "q09_nearest_event",
    "q18_run_reconciliation", "m02_expanding_mean", "m06_walk_forward_cutoffs", "e05_top_minus_bottom", "n03_common_universe",
    "r04_shrunk_covariance", "p05_risk_scaled_capped", "p13_daily_pnl", "a13_by_year", "i04_circular_block_interval",
    "n08_consensus_score", "r04_shrinkage_constants", "f21_flat_vectors", "p02_buy_and_hold", "p13_costed_pnl",
    "a04_reliability", "p15_turnover_capped_path", "a15_turnover_reduction", "i03_student_p_value", "i11_paired_ic_interval", "q20_fingerprint",
    "r04_shrinkage_grid", "r05_covariance_grid", "q13_coverage_grid",
]
NAMES = sorted(catalog.QUERIES) if os.environ.get("TESSERA_FULL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    return connect(SF)


def test_registry_is_consistent():
    assert set(SAMPLE) <= set(catalog.QUERIES)
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)
    assert len(catalog.QUERIES) - len(catalog.ORACLES) <= 12


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    got = spark_rows(catalog.QUERIES[name](spark, SF))
    if name in catalog.ORACLES:
        assert diff(got, oracle_rows(con, catalog.ORACLES[name])) is None
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["bucket", "n_dates", "n_rows", "mean_momentum", "mean_target_bps"] and df.count() == 2
    assert catalog.QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql()
