"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flagship_liquidity_momentum", "c05_dedupe_keep_last", "k05_densify_all", "f27_model_features", "f13_market_stats",
    "l04_delayed_label", "u07_available_top_n", "m10_hybrid_loss", "e08_forecast_summary", "n06_candidate_choice",
    "q09_nearest_event", "r04_shrunk_covariance", "p06_cost_rates", "p13_daily_pnl", "a06_geometric_return",
    "i07_paired_portfolio_bootstrap", "f18_sequence_long", "f23_robust_apply",
]


def main() -> None:
    from tessera.plans import catalog
    from tessera.session import drop_stages, local_session

    spark = local_session(CPUS, "bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        t = time.perf_counter()
        catalog.QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
        drop_stages(spark)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
