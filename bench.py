"""Headline queries, timed over the whole tables. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "log_returns",
    "rolling_volatility",
    "moving_averages_ticks",
    "exponential_means",
    "feature_matrix",
    "training_set",
    "mean_and_covariance",
    "granger_tests",
    "lagged_correlation",
    "transfer_entropy",
    "macro_sector_effects",
    "bootstrap_effect",
    "subgroup_effects",
    "exact_quantiles_raw",
    "scenario_run",
    "immediate_actions",
    "portfolio_performance",
    "optimal_weights",
    "holdings_fold",
    "holdings_valuation",
    "current_regime",
    "regime_history",
    "arima_forecast",
    "garch_forecast",
    "stream_bars",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tidewise.plans.catalog import load
    from tidewise.session import local_session

    registry = load()
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before the clock runs
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
