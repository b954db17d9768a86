"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The first entries build the stored domain tables (prices, news, factors, ...); later ones read what they need from
those, as an operator reads stored tables. Every result is computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

INPUTS = ["daily_prices", "flagged", "raw_news", "clean", "scores", "factors", "features", "predictions"]
HEADLINE = [
    "top_decile_momentum", "flag_suspicious_returns", "clean_news", "score_news_lexicon", "aggregate_news_raw",
    "universe_coverage", "panel_latest", "panel_point_in_time", "add_traditional_factors", "winsorized_zscore",
    "build_factor_table", "factor_correlation_pairs", "forward_labels", "prepare_features", "split_summary",
    "factor_ic_report", "evaluate", "oos_daily_returns", "build_signals", "equity_curve", "daily_positions",
    "candidate_sweep", "liquidity_report",
]


def main() -> None:
    from quantloom.session import build_session

    spark = build_session("bench", cpus=CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    from checks import catalog

    timings: dict[str, float] = {}

    def timed(name: str, work) -> None:
        started = time.perf_counter()
        work()
        timings[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)

    for name in INPUTS:
        source = getattr(catalog, name, None) or getattr(catalog.D, name)
        timed(f"input_{name}", lambda: source(spark, SF_DIR))
    for name in HEADLINE:
        query = catalog.ENTRIES[name].run
        timed(name, lambda: query(spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(timings.values()), 3)
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_wall_time", "value": total, "unit": "sec", "queries": timings, "sf": sf}))


if __name__ == "__main__":
    main()
