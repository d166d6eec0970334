"""Headline timings: one JSON line with seconds per query at $BENCH_SF_DIR.

``bars_build`` is the walk from fills to daily bars without any cache; the other
queries start from the stored bar table, as the studies do.  Each figure is a
second, warm run of the whole query, planning included.
"""

from __future__ import annotations

import json
import os
import time

from tapeloom.plans import catalogue
from tapeloom.session import local_session
from tapeloom.sources import bridge
from tapeloom.sources.tables import Tables

HEADLINE = [
    "p41_volume_spike_scan", "w5_macd", "w9_directional_system", "w33_cross_sectional_rank", "t1_weekly_bars", "t2_calendar_alignment",
    "p10_board", "p19_composite_screen", "p21_universe_builder", "p27_best_pattern", "p35_tail_scan", "p45_exit_rules", "p51_buy_selection",
    "e4_trailing_exit", "e11_fold_summary", "e16_release_outcomes", "e18_trade_excess", "e19_momentum_rotation", "v3_bootstrap_interval",
    "v19_panel_build", "q3_performance_metrics", "p50_demand_composite", "n1_article_text", "n2_form4_transactions", "r2_two_lanes",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    t0 = time.perf_counter()
    run()
    return time.perf_counter() - t0


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    t = Tables(spark, directory)
    seconds: dict[str, float] = {}
    build = lambda: drain(bridge.daily_bars(t.lineitem, t.part))
    build()
    seconds["bars_build"] = round(min(timed(build), timed(build)), 3)
    drain(t.bars)
    queries = catalogue()
    for name in HEADLINE:
        run = lambda: drain(queries[name].run(spark, directory))
        run()
        seconds[name] = round(timed(run), 3)
    print(json.dumps({"metric": "headline_seconds_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(directory.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
