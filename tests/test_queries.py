"""Registered queries against their SQL twins, on the smallest scale."""

import pytest

import __spark_entry__ as driver
from check import compare, connect
from tapeloom.plans import catalogue

DIRECTORY = "/root/testdata/sf0.001"
SAMPLE = [
    "m1_bars", "m3_hourly_bars", "p41_volume_spike_scan", "w9_directional_system", "w38_reference_lines", "p10_board", "p22_weekly_universe", "p28_trade_levels",
    "p45_exit_rules", "p51_buy_selection", "j11_matching_intent", "e5_target_stop_grid", "e16_release_outcomes", "a15_outcome_summary", "p54_fundamentals_pick",
    "n4_digest_items", "p50_demand_composite", "s7_fetch_plan", "r4_inbox_collapse", "r12_release_bursts", "q7_ab_fold_comparison",
]


@pytest.fixture(scope="module")
def con():
    return connect(DIRECTORY)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_twin(spark, con, name):
    verdict = compare(spark, con, catalogue()[name], DIRECTORY)
    assert verdict.startswith("ok"), verdict


def test_contract():
    queries, twins = driver.queries(), driver.oracle_sql()
    assert set(twins) <= set(queries) and len(queries) > 300
    assert not any("OVER[" in sql for sql in twins.values())


def test_flagship(spark):
    assert driver.entry(spark).count() > 0
