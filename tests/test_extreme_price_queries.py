"""Registered queries over fills whose walks take prices to 0, from 0 upwards, and beyond what a long holds."""

import os

import duckdb
import pytest

from tapeloom.plans import catalogue

STORED = "/root/testdata/sf0.001"
# Brands are put together into four: one falls to 0, one falls and rises again, one rises without end, one walks as stored.
LINES = """SELECT l.* REPLACE (CASE p_partkey % 4 WHEN 0 THEN 0.0 WHEN 1 THEN CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 0.0 ELSE 0.1 END
  WHEN 2 THEN 0.1 ELSE l_discount END AS l_discount) FROM lines l JOIN parts ON l_partkey = p_partkey"""
PARTS = "SELECT * REPLACE ('Brand#' || CAST(p_partkey % 4 + 1 AS VARCHAR) AS p_brand) FROM parts"


@pytest.fixture(scope="module")
def extreme(tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("extreme"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lines AS SELECT * FROM '{STORED}/lineitem.parquet'; CREATE VIEW parts AS SELECT * FROM '{STORED}/part.parquet'")
    for name, rows in {"lineitem": LINES, "part": PARTS}.items():
        con.execute(f"COPY ({rows}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for file in os.listdir(STORED):
        if not os.path.exists(f"{folder}/{file}"):
            os.symlink(f"{STORED}/{file}", f"{folder}/{file}")
    return folder


def test_prices_are_extreme(spark, extreme):
    closes = [r["close"] for r in catalogue()["m1_bars"].run(spark, extreme).collect()]
    assert min(closes) == 0.0 and max(closes) > 2.0**63 / 10000


NAMED = {
    "F2": "e1_forward_returns",
    "F3": "e2_open_to_close_returns",
    "F7": "q1_fold_returns",
    "F9, F10 (their panel)": "v19_panel_build",
    "F11": "v2_welch_t",
    "F12": "v5_newey_west",
    "F13": "w17_rolling_volatility",
    "F14": "w42_price_context",
    "F16": "a17_pooled_beat_rate",
    "F17": "a16_track_record",
    "F19": "a18_excess_slices",
    "F20": "a19_excess_scenarios",
    "F22": "a3_mark_to_market",
    "F23": "a7_monthly_grid",
}


@pytest.mark.parametrize("name", NAMED.values(), ids=NAMED.keys())
def test_named_query(spark, extreme, name):
    assert catalogue()[name].run(spark, extreme).collect()


@pytest.mark.parametrize("name", ["w21_momentum", "w24_mean_gap", "p10_board", "p13_universe_rs", "p21_universe_builder", "p42_breakout_variants"])
def test_query_with_the_same_divisors(spark, extreme, name):
    assert catalogue()[name].run(spark, extreme).collect() is not None
