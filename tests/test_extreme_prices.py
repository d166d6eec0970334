"""Prices that fell to 0 or rose beyond what a long holds, as long price walks reach them."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from bar_frames import bar_frame
from tapeloom.functions import indicators as ind
from tapeloom.operators import curves, ledger, patterns, scans, studies
from tapeloom.sources import bridge

DAY = datetime.date(2020, 1, 2)
BARS = "ticker string, date date, open double, high double, low double, close double, volume double"


def test_ratio_over_zero(spark):
    rows = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (1.0, None)], "a double, b double").select(ind.ratio("a", "b")).collect()
    assert rows[0][0] == math.inf and rows[1][0] == -math.inf and math.isnan(rows[2][0]) and rows[3][0] == 0.25 and rows[4][0] is None


def test_returns_from_a_price_of_zero(spark):
    bars = bar_frame(spark, [0.0, 2.0, 1.0], spread=0.0)
    first = studies.close_returns(bars, [1], 0.0).orderBy("date").first()
    assert first["fwd_1"] == math.inf
    assert studies.open_returns(bars, [1], 0.0).count() == 3
    assert scans.price_context(bars, need=1).collect()


def test_trade_of_a_free_share(spark):
    t = spark.createDataFrame([(0.0, 2.0, 3.0, DAY, DAY)], "entry_price double, exit_price double, shares double, entry_date date, exit_date date")
    got = ledger.trade_stats(t, []).first()
    assert got["avg_win_pct"] == math.inf and got["total_pnl"] == 6.0


@pytest.mark.parametrize("high", [3.0, 5e14, 1e60])
def test_benchmark_of_any_height(spark, high):
    rows = [(t, DAY, p, p, p, p, 1.0) for t, p in (("A", 1.0), ("B", high))]
    got = bridge.benchmark_bars(spark.createDataFrame(rows, BARS)).first()
    assert got["close"] == pytest.approx((1.0 + high) / 2, rel=1e-15)


def test_floor_beyond_a_long(spark):
    got = spark.createDataFrame([(1e30,), (2.005,)], "x double").select(patterns.cents(F.col("x"))).collect()
    assert got[0][0] == pytest.approx(1e30, rel=1e-15) and got[1][0] == 2.01
    t = spark.createDataFrame([(1, 1, "F", "A", 2.0, "x", DAY, DAY, 1e30, 1.0)], "trade_id long, book long, status string, ticker string, shares double, "
                              "reason string, entry_date date, exit_date date, entry_price double, exit_price double")
    assert [r["amount"] for r in bridge.transactions(t).orderBy("tx_id").collect()] == [pytest.approx(2e30, rel=1e-15), 2.0]


def test_dividends_beside_very_high_ones(spark):
    days = [datetime.date(2020, 1, d) for d in (1, 5, 9)]
    opens = [1e40, 1.5, 1e20]
    paid = bridge.dividends(spark.createDataFrame([("A", datetime.date(2020, 3 * k + 1, 1), o, o, o, o, 1.0) for k, o in enumerate(opens)], BARS))
    trades = spark.createDataFrame([(1, "A", datetime.date(2020, 2, 1), datetime.date(2020, 5, 1), 100.0)], "trade_id long, ticker string, entry_date date, exit_date date, shares double")
    assert ledger.dividends_in_hold(trades, paid).first()["dividends"] == 1.5


def test_swing_high_just_beyond_two_risks(spark):
    bars = bar_frame(spark, [0.3, 0.3, 0.4902, 0.3, 0.3, 0.3, 0.3], spread=0.0)
    signals = spark.createDataFrame([("A", datetime.date(2020, 1, 7), "BASE", "AT_PIVOT", 0.4279)], "ticker string, date date, pattern string, state string, pivot double")
    got = patterns.with_levels(signals, bars).first()
    assert got["entry"] == 0.43 and got["stop"] == 0.43 * 0.93
    assert got["resistance_based"] and got["target_2r"] == 0.4902


def test_total_loss_stays_in_the_curve(spark):
    rows = [("A", 2020, datetime.date(2020, 1, d), r) for d, r in ((1, 0.5), (2, -1.0), (3, 0.1))]
    got = curves.metrics(spark.createDataFrame(rows, "strategy string, fold int, date date, r double"), ["strategy"]).first()
    assert got["total"] == -100.0 and got["max_dd"] == -100.0
