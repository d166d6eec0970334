"""Rules of single queries at prices of 0 and at prices beyond what a long holds."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from bar_frames import bar_frame
from check import compare, connect
from tapeloom.operators import curves, ledger, screener
from tapeloom.plans import catalogue
from tapeloom.sources import bridge
from test_extreme_price_queries import extreme  # noqa: F401

DAY = datetime.date(2020, 1, 2)


def test_intents_at_prices_beyond_a_long(spark):
    prices = [(1, "A", 1e15), (2, "A", 1e15), (3, "A", 1e140), (4, "A", 0.0), (5, "A", 2.0), (6, "B", 1e15), (7, "A", math.inf)]
    trades = spark.createDataFrame(prices, "trade_id long, ticker string, entry_price double")
    intents = spark.createDataFrame([(10 * i, t, "EXECUTED", p, DAY, 1.0) for i, t, p in prices if i not in (2, 6)] + [(99, "A", "EXECUTED", 2.0 + 5e-7, DAY, 1.0)],
                                    "intent_id long, ticker string, intent_status string, executed_price double, processed_at date, stop_price double")
    got = {r["trade_id"]: r["intent_id"] for r in ledger.latest_intent_within(trades, intents).collect()}
    assert got == {1: 10, 2: 10, 3: 30, 4: 40, 5: 99, 6: None, 7: None}


def test_walk_price_is_rounded_from_the_nearest_double(spark):
    walks = [3792, 3930, 5898, 6313, 9780, 47160]  # the JVM's exp is beside the nearest double for these
    got = [r[0] for r in spark.createDataFrame([(w,) for w in walks], "w long").select(bridge.walk_price(F.col("w"))).collect()]
    assert got == [8574195492.0519, 17094506737.5665, 320859036964754.44, 2555496706706949.5, 8.629192739781003e22, 1.2752896560794273e104]


def test_twin_of_amounts_at_extreme_prices(spark, extreme):  # noqa: F811
    verdict = compare(spark, connect(extreme), catalogue()["a26_cash_reconciliation"], extreme)
    assert verdict.startswith("ok"), verdict


def test_score_of_a_ticker_without_a_price(spark):
    got = screener.breakout_score(bar_frame(spark, [0.0] * 260, spread=0.0)).first()
    assert got["breakout_score"] == 100.0


@pytest.mark.parametrize("name", ["j18_candidate_rows", "j18_candidate_table", "j29_highlight_rows"])
def test_twin_of_notes_before_a_price_of_zero(spark, extreme, name):  # noqa: F811
    verdict = compare(spark, connect(extreme), catalogue()[name], extreme)
    assert verdict.startswith("ok"), verdict


def test_winner_of_equal_folds(spark):
    day = lambda d: datetime.date(2020, 1, d)
    flat = [(s, 2020, day(d), 0.0) for s in ("C", "A", "B") for d in (1, 2, 3)]
    rising = [("D", 2020, day(d), r) for d, r in ((1, 0.1), (2, 0.2), (3, 0.1))]
    got = curves.winner_votes(spark.createDataFrame(flat + rising, "strategy string, fold int, date date, r double")).collect()
    assert [(r["strategy"], r["votes"]) for r in got] == [("A", 1)]


@pytest.mark.parametrize("name", ["m1_bars", "a3_mark_to_market"])
def test_output_is_rounded_as_in_its_twin(spark, extreme, name):  # noqa: F811
    verdict = compare(spark, connect(extreme), catalogue()[name], extreme)
    assert verdict.startswith("ok"), verdict
