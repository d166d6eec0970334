"""Positions and the buys of their trades in one pass."""

import datetime

from tapeloom.operators import ledger
from tapeloom.plans import catalogue
from tapeloom.sources import bridge

DAY = datetime.date(2020, 1, 2)


def test_buys_of_open_trades(spark):
    rows = [(1, 7, s, "A", 2.0, r, DAY, DAY, 1.0, 1.0) for s, r in (("O", "x"), ("F", "y"))] + [(2, 7, "F", "A", 2.0, "z", DAY, DAY, 1.0, 1.0), (3, 7, "O", "A", 2.0, None, DAY, DAY, 1.0, 1.0)]
    trades = spark.createDataFrame(rows, "trade_id long, book long, status string, ticker string, shares double, reason string, entry_date date, exit_date date, "
                                   "entry_price double, exit_price double")
    tx, positions = bridge.transactions(trades), bridge.positions(trades)
    joined = positions.join(tx.where("side = 'BUY'").selectExpr("trade_id AS position_id", "tx_id", "reason"), "position_id", "left").select("position_id", "tx_id", "reason")
    key = lambda r: (r[0], r[1], str(r[2]))
    got = sorted((tuple(r) for r in ledger.positions_with_buys(tx).collect()), key=key)
    assert got == sorted((tuple(r) for r in joined.collect()), key=key) == [(1, 2, "x"), (1, 2, "y"), (3, 6, None)]


def test_trades_are_worked_out_once(spark):
    plan = catalogue()["j12_positions_with_buys"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in line and "o_orderkey" in line for line in plan.splitlines()) == 1, plan
