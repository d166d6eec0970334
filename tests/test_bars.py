"""Daily bars from fills: the order of fills that agree in part, and what travels to order them."""

import datetime
import re

from tapeloom.sources import bridge

FILLS = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
         "l_returnflag string, l_linestatus string, l_shipdate timestamp")
DAY = datetime.datetime(1998, 1, 2)


def fills(spark, rows):
    part = spark.createDataFrame([(1, "A"), (2, "B")], "p_partkey long, p_brand string")
    return spark.createDataFrame(rows, FILLS), part


def test_fills_that_agree_are_ordered_by_discount(spark):
    tie = [(5, 1, 1, 1, 1.0, 1.0, d, tax, f, "O", DAY) for d, tax, f in ((0.10, 0.0, "A"), (0.0, 0.08, "R"), (0.10, 0.08, "R"), (0.0, 0.0, "A"))]
    later = [(bridge.BLOCK_ORDERS + 1, 1, 1, 1, 1.0, 1.0, 0.10, 0.0, "A", "O", DAY), (7, 2, 1, 1, 2.0, 1.0, 0.02, 0.0, "A", "O", DAY)]
    rows = {r["ticker"]: r for r in bridge.daily_bars(*fills(spark, tie + later)).collect()}
    price = lambda cum: spark.range(1).select(bridge.walk_price(bridge.F.lit(cum))).first()[0]
    a, b = rows["A"], rows["B"]
    # Steps -5 -5 +5 +5, then +5 in a later block.
    assert (a["open"], a["high"], a["low"], a["close"], a["volume"]) == (price(0), price(5), price(-10), price(5), 5.0)
    assert (b["open"], b["high"], b["low"], b["close"], b["volume"]) == (price(0), price(0), price(-3), price(-3), 2.0)


def test_fills_travel_without_columns_that_order_nothing(spark):
    plan = bridge.daily_bars(*fills(spark, []))._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search("l_tax|l_returnflag|l_linestatus", re.sub(r"(?m)^.*(LogicalRDD|LocalRelation|Relation ).*$", "", plan)), plan
