"""Market tables derived from the stored star schema.

Prices come from an integer random walk driven by the trades of each ticker, so
the same rule gives bit-equal prices in any engine.  The walk is a prefix sum,
computed in three levels (order-key block, day, ticker).  The only window that
sees raw trades is the block window, so a ticker that owns a large share of all
trades is spread over its days and blocks; the upper levels see one row per
block and one row per session.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from tapeloom.functions.indicators import whole
from tapeloom.operators.asof import asof_join

# Trades of one order-key block of a day are summed together; blocks are then chained.
BLOCK_ORDERS = 1 << 20
# Whole units of a price that still fit a long.
WHOLE_UNITS = 9e18


def _exp(c: Column) -> Column:
    """The C library's ``exp``, nearly always the double next to the true value; the JVM's own may be the one beside it.

    High prices keep that difference, and a reconciliation of two amounts shows it as money.
    """

    def one(x: float) -> float:
        try:
            return math.exp(x)
        except OverflowError:
            return math.inf

    def run(xs: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in xs], dtype=float)

    return F.pandas_udf(run, DoubleType())(c)


def walk_price(cum: Column) -> Column:
    """Rounded to four places by a whole number of units, which is one rounding in binary whatever the height of the price."""
    return F.round(F.lit(50.0) * _exp(cum / F.lit(200.0)) * 10000) / 10000


def _chain(blocks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Offset every block's walk by the total of the earlier blocks of its key."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("base", F.coalesce(F.sum("step").over(w), F.lit(0)))


def daily_bars(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """bars(ticker, date, open, high, low, close, volume): one row per ticker and session.

    Fills that agree up to their discount take the same step, so nothing after it is carried to order them.  A hash of the window's keys leads
    the sort: as one number it settles most comparisons of rows of different windows, and the keys beside it keep windows apart.
    """
    fills = lineitem.join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("ticker"),
        F.to_date("l_shipdate").alias("date"),
        F.floor(F.col("l_orderkey") / BLOCK_ORDERS).alias("block"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    )
    fills = fills.withColumn("cell", F.xxhash64("date", "ticker", "block"))
    keys = ["cell", "date", "ticker", "block"]
    in_block = (
        Window.partitionBy(*keys)
        .orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    step = F.round(F.col("l_discount") * 100).cast("int") - 5
    blocks = (
        fills.select(*keys, "l_quantity", step.alias("step"), F.sum(step).over(in_block).alias("cum"))
        .groupBy(*keys)
        .agg(F.sum("step").alias("step"), F.max("cum").alias("top"), F.min("cum").alias("bottom"),
             F.sum("l_quantity").alias("volume"))
    )
    days = (
        _chain(blocks, ["ticker", "date"], "block")
        .groupBy("ticker", "date")
        .agg(F.sum("step").alias("step"), F.max(F.col("base") + F.col("top")).alias("top"),
             F.min(F.col("base") + F.col("bottom")).alias("bottom"), F.sum("volume").alias("volume"))
    )
    base = F.col("base")
    return _chain(days, ["ticker"], "date").select(
        "ticker",
        "date",
        walk_price(base).alias("open"),
        walk_price(base + F.greatest(F.lit(0), F.col("top"))).alias("high"),
        walk_price(base + F.least(F.lit(0), F.col("bottom"))).alias("low"),
        walk_price(base + F.col("step")).alias("close"),
        "volume",
    )


def benchmark_bars(bars: DataFrame) -> DataFrame:
    """bench(date, open, close): equal-weight mean of all tickers, exact in any summation order.

    Prices are added as whole numbers of their last decimal.  Decimals hold those under ``WHOLE_UNITS`` and their sum; a session with a higher
    price is added up in doubles, smallest first, which no order of the rows changes either: a session has one row per ticker.
    """

    def mean(c: str) -> Column:
        units = F.round(F.col(c) * 10000)
        small = F.sum(F.when(units < WHOLE_UNITS, units.cast("decimal(20,0)"))).cast("double")
        large = F.aggregate(F.array_sort(F.collect_list(units)), F.lit(0.0), lambda total, x: total + x)
        return F.when(F.max(units) < WHOLE_UNITS, small).otherwise(large) / (F.count("*") * 10000.0)

    return bars.groupBy("date").agg(mean("open").alias("open"), mean("close").alias("close"))


def hourly_bars(events: DataFrame) -> DataFrame:
    """hourly(ticker, day, hour, open, high, low, close, volume) from the event stream.

    Same walk as the daily bars, with a minute as the block.
    """
    ticks = events.select(
        F.col("event_type").alias("ticker"),
        F.date_trunc("minute", "ts").alias("minute"),
        "ts",
        "event_id",
        ((F.round(F.col("value") * 100).cast("long") % 11) - 5).alias("step"),
    )
    w = Window.partitionBy("ticker", "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    minutes = (
        ticks.withColumn("cum", F.sum("step").over(w))
        .groupBy("ticker", "minute")
        .agg(F.sum("step").alias("step"), F.max("cum").alias("top"), F.min("cum").alias("bottom"), F.count("*").alias("volume"))
        .withColumn("slot", F.date_trunc("hour", "minute"))
    )
    hours = (
        _chain(minutes, ["ticker", "slot"], "minute")
        .groupBy("ticker", "slot")
        .agg(F.sum("step").alias("step"), F.max(F.col("base") + F.col("top")).alias("top"),
             F.min(F.col("base") + F.col("bottom")).alias("bottom"), F.sum("volume").cast("double").alias("volume"))
    )
    base = F.col("base")
    return _chain(hours, ["ticker"], "slot").select(
        "ticker",
        F.to_date("slot").alias("day"),
        F.hour("slot").alias("hour"),
        walk_price(base).alias("open"),
        walk_price(base + F.greatest(F.lit(0), F.col("top"))).alias("high"),
        walk_price(base + F.least(F.lit(0), F.col("bottom"))).alias("low"),
        walk_price(base + F.col("step")).alias("close"),
        "volume",
    )


def session_bars(hourly: DataFrame) -> DataFrame:
    """Daily bars rolled up from hourly bars: (ticker, date, open, high, low, close, volume)."""
    return hourly.groupBy("ticker", F.col("day").alias("date")).agg(
        F.min_by("open", "hour").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "hour").alias("close"),
        F.sum("volume").alias("volume"),
    )


def trades(orders: DataFrame, lineitem: DataFrame, part: DataFrame, bars: DataFrame) -> DataFrame:
    """trades(trade_id, book, status, ticker, entry_date, exit_date, entry_price, exit_price, shares, reason).

    The ticker is the brand of the order's first line, the exit is its last
    shipment, and prices are the last close known on each date.
    """
    first_line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    legs = lineitem.groupBy("l_orderkey").agg(
        F.min(first_line)["l_partkey"].alias("l_partkey"),
        F.to_date(F.max("l_shipdate")).alias("exit_date"),
        F.sum("l_quantity").alias("shares"),
    )
    raw = (
        orders.join(legs, F.col("o_orderkey") == F.col("l_orderkey"))
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("o_orderkey").alias("trade_id"),
            F.col("o_custkey").alias("book"),
            F.col("o_orderstatus").alias("status"),
            F.col("p_brand").alias("ticker"),
            F.to_date("o_orderdate").alias("d0"),
            F.col("exit_date").alias("d1"),
            "shares",
            F.substring("o_orderpriority", 3, 20).alias("reason"),
        )
        .select("*", F.least("d0", "d1").alias("entry_date"), F.greatest("d0", "d1").alias("exit_date"))
        .drop("d0", "d1")
    )
    px = bars.select("ticker", F.col("date").alias("px_date"), "close")
    # Prices are looked up for every ticker on every day of an order or shipment, a table as small as the bars, so the orders are joined once.
    days = orders.select(F.to_date("o_orderdate").alias("day")).unionByName(lineitem.select(F.to_date("l_shipdate").alias("day"))).distinct()
    points = part.select(F.col("p_brand").alias("ticker")).distinct().crossJoin(days)
    entered = asof_join(raw, px, "ticker", "entry_date", "px_date", {"close": "entry_price"}, points=points.withColumnRenamed("day", "entry_date"))
    return asof_join(entered, px, "ticker", "exit_date", "px_date", {"close": "exit_price"}, points=points.withColumnRenamed("day", "exit_date")).where(
        "entry_price is not null"
    )


def releases(events: DataFrame) -> DataFrame:
    """releases(guid, ts, ticker, user_id, category, materiality, feed) from events."""
    v = F.col("value")
    return events.select(
        F.col("event_id").alias("guid"),
        "ts",
        F.col("event_type").alias("ticker"),
        "user_id",
        F.when(v < 5, "financing").when(v < 15, "drilling").when(v < 40, "earnings").otherwise("corporate").alias("category"),
        F.when(v >= 40, "high").when(v >= 10, "medium").otherwise("low").alias("materiality"),
        F.concat(F.lit("feed"), (F.col("user_id") % 4).cast("string")).alias("feed"),
        "value",
        "props",
    )


def sectors(part: DataFrame) -> DataFrame:
    """sectors(ticker, sector): the part type a brand sells most, ties by name."""
    n = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("p_brand").alias("ticker")).agg(
        F.min_by("p_type", F.struct(-F.col("n"), F.col("p_type"))).alias("sector")
    )


def reports(documents: DataFrame) -> DataFrame:
    """reports(report_id, hour, published, theme, lang, n_chars, tickers): documents as broker notes.

    Each note names one to three brands in order; the first is its subject.
    """
    i = F.col("doc_id")
    brand = lambda n: F.concat(F.lit("Brand#"), (n % 25 + 1).cast("string"))
    listed = F.array(brand(i * 7), brand(i * 11 + 3), brand(i * 13 + 5))
    return documents.select(
        i.alias("report_id"),
        (i % 24).cast("int").alias("hour"),
        F.date_add(F.lit("1998-01-01").cast("date"), (i % 700).cast("int")).alias("published"),
        F.col("source").alias("theme"),
        "lang",
        "n_chars",
        F.array_distinct(F.slice(listed, 1, (i % 3 + 1).cast("int"))).alias("tickers"),
    )


def report_tags(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """tags(report_id, tone, action): labels as classifier output, one row per labelled note."""
    q, t = F.col("quality"), F.col("toxic")
    return documents.select("doc_id").join(labels, "doc_id").select(
        F.col("doc_id").alias("report_id"),
        F.when((q == 1) & (t == 0), "bullish").when(t == 1, "bearish").otherwise("neutral").alias("tone"),
        F.when(F.col("doc_id") % 5 == 0, "upgrade").when(F.col("doc_id") % 5 == 1, "downgrade")
        .when(F.col("doc_id") % 5 == 2, "initiate").otherwise("reiterate").alias("action"),
    )


def positions(trades_: DataFrame) -> DataFrame:
    """positions(position_id, ticker, entry_date, as_of, entry_price, shares, stop_price, target_price, planned_stop).

    Open orders as positions, looked at on their last day; two of three carry the stop planned with the buy.
    """
    i, p = F.col("trade_id"), F.col("entry_price")
    stop = p * (1 - (5 + i % 4) / 100)
    return trades_.where("status = 'O'").select(
        i.alias("position_id"), "book", "ticker", "entry_date", F.col("exit_date").alias("as_of"), "entry_price", "shares",
        stop.alias("stop_price"), (p * (1 + (8 + i % 5) / 100)).alias("target_price"), F.when(i % 3 != 0, stop).alias("planned_stop"))


def dividends(bars: DataFrame) -> DataFrame:
    """dividends(ticker, ex_date, units): one payment on the first session of each quarter, in whole 1/10000 of a dollar per share."""
    first = bars.groupBy("ticker", F.date_trunc("quarter", "date").alias("q")).agg(
        F.min("date").alias("ex_date"), F.min_by("open", "date").alias("open"))
    return first.select("ticker", "ex_date", F.round(F.col("open") * 100).alias("units"))


def transactions(trades_: DataFrame) -> DataFrame:
    """transactions(tx_id, trade_id, book, side, ticker, trade_date, price, shares, amount, reason): two rows per trade."""
    amount = lambda p: whole(F.col(p) * F.col("shares") * 100 + 0.5000001) / 100
    leg = lambda n, side, d, p: F.struct((F.col("trade_id") * 2 + n).alias("tx_id"), F.lit(side).alias("side"), F.col(d).alias("trade_date"),
                                         F.col(p).alias("price"), amount(p).alias("amount"))
    legs = F.array(leg(0, "BUY", "entry_date", "entry_price"), leg(1, "SELL", "exit_date", "exit_price"))
    return trades_.select("trade_id", "book", "status", "ticker", "shares", "reason", F.explode(legs).alias("l")).select(
        "trade_id", "book", "status", "ticker", "shares", "reason", "l.*")


def intents(trades_: DataFrame) -> DataFrame:
    """intents(intent_id, ticker, signal_date, status, planned, executed_price, stop_price, rr, priority, processed_at)."""
    i, p = F.col("trade_id"), F.col("entry_price")
    return trades_.select(
        i.alias("intent_id"), "ticker", F.col("entry_date").alias("signal_date"),
        F.when(F.col("status") == "F", "EXECUTED").when(F.col("status") == "O", "PENDING").otherwise("SKIPPED").alias("intent_status"),
        p.alias("planned"), F.when(F.col("status") == "F", p).alias("executed_price"), (p * (1 - (5 + i % 4) / 100)).alias("stop_price"),
        F.when(i % 7 != 0, (i % 5) / 2.0 + 1).alias("rr"), (i % 10).alias("priority"), F.col("exit_date").alias("processed_at"))


def earnings(bars: DataFrame) -> DataFrame:
    """earnings(ticker, report_date): the 25th day after each quarter's first session."""
    return dividends(bars).select("ticker", F.date_add("ex_date", 25).alias("report_date"))


def subjects(reports_: DataFrame) -> DataFrame:
    """subjects(report_id, symbol, exchange, company): the first ticker of each note."""
    return reports_.select("report_id", "published", "hour", F.col("tickers")[0].alias("symbol"), F.col("lang").alias("exchange"),
                           F.col("theme").alias("company"), F.size("tickers").alias("listed"))


def symbol_map(reports_: DataFrame) -> DataFrame:
    """symbol_map(symbol, exchange, company, market_symbol): the subjects resolved so far."""
    return subjects(reports_).where("report_id % 4 <> 3").select(
        "symbol", "exchange", "company", F.concat("symbol", F.lit(".TO")).alias("market_symbol")).distinct()
