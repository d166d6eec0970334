"""Ledgers: positions, trades and transactions joined to prices, and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.recursive import averages, wilder
from tapeloom.operators import held
from tapeloom.operators.asof import asof_join
from tapeloom.sources.workspace import stored


def last_bars(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions that hold a bar, with the last one as ``z`` and the number of held bars ``tdays``; no row a day is read."""
    p = held.located(positions, held.numbered(bars))
    return p.withColumn("tdays", F.col("b") - F.col("a") + 1)


def positions_with_buys(transactions: DataFrame) -> DataFrame:
    """Every open position (status O) with each buy booked under its trade: position_id, tx_id, reason.

    A position is an open trade and its trade's buys are rows of the same table, so one pass puts them together; the trades are not
    worked out once for either side of a join.
    """
    buys = transactions.where("side = 'BUY'").select(F.col("trade_id").alias("position_id"), "status", "tx_id", "reason")
    booked = F.collect_list(F.struct("tx_id", "reason")).over(Window.partitionBy("position_id"))
    return buys.withColumn("_buys", booked).where("status = 'O'").select("position_id", F.explode("_buys").alias("x")).select("position_id", "x.*")


def since_entry(positions: DataFrame, bars: DataFrame, arm_pct: float = 8.0, trail_atr: float = 2.5) -> DataFrame:
    """Positions with their last bar ``z``, ``tdays``, the highest high ``hh`` and close ``peak`` since entry, and the ratcheting trail ``armed``.

    The trail is the best level reached on any bar since the highest close first gained ``arm_pct``, null before that.  Each position reads
    aligned blocks of bars, so the work does not grow with the holding time.
    """
    priced = averages(bars.withColumn("_tr", ind.true_range()), {"atr": (F.col("_tr"), wilder(14))}).drop("_tr")
    numbered = held.numbered(priced.select("ticker", "date", "high", "low", "close", "atr"))
    tree = stored(held.block_tree(numbered, trail_atr), "bar-blocks")
    gained = (ind.ratio("close", "entry_price") - 1) * 100 >= arm_pct
    p = stored(held.located(positions, numbered).withColumn("tdays", F.col("b") - F.col("a") + 1), "located")
    p = stored(held.extremes(p, tree, gained), "located")
    m = held.first_at(p, tree, gained)
    trail = held.best_trail(p.join(m, "position_id"), tree, trail_atr)
    return p.drop("hit").join(trail, "position_id", "left")


# Default exit settings.
EXITS = dict(stop_atr=2.0, trail_atr=2.5, arm_pct=8.0, giveback_from=6.0, giveback_allow=3.0, time_days=20, time_profit=0.0)


def exit_view(positions: DataFrame, bars: DataFrame, stop_atr: float, trail_atr: float, arm_pct: float, giveback_from: float,
              giveback_allow: float, time_days: int, time_profit: float) -> DataFrame:
    """Stop, give-back and time-stop state of every position on the day it is looked at.

    The initial stop is the one planned with the buy, where there is one, else a multiple of the ATR.  The trailing stop ratchets: it is the best level reached on any bar since the
    peak gain armed it.
    """
    g = since_entry(positions, bars, arm_pct, trail_atr)
    atr_stop = F.col("entry_price") - stop_atr * F.col("z.atr")
    g = g.select("*", F.col("z.close").alias("last_close"), F.col("z.low").alias("last_low"), F.col("z.date").alias("last_date"),
                 ((ind.ratio("peak", "entry_price") - 1) * 100).alias("max_pnl_pct"),
                 ((ind.ratio("z.close", "entry_price") - 1) * 100).alias("pnl_pct"),
                 F.coalesce("planned_stop", atr_stop).alias("initial_stop"),
                 (F.col("hh") - trail_atr * F.col("z.atr")).alias("_trail"))
    trail = F.greatest("_trail", F.coalesce("armed", F.col("_trail")))
    stop = F.when(F.col("max_pnl_pct") >= arm_pct, F.greatest("initial_stop", trail)).otherwise(F.col("initial_stop"))
    g = g.withColumn("chandelier", trail).withColumn("stop", stop)
    hit = F.col("last_close") < F.col("stop")
    back = (F.col("max_pnl_pct") >= giveback_from) & (F.col("pnl_pct") <= F.col("max_pnl_pct") - giveback_allow + 1e-9)
    late = (F.col("tdays") >= time_days) & (F.col("pnl_pct") < time_profit)
    reasons = F.concat_ws("; ", F.when(hit, "STOP_HIT"), F.when(back, "GIVEBACK"), F.when(late, "TIME_STOP"))
    risk = F.col("entry_price") - F.col("initial_stop")
    return g.select(
        "position_id", "ticker", "entry_date", "entry_price", "shares", "last_date", "last_close", "pnl_pct", "max_pnl_pct", "initial_stop",
        F.col("chandelier").alias("chandelier_stop"), F.col("stop").alias("stop_level"), "tdays",
        F.when(risk > 0, (F.col("last_close") - F.col("entry_price")) / risk).alias("r_multiple"),
        F.when(hit | back | late, "SELL").otherwise("HOLD").alias("status"), F.when(reasons == "", "OK").otherwise(reasons).alias("reason"))


def fixed_exits(positions: DataFrame, bars: DataFrame, max_days: int = 10) -> DataFrame:
    """Stop first, then target, then time, on the day a position is looked at."""
    g = last_bars(positions, bars)
    hit, top, late = F.col("z.low") <= F.col("stop_price"), F.col("z.high") >= F.col("target_price"), F.col("tdays") >= max_days
    fill = F.when(hit, F.col("stop_price")).when(top, F.col("target_price")).otherwise(F.col("z.close"))
    reason = F.when(hit, "STOP_HIT").when(top, "TARGET_HIT").when(late, "TIME_STOP").otherwise("OK")
    return g.select("position_id", "ticker", "tdays", fill.alias("fill_price"), ((ind.ratio(fill, "entry_price") - 1) * 100).alias("pnl_pct"),
                    F.when(reason == "OK", "HOLD").otherwise("SELL").alias("status"), reason.alias("reason"))


def trailing_status(positions: DataFrame, bars: DataFrame, trail: float) -> DataFrame:
    g = since_entry(positions, bars).withColumn("current", F.col("z.close"))
    drop = ind.ratio(F.col("peak") - F.col("current"), "peak")
    return g.select("position_id", "ticker", "peak", "current", drop.alias("drop_from_peak"),
                    ind.ratio(F.col("current") - F.col("entry_price"), "entry_price").alias("gain"), (drop >= trail).alias("flagged"))


def dividends_in_hold(trades: DataFrame, dividends: DataFrame) -> DataFrame:
    """Dividends with an ex-date after the entry and up to the exit.

    The sum over a range is the difference of two running totals, so the range
    join becomes two as-of look-ups.  Units that fit a decimal are added up exactly, so that no
    difference loses digits; larger ones are added up apart from them, as doubles.
    """
    w = Window.partitionBy("ticker").orderBy("ex_date").rowsBetween(Window.unboundedPreceding, 0)
    u = F.col("units")
    paid = dividends.select(
        "ticker", "ex_date", F.sum(F.when(u < 9e18, u.cast("decimal(20,0)")).otherwise(0)).over(w).alias("paid"),
        F.sum(F.when(u >= 9e18, u).otherwise(0.0)).over(w).alias("large"))
    j = asof_join(trades, paid, "ticker", "entry_date", "ex_date", {"paid": "_before", "large": "_before_large"})
    j = asof_join(j, paid, "ticker", "exit_date", "ex_date", {"paid": "_after", "large": "_after_large"}, points=trades)
    since = lambda c: (F.coalesce(f"_after{c}", F.lit(0)) - F.coalesce(f"_before{c}", F.lit(0))).cast("double")
    return j.withColumn("dividends", (since("") + since("_large")) * F.col("shares") / 10000).drop("_before", "_after", "_before_large", "_after_large")


def latest_intent_within(trades: DataFrame, intents: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """The last processed executed intent of the ticker within a price tolerance of the entry.

    Prices meet on a bucket of the tolerance's width; intents enter their own bucket
    and both neighbours, so the join is an equi-join and the exact test is a residual.
    A bucket is a whole double, as a long ends at prices of 9e12: where no double lies beside it, prices
    are further apart than the tolerance and only equal ones meet.  Each distinct price is looked up once, a table as small as the bars.
    """
    bucket = lambda c: ind.whole(F.col(c) / tolerance)
    per_price = intents.where("intent_status = 'EXECUTED'").groupBy("ticker", "executed_price").agg(
        F.max(F.struct("processed_at", "intent_id", "stop_price")).alias("i"))
    around = F.array_distinct(F.array(bucket("executed_price") - 1, bucket("executed_price"), bucket("executed_price") + 1))
    spread = per_price.withColumn("_k", F.explode(around))
    asked = trades.select("ticker", "entry_price").distinct().withColumn("_k", bucket("entry_price"))
    near = F.abs(F.col("executed_price") - F.col("entry_price")) < tolerance
    found = asked.join(spread, ["ticker", "_k"]).where(near).groupBy("ticker", "entry_price").agg(F.max("i").alias("i"))
    return trades.join(found, ["ticker", "entry_price"], "left").select(*trades.columns, F.col("i.intent_id").alias("intent_id"),
                                                                      F.col("i.stop_price").alias("stop_price"))


def exit_category(c: str) -> Column:
    head = F.trim(F.regexp_extract(c, r"^([^(;]*)", 1))
    return F.when(F.col(c).isNull() | (head == ""), "unknown").otherwise(head)


def stop_bucket(c: str) -> Column:
    x = F.col(c)
    return F.when(x.isNull(), "unknown").when(x < 6, "<6%").when(x <= 8, "6-8%").otherwise(">8%")


# Round-trip spread in basis points per cost scenario.
SPREADS = {"zero": 0.0, "realistic": 10.0, "adverse": 20.0}


def trade_excess(trades: DataFrame, bench: DataFrame, dividends: DataFrame, sectors: DataFrame) -> DataFrame:
    """Each trade against the benchmark over its own holding period, under three cost scenarios."""
    from tapeloom.operators.patterns import market_regime

    b = bench.select(F.col("date").alias("b_date"), "open", "close")
    r = market_regime(bench).where("sma is not null").select(
        F.col("date").alias("r_date"), F.when(F.col("close") >= F.col("sma"), "above_200d").otherwise("below_200d").alias("regime"))
    t = dividends_in_hold(trades, dividends)
    t = asof_join(t, b, None, "entry_date", "b_date", {"open": "b_open"}, direction="forward", points=trades)
    t = asof_join(t, b, None, "exit_date", "b_date", {"close": "b_close"}, points=trades)
    t = asof_join(t, r, None, "entry_date", "r_date", {"regime": "regime"}, strict=True, points=trades)
    t = t.join(sectors, "ticker", "left")
    n0, n1 = F.col("entry_price") * F.col("shares"), F.col("exit_price") * F.col("shares")
    t = t.withColumn("entry_notional", n0).withColumn("bench_ret", ind.ratio("b_close", "b_open") - 1)
    gross = n1 - n0 + F.col("dividends")
    t = t.withColumn("gross_pnl", gross).withColumn("bench_pnl", n0 * F.col("bench_ret"))
    for name, bps in SPREADS.items():
        t = t.withColumn(f"excess_{name}", ind.ratio(F.col("gross_pnl") - F.col("bench_pnl") - (n0 + n1) * bps / 10000, "entry_notional") * 100)
    stop_pct = (5 + F.col("trade_id") % 4).cast("double")
    return t.select("*", stop_pct.alias("stop_pct")).select(
        "trade_id", "ticker", "book", "entry_date", "exit_date", "entry_notional", "gross_pnl", "bench_ret", "bench_pnl", "dividends",
        *[f"excess_{n}" for n in SPREADS], F.coalesce("regime", F.lit("unknown")).alias("regime"),
        F.coalesce("sector", F.lit("Unknown")).alias("sector"), stop_bucket("stop_pct").alias("stop_bucket"), exit_category("reason").alias("exit_cat"),
        F.datediff("exit_date", "entry_date").alias("hold_days"))


def excess_slices(excess: DataFrame) -> DataFrame:
    """Mean excess by each of five dimensions: one unpivot and one aggregation."""
    dims = ["stop_bucket", "exit_cat", "sector", "regime", "ticker"]
    long = excess.select("excess_realistic", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(
        F.count("*").alias("trades"), F.avg("excess_realistic").alias("mean_excess"),
        F.avg((F.col("excess_realistic") > 0).cast("double")).alias("beat_rate"))


def excess_scenarios(excess: DataFrame) -> DataFrame:
    long = excess.select("gross_pnl", "bench_pnl", "entry_notional", F.explode(F.array(*[
        F.struct(F.lit(n).alias("costs"), F.col(f"excess_{n}").alias("x")) for n in SPREADS])).alias("s"))
    x = F.col("s.x")
    return long.groupBy("s.costs").agg(
        F.count("*").alias("trades"), F.sum("gross_pnl").alias("gross_pnl"), F.sum("bench_pnl").alias("bench_pnl"),
        F.sum(x * F.col("entry_notional") / 100).alias("excess_total"), F.avg(x).alias("mean_excess"),
        F.avg((x > 0).cast("double")).alias("beat_rate"))


def trade_stats(trades: DataFrame, keys: list[str]) -> DataFrame:
    """Count, win rate, mean win and loss in money and in per cent, profit factor and holding time.

    A mean without a trade is 0, and the profit factor without a loss is infinite.
    """
    pnl = (F.col("exit_price") - F.col("entry_price")) * F.col("shares")
    pct = (ind.ratio("exit_price", "entry_price") - 1) * 100
    t = trades.withColumn("pnl", pnl).withColumn("pct", pct)
    zero = F.lit(0.0)
    won = F.coalesce(F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), zero)
    lost = F.abs(F.coalesce(F.sum(F.when(F.col("pnl") <= 0, F.col("pnl"))), zero))
    mean = lambda c, test: F.coalesce(F.avg(F.when(test, F.col(c))), zero)
    return t.groupBy(*keys).agg(
        F.count("*").alias("trades"), (F.avg((F.col("pnl") > 0).cast("double")) * 100).alias("win_rate"),
        mean("pnl", F.col("pnl") > 0).alias("avg_win"), mean("pnl", F.col("pnl") <= 0).alias("avg_loss"),
        mean("pct", F.col("pnl") > 0).alias("avg_win_pct"), mean("pct", F.col("pnl") <= 0).alias("avg_loss_pct"),
        F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.avg(F.datediff("exit_date", "entry_date")).alias("avg_hold"),
        F.sum("pnl").alias("total_pnl"))


def mark_to_market(positions: DataFrame, bars: DataFrame, max_age: int = 10) -> DataFrame:
    """Positions at the last close not older than ``max_age`` days, else at cost."""
    px = bars.select("ticker", F.col("date").alias("px_date"), "close", F.col("date").alias("at"))
    j = asof_join(positions, px, "ticker", "as_of", "px_date", {"close": "last", "at": "at"})
    fresh = F.datediff("as_of", "at") <= max_age
    price = F.when(fresh, F.col("last")).otherwise(F.col("entry_price"))
    cost, value = F.col("entry_price") * F.col("shares"), price * F.col("shares")
    return j.select("position_id", "book", "ticker", "shares", "entry_price", price.alias("price"), cost.alias("cost"), value.alias("value"),
                    (value - cost).alias("unrealized"), ((ind.ratio(price, "entry_price") - 1) * 100).alias("unrealized_pct"))


def portfolio_kpis(customers: DataFrame, transactions: DataFrame, marked: DataFrame) -> DataFrame:
    """Per book: market value, equity, implied initial capital (cash + buys - sells) and return."""
    amount = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0.0))
    tx = transactions.where("status <> 'O' or side = 'BUY'").groupBy("book").agg(amount("BUY").alias("bought"), amount("SELL").alias("sold"))
    held = marked.groupBy("book").agg(F.sum("value").alias("market_value"), F.sum("unrealized").alias("unrealized"))
    j = customers.select(F.col("c_custkey").alias("book"), F.col("c_acctbal").alias("cash")).join(tx, "book").join(held, "book", "left").na.fill(
        0.0, ["market_value", "unrealized"])
    equity, initial = F.col("cash") + F.col("market_value"), F.col("cash") + F.col("bought") - F.col("sold")
    return j.select("*", equity.alias("equity"), initial.alias("initial_capital"),
                    F.when(initial > 0, (equity / initial - 1) * 100).alias("return_pct"))


def monthly_grid(curve: DataFrame) -> DataFrame:
    """Month-end returns of one equity curve as a year-by-month grid."""
    ends = curve.groupBy(F.year("date").alias("year"), F.month("date").alias("month")).agg(F.max_by("equity", "date").alias("equity"))
    w = Window.partitionBy(F.lit(0)).orderBy("year", "month")
    r = ends.withColumn("ret", (ind.ratio("equity", F.lag("equity").over(w)) - 1) * 100)
    grid = r.groupBy("year").pivot("month", list(range(1, 13))).agg(F.first("ret"))
    return grid.toDF("year", *[f"m{m}" for m in range(1, 13)])


def persistence(history: DataFrame, min_days: int, cap: int) -> DataFrame:
    """Tickers by how often, and how recently, they were on the screen.

    ``history`` is (date, ticker); the i-th of n dates weighs 1 + 0.2 i / (n - 1).
    """
    dates = history.select("date").distinct()
    w = Window.partitionBy(F.lit(0))
    placed = dates.withColumn("i", F.row_number().over(w.orderBy("date")) - 1).withColumn("n", F.count("*").over(w))
    weight = 1 + 0.2 * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    g = history.distinct().join(placed, "date").groupBy("ticker").agg(F.count("*").alias("days"), F.sum(weight).alias("weighted"))
    return g.where(F.col("days") >= min_days).orderBy(F.round("weighted", 6).desc(), "ticker").limit(cap)


def near_close(requests: DataFrame, bars: DataFrame, max_age: int = 10, points: DataFrame | None = None) -> DataFrame:
    """Close on a date, else the last close at most ``max_age`` days old."""
    px = bars.select("ticker", F.col("date").alias("px_date"), "close", F.col("date").alias("at"))
    j = asof_join(requests, px, "ticker", "want", "px_date", {"close": "close", "at": "at"}, points=points)
    return j.withColumn("fill", F.when(F.datediff("want", "at") <= max_age, F.col("close")))


def next_open(requests: DataFrame, bars: DataFrame) -> DataFrame:
    """First open strictly after a date."""
    px = bars.select("ticker", F.col("date").alias("px_date"), "open", F.col("date").alias("at"))
    return asof_join(requests, px, "ticker", "want", "px_date", {"open": "fill", "at": "fill_date"}, direction="forward", strict=True)


# --- buy selection ----------------------------------------------------------------------------------------------

def select_buys(queue: DataFrame, owned: DataFrame, sectors: DataFrame, min_date: Column, slots: int, per_sector: int,
                funds: float, risk_pct: float, gap_pct: float | None = None) -> DataFrame:
    """Buy decisions for each run of a pending queue, in priority order.

    ``queue`` carries the ``price`` a buy would be filled at, null where there is none.  A row with a place is still refused without a price,
    for a price more than ``gap_pct`` above the planned one, or at or below its stop; its place stays empty.  Shares follow the risk
    between the fill and the stop, not the planned one.

    A row is checked for staleness, a repeated ticker and ownership, then takes a
    place while its sector and the portfolio have one.  A row refused by its sector
    takes no slot, so both limits are running counts.  ``queue`` and ``owned`` carry
    ``run``; a run is one day's queue of one account.
    """
    order = ["priority", "intent_id"]
    held = owned.select("run", "ticker").distinct().withColumn("_owned", F.lit(True))
    q = queue.join(held, ["run", "ticker"], "left").join(sectors, "ticker", "left").withColumn("sector", F.coalesce("sector", F.lit("Unknown")))
    q = q.withColumn("_stale", F.col("signal_date") < min_date)
    first = q.where("not _stale").groupBy("run", "ticker").agg(F.min(F.struct(*order)).alias("_f")).select("run", "ticker", "_f.intent_id", F.lit(True).alias("_first"))
    q = q.join(first, ["run", "ticker", "intent_id"], "left")
    q = q.withColumn("_why", F.when(F.col("_stale"), "stale_intent").when(F.col("_first").isNull(), "duplicate_pending").when(F.col("_owned"), "already_owned"))
    done = q.where("_why is not null").select("run", "intent_id", "ticker", "sector", "priority", F.lit("SKIPPED").alias("status"), F.col("_why").alias("reason"),
                                              F.lit(None).cast("bigint").alias("shares"), F.lit(None).cast("double").alias("fill_price"))
    # What is left has one row per run and ticker, so the running counts see at most the listed tickers.
    q = q.where("_why is null")
    counts = owned.select("run", "ticker").distinct().join(sectors, "ticker", "left").groupBy(
        "run", F.coalesce("sector", F.lit("Unknown")).alias("sector")).agg(F.count("*").alias("_in_sector"))
    total = held.groupBy("run").agg(F.count("*").alias("_held"))
    q = q.join(counts, ["run", "sector"], "left").join(total, "run", "left").na.fill(0, ["_in_sector", "_held"])
    up = lambda *k: Window.partitionBy("run", *k).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    q = q.withColumn("_rank", F.count("*").over(up("sector")))
    fits = F.col("_rank") + F.col("_in_sector") <= per_sector
    q = q.withColumn("_fits", fits).withColumn("_slot", F.sum(F.col("_fits").cast("int")).over(up()))
    left = F.lit(slots) - F.col("_held")
    price, stop = F.col("price"), F.col("stop_price")
    shares = F.least(ind.whole(ind.ratio(F.lit(funds * risk_pct / 100), price - stop)), ind.whole(ind.ratio(F.lit(funds) / left, price)))
    # Once the slots are full every later open row is refused for that, whatever its sector.
    full = F.col("_slot") - F.col("_fits").cast("int") >= left
    gap = price > F.col("planned") * (1 + gap_pct / 100) if gap_pct is not None else F.lit(False)
    yes = lambda test: F.coalesce(test, F.lit(False))
    why = (F.when(left <= 0, "portfolio_full").when(full, "no_slot_left").when(~F.col("_fits"), F.concat(F.lit("sector_cap_"), F.col("sector")))
           .when(~yes(price > 0), "no_price_data").when(yes(gap), "gap_up").when(~yes(F.col("planned") > stop), "invalid_stop_data")
           .when(~(price > stop), "price_below_stop").when(shares <= 0, "allocation_too_small"))
    q = q.withColumn("reason", why)
    bought = F.col("reason").isNull()
    return done.unionByName(q.select("run", "intent_id", "ticker", "sector", "priority", F.when(bought, "EXECUTED").otherwise("SKIPPED").alias("status"),
                                     "reason", F.when(bought, shares).alias("shares"), F.when(bought, price).alias("fill_price")))


def week_of(c: str) -> Column:
    return F.date_trunc("week", c).cast("date")


def weekly_queue(intents: DataFrame) -> DataFrame:
    """Pending intents, one run per week."""
    return intents.where("intent_status = 'PENDING'").withColumn("run", week_of("signal_date"))


def weekly_owned(trades: DataFrame) -> DataFrame:
    """Tickers held at each weekly run."""
    return trades.where("status = 'P' and trade_id % 3 = 0").select(week_of("entry_date").alias("run"), "ticker").distinct()


def weekly_buys(intents: DataFrame, trades: DataFrame, sectors: DataFrame, bars: DataFrame, gap_pct: float | None = 5.0) -> DataFrame:
    """The buys of each week's queue, filled at the first open after the week."""
    queue = weekly_queue(intents).withColumn("want", F.date_add("run", 6))
    priced = next_open(queue, bars).withColumnRenamed("fill", "price")
    return select_buys(priced, weekly_owned(trades), sectors, F.date_add("run", 2), slots=8, per_sector=2, funds=50000.0, risk_pct=1.0, gap_pct=gap_pct)


def regime_override(view: DataFrame, bench: DataFrame) -> DataFrame:
    """HOLD becomes SELL while the newest market regime is risk-off."""
    from tapeloom.operators.patterns import market_regime

    ok = market_regime(bench).agg(F.max_by("market_ok", "date")).scalar()
    return view.withColumn("status", F.when(~ok, "SELL").otherwise(F.col("status")))


def position_view(positions: DataFrame, bars: DataFrame, min_bars: dict[str, int]) -> DataFrame:
    """Every position with its book's minimum history applied; positions without bars are reported, not dropped."""
    kinds = list(min_bars)
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("position_id") % len(kinds) + 1).cast("int"))
    view = exit_view(positions, bars, **EXITS).select("position_id", "tdays", "status", "reason")
    j = positions.select("position_id", pick(kinds).alias("book_kind"), pick(min_bars.values()).alias("need")).join(view, "position_id", "left")
    none, few = F.col("tdays").isNull(), F.col("tdays") < F.col("need")
    return j.select("position_id", "book_kind", F.when(none | few, "NO_DATA").otherwise(F.col("status")).alias("status"),
                    F.when(none, "no bars").when(few, "too few bars").otherwise(F.col("reason")).alias("reason"))


def fill_prices(trades: DataFrame, bars: DataFrame) -> DataFrame:
    """Next open after, and last fresh close at, an order date up to eight days after each exit."""
    want = trades.select("trade_id", "ticker", F.date_add("exit_date", (F.col("trade_id") % 9).cast("int")).alias("want"))
    a = next_open(want, bars).withColumnRenamed("fill", "next_open")
    return near_close(a, bars, points=want).withColumnRenamed("fill", "close_fill")


def summary(marked: DataFrame, trades: DataFrame) -> DataFrame:
    realized = trades.where("status <> 'O'").agg(F.sum((F.col("exit_price") - F.col("entry_price")) * F.col("shares")))
    held = marked.agg(F.count("*").alias("positions"), F.sum("cost").alias("cost"), F.sum("value").alias("value"), F.sum("unrealized").alias("unrealized"))
    return held.withColumn("realized", realized.scalar())


def reconcile(transactions: DataFrame, trades: DataFrame) -> DataFrame:
    """Cash moved by each trade's transactions against its profit, to the rounding of two amounts."""
    cash = transactions.groupBy("trade_id").agg(F.sum(F.when(F.col("side") == "BUY", -F.col("amount")).otherwise(F.col("amount"))).alias("cash"))
    gap = F.col("cash") - (F.col("exit_price") - F.col("entry_price")) * F.col("shares")
    return cash.join(trades, "trade_id").select("trade_id", gap.alias("difference"), (F.abs(gap) < 0.011).alias("balanced"))


def sector_groups(trades: DataFrame, sectors: DataFrame) -> DataFrame:
    """Trades per sector, largest first and Unknown last."""
    known = F.when(F.col("trade_id") % 11 != 0, F.col("sector"))
    g = trades.join(sectors, "ticker", "left").groupBy(F.coalesce(known, F.lit("Unknown")).alias("sector")).agg(F.count("*").alias("trades"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("sector") == "Unknown", F.col("trades").desc(), "sector")
    return g.withColumn("place", F.row_number().over(w))


def weekly_screen_persistence(bars: DataFrame, gain: float, min_days: int, cap: int) -> DataFrame:
    """Persistence of tickers whose weekly close rose by more than ``gain``."""
    from tapeloom.operators.shaping import weekly_bars

    w = weekly_bars(bars).withColumn("prior", ind.lag("close"))
    return persistence(w.where(F.col("close") > F.col("prior") * gain).select("date", "ticker"), min_days, cap)


def stale_positions(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Positions whose last bar is older than the session before the newest one."""
    sessions = bars.select("date").distinct()
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    sessions = sessions.select(F.col("date").alias("session"), F.lag("date").over(w).alias("previous"))
    px = bars.select("ticker", F.col("date").alias("px_date"), F.col("date").alias("at"))
    j = asof_join(positions, px, "ticker", "as_of", "px_date", {"at": "last_bar"})
    j = asof_join(j, sessions, None, "as_of", "session", {"previous": "previous"}, points=positions)
    return j.select("position_id", "last_bar", F.coalesce(F.col("last_bar") < F.col("previous"), F.lit(True)).alias("stale"))
