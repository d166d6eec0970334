"""Ledger, join and portfolio queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import ledger, scans
from tapeloom.operators.asof import asof_join
from tapeloom.plans import oracle
from tapeloom.plans.registry import query

FR = oracle.FRAGMENTS
T = "@bars, @trades"
query("m5_trades", "trade_id:i book:i status ticker entry_date:d exit_date:d entry_price:f exit_price:f shares:f reason", f"WITH {T} SELECT * FROM trades")(lambda t: t.trades)

query("j1_benchmark_join", "ticker date:d close:f bench_close:f8",
      "WITH @bars, @bench SELECT b.*, m.close AS bench_close FROM bars b JOIN bench m USING (date)")(
    lambda t: scans.with_benchmark(t.bars, t.bench, bench_close="close"))
query("j6_benchmark_on_or_before", "trade_id:i close:f8",
      f"WITH {T}, @bench SELECT trade_id, b.close FROM trades t ASOF LEFT JOIN bench b ON t.exit_date >= b.date")(
    lambda t: asof_join(t.trades, t.bench.withColumnRenamed("date", "b"), None, "exit_date", "b", {"close": "close"}))
query("j7_open_or_next", "trade_id:i b_open:f8 b_close:f8",
      f"""WITH {T}, @bench SELECT trade_id, o.open AS b_open, c.close AS b_close FROM trades t ASOF LEFT JOIN bench o ON t.entry_date <= o.date
      ASOF LEFT JOIN bench c ON t.exit_date >= c.date""")(
    lambda t: asof_join(asof_join(t.trades, t.bench.withColumnRenamed("date", "b"), None, "entry_date", "b", {"open": "b_open"}, "forward"),
                        t.bench.withColumnRenamed("date", "b"), None, "exit_date", "b", {"close": "b_close"}, points=t.trades))
FR["excess"] = """xr AS (SELECT date, CASE WHEN close >= sma THEN 'above_200d' ELSE 'below_200d' END AS regime FROM regime WHERE sma IS NOT NULL),
xd AS (SELECT trade_id, sum(units) AS u FROM trades t JOIN dividends d ON d.ticker = t.ticker AND ex_date > entry_date AND ex_date <= exit_date GROUP BY 1),
xa AS (SELECT t.*, coalesce(u, 0) * shares / 10000 AS dividends, c.close / o.open - 1 AS bench_ret, coalesce(r.regime, 'unknown') AS regime, coalesce(s.sector, 'Unknown') AS sector,
  entry_price * shares AS entry_notional, exit_price * shares AS n1, CAST(5 + trade_id % 4 AS DOUBLE) AS stop_pct FROM trades t LEFT JOIN xd USING (trade_id)
  ASOF LEFT JOIN bench o ON t.entry_date <= o.date ASOF LEFT JOIN bench c ON t.exit_date >= c.date ASOF LEFT JOIN xr r ON t.entry_date > r.date LEFT JOIN sectors s ON s.ticker = t.ticker),
xb AS (SELECT *, n1 - entry_notional + dividends AS gross_pnl, entry_notional * bench_ret AS bench_pnl FROM xa),
excess AS MATERIALIZED (SELECT *, (gross_pnl - bench_pnl) / entry_notional * 100 AS excess_zero, (gross_pnl - bench_pnl - (entry_notional + n1) * 0.001) / entry_notional * 100 AS excess_realistic,
  (gross_pnl - bench_pnl - (entry_notional + n1) * 0.002) / entry_notional * 100 AS excess_adverse, CASE WHEN stop_pct < 6 THEN '<6%' WHEN stop_pct <= 8 THEN '6-8%' ELSE '>8%' END AS stop_bucket,
  trim(regexp_extract(reason, '^([^(;]*)', 1)) AS exit_cat, exit_date - entry_date AS hold_days FROM xb)"""
X = "@bars, @trades, @bench, @dividends, @sectors, @regime, @excess"
excess = lambda t: ledger.trade_excess(t.trades, t.bench, t.dividends, t.sectors)
query("j8_regime_at_entry", "trade_id:i regime", f"WITH {X} SELECT * FROM excess")(excess)
query("j9_dividends_in_hold", "trade_id:i dividends:f4", f"WITH {X} SELECT * FROM excess")(lambda t: ledger.dividends_in_hold(t.trades, t.dividends))
query("e18_trade_excess", "trade_id:i entry_notional:f4 gross_pnl:f4 bench_ret:f bench_pnl:f4 excess_zero:f excess_realistic:f excess_adverse:f hold_days:i sector stop_bucket exit_cat",
      f"WITH {X} SELECT * FROM excess")(excess)
query("a18_excess_slices", "dimension value trades:i mean_excess:f beat_rate:f",
      f"""WITH {X}, l AS (SELECT excess_realistic AS x, unnest(['stop_bucket', 'exit_cat', 'sector', 'regime', 'ticker']) AS dimension, unnest([stop_bucket, exit_cat, sector, regime, ticker]) AS value FROM excess)
      SELECT dimension, value, count(*) AS trades, avg(x) AS mean_excess, avg((x > 0) :: INT) AS beat_rate FROM l GROUP BY 1, 2""")(lambda t: ledger.excess_slices(excess(t)))
query("a19_excess_scenarios", "costs trades:i gross_pnl:f2 bench_pnl:f2 excess_total:f2 mean_excess:f beat_rate:f",
      f"""WITH {X}, l AS (SELECT *, unnest(['zero', 'realistic', 'adverse']) AS costs, unnest([excess_zero, excess_realistic, excess_adverse]) AS x FROM excess)
      SELECT costs, count(*) AS trades, sum(gross_pnl) AS gross_pnl, sum(bench_pnl) AS bench_pnl, sum(x * entry_notional / 100) AS excess_total, avg(x) AS mean_excess, avg((x > 0) :: INT) AS beat_rate
      FROM l GROUP BY 1""")(lambda t: ledger.excess_scenarios(excess(t)))
query("a21_exit_reason_mix", "sector exit_cat n:i", f"WITH {X} SELECT sector, exit_cat, count(*) AS n FROM excess GROUP BY 1, 2")(
    lambda t: excess(t).groupBy("sector", "exit_cat").agg(F.count("*").alias("n")))
query("x13_buckets", "trade_id:i stop_bucket hold_bucket",
      f"WITH {X} SELECT trade_id, stop_bucket, CASE WHEN hold_days < 30 THEN 'a <30d' WHEN hold_days < 365 THEN 'b 30-364d' ELSE 'c 365d+' END AS hold_bucket FROM excess")(
    lambda t: excess(t).withColumn("hold_bucket", F.when(F.col("hold_days") < 30, "a <30d").when(F.col("hold_days") < 365, "b 30-364d").otherwise("c 365d+")))

PJ = "@bars, @trades, @positions"
FR["held"] = """held AS MATERIALIZED (SELECT p.*, b.date, b.open, b.high, b.low, b.close, b.volume FROM positions p JOIN bars b ON b.ticker = p.ticker AND b.date BETWEEN p.entry_date AND p.as_of)"""
query("j10_bars_since_entry", "position_id:i bars:i high:f peak:f last_close:f",
      f"WITH {PJ}, @held SELECT position_id, count(*) AS bars, max(high) AS high, max(close) AS peak, max_by(close, date) AS last_close FROM held GROUP BY 1")(
    lambda t: ledger.since_entry(t.positions, t.bars).select("position_id", F.col("tdays").alias("bars"), F.col("hh").alias("high"), "peak", F.col("z.close").alias("last_close")))
query("w41_trading_days", "position_id:i tdays:i", f"WITH {PJ}, @held SELECT position_id, count(*) AS tdays FROM held GROUP BY 1")(lambda t: ledger.last_bars(t.positions, t.bars))
query("p44_trailing_status", "position_id:i peak:f current:f drop_from_peak:f gain:f flagged:b",
      f"""WITH {PJ}, @held, g AS (SELECT position_id, entry_price, max(close) AS peak, max_by(close, date) AS current FROM held GROUP BY 1, 2)
      SELECT *, (peak - current) / peak AS drop_from_peak, (current - entry_price) / entry_price AS gain, (peak - current) / peak >= 0.05 AS flagged FROM g""")(
    lambda t: ledger.trailing_status(t.positions, t.bars, 0.05))
FR["exits"] = """ex0 AS (SELECT h.*, i.atr, max(h.high) OVER w AS hh, max(h.close) OVER w AS pk FROM held h JOIN ind i ON i.ticker = h.ticker AND i.date = h.date
  WINDOW w AS (PARTITION BY position_id ORDER BY h.date)),
ex1 AS (SELECT position_id, ticker, entry_date, entry_price, shares, planned_stop, max(date) AS last_date, max_by(close, date) AS lc, max(hh) AS hh, max(pk) AS pk, max_by(atr, date) AS atr, count(*) AS tdays,
  max(CASE WHEN (pk / entry_price - 1) * 100 >= 8 THEN hh - 2.5 * atr END) AS armed FROM ex0 GROUP BY ALL),
ex2 AS (SELECT *, (lc / entry_price - 1) * 100 AS pnl_pct, (pk / entry_price - 1) * 100 AS max_pnl_pct, coalesce(planned_stop, entry_price - 2 * atr) AS initial_stop, greatest(hh - 2.5 * atr, coalesce(armed, hh - 2.5 * atr)) AS chandelier_stop FROM ex1),
ex3 AS (SELECT *, CASE WHEN max_pnl_pct >= 8 THEN greatest(initial_stop, chandelier_stop) ELSE initial_stop END AS stop_level FROM ex2),
exits AS MATERIALIZED (SELECT *, lc AS last_close, CASE WHEN entry_price > initial_stop THEN (lc - entry_price) / (entry_price - initial_stop) END AS r_multiple,
  coalesce(nullif(concat_ws('; ', CASE WHEN lc < stop_level THEN 'STOP_HIT' END, CASE WHEN max_pnl_pct >= 6 AND pnl_pct <= max_pnl_pct - 3 + 1e-9 THEN 'GIVEBACK' END,
  CASE WHEN tdays >= 20 AND pnl_pct < 0 THEN 'TIME_STOP' END), ''), 'OK') AS reason FROM ex3)"""
EX = "@bars, @rec, @trades, @positions, @held, @exits"
query("w40_ratcheting_trail", "position_id:i hh:f peak:f trail:f4 armed:b", f"WITH {EX} SELECT position_id, hh, pk AS peak, armed AS trail, armed IS NOT NULL AS armed FROM ex1")(
    lambda t: ledger.since_entry(t.positions, t.bars).select("position_id", "hh", "peak", F.col("armed").alias("trail"), F.col("armed").isNotNull().alias("armed")))
query("p45_exit_rules", "position_id:i last_date:d last_close:f pnl_pct:f max_pnl_pct:f initial_stop:f chandelier_stop:f4 stop_level:f tdays:i r_multiple:f4 status reason",
      f"WITH {EX} SELECT *, CASE WHEN reason = 'OK' THEN 'HOLD' ELSE 'SELL' END AS status FROM exits")(lambda t: ledger.exit_view(t.positions, t.bars, **ledger.EXITS))
query("p46_fixed_exits", "position_id:i tdays:i fill_price:f pnl_pct:f status reason",
      f"""WITH {PJ}, @held, g AS (SELECT position_id, entry_price, stop_price, target_price, max_by(low, date) AS l, max_by(high, date) AS h, max_by(close, date) AS c, count(*) AS tdays FROM held GROUP BY ALL),
      r AS (SELECT *, CASE WHEN l <= stop_price THEN 'STOP_HIT' WHEN h >= target_price THEN 'TARGET_HIT' WHEN tdays >= 10 THEN 'TIME_STOP' ELSE 'OK' END AS reason,
        CASE WHEN l <= stop_price THEN stop_price WHEN h >= target_price THEN target_price ELSE c END AS fill_price FROM g)
      SELECT *, (fill_price / entry_price - 1) * 100 AS pnl_pct, CASE WHEN reason = 'OK' THEN 'HOLD' ELSE 'SELL' END AS status FROM r""")(lambda t: ledger.fixed_exits(t.positions, t.bars))
query("p47_regime_override", "position_id:i status",
      f"""WITH {EX}, @bench, @regime, r AS (SELECT max_by(market_ok, date) AS ok FROM regime) SELECT position_id, CASE WHEN reason <> 'OK' OR NOT ok THEN 'SELL' ELSE 'HOLD' END AS status FROM exits, r""")(
    lambda t: ledger.regime_override(ledger.exit_view(t.positions, t.bars, **ledger.EXITS), t.bench))
query("p57_position_view", "position_id:i book_kind status reason",
      f"""WITH {EX}, b AS (SELECT p.position_id, CASE p.position_id % 3 WHEN 0 THEN 'core' WHEN 1 THEN 'momentum' ELSE 'swing' END AS book_kind FROM positions p)
      SELECT b.position_id, book_kind, CASE WHEN e.position_id IS NULL OR tdays < m THEN 'NO_DATA' WHEN reason = 'OK' THEN 'HOLD' ELSE 'SELL' END AS status,
        CASE WHEN e.position_id IS NULL THEN 'no bars' WHEN tdays < m THEN 'too few bars' ELSE reason END AS reason
      FROM b JOIN (VALUES ('core', 5), ('momentum', 3), ('swing', 1)) v(k, m) ON k = book_kind LEFT JOIN exits e USING (position_id)""")(
    lambda t: ledger.position_view(t.positions, t.bars, {"core": 5, "momentum": 3, "swing": 1}))

TX = "@bars, @trades, @transactions"
query("j11_matching_intent", "trade_id:i intent_id:i stop_price:f",
      """WITH @bars, @trades, @intents SELECT trade_id, i.intent_id, i.stop_price FROM trades t LEFT JOIN LATERAL (SELECT intent_id, stop_price FROM intents i WHERE i.intent_status = 'EXECUTED' AND i.ticker = t.ticker
      AND abs(i.executed_price - t.entry_price) < 1e-6 ORDER BY processed_at DESC, intent_id DESC LIMIT 1) i ON true""")(
    lambda t: ledger.latest_intent_within(t.trades, t.intents))
query("j12_positions_with_buys", "position_id:i tx_id:i reason",
      f"WITH {TX}, @positions SELECT position_id, tx_id, x.reason FROM positions p LEFT JOIN transactions x ON side = 'BUY' AND x.trade_id = p.position_id")(
    lambda t: ledger.positions_with_buys(t.transactions))
query("j28_fill_prices", "trade_id:i fill_date:d next_open:f close_fill:f",
      f"""WITH {T}, w AS (SELECT trade_id, ticker, exit_date + CAST(trade_id % 9 AS INTEGER) AS want FROM trades)
      SELECT trade_id, n.date AS fill_date, n.open AS next_open, CASE WHEN want - c.date <= 10 THEN c.close END AS close_fill FROM w
      ASOF LEFT JOIN bars n ON w.ticker = n.ticker AND w.want < n.date ASOF LEFT JOIN bars c ON w.ticker = c.ticker AND w.want >= c.date""")(lambda t: ledger.fill_prices(t.trades, t.bars))
query("s18_ledger_append", "tx_id:i side ticker trade_date:d price:f shares:f amount:f2", f"WITH {TX} SELECT * FROM transactions")(lambda t: t.transactions)
query("s19_ordered_ledger", "tx_id:i ticker trade_date:d",
      f"WITH {TX} SELECT tx_id, ticker, trade_date FROM transactions ORDER BY trade_date, tx_id")(
    lambda t: t.transactions.orderBy("trade_date", "tx_id"))
query("u1_union_open_and_closed", "trade_id:i status stop_price:f exit_price:f",
      f"WITH {PJ} SELECT trade_id, 'closed' AS status, NULL AS stop_price, exit_price FROM trades WHERE status <> 'O' UNION ALL SELECT position_id, 'open', stop_price, NULL FROM positions")(
    lambda t: t.trades.where("status <> 'O'").select("trade_id", F.lit("closed").alias("status"), "exit_price").unionByName(
        t.positions.select(F.col("position_id").alias("trade_id"), F.lit("open").alias("status"), "stop_price"), allowMissingColumns=True))
query("k3_nulls_last_by_rr", "intent_id:i rr:f",
      "WITH @bars, @trades, @intents SELECT intent_id, rr FROM intents WHERE intent_status = 'PENDING' ORDER BY rr DESC NULLS LAST, intent_id")(
    lambda t: t.intents.where("intent_status = 'PENDING'").orderBy(F.col("rr").desc_nulls_last(), "intent_id"))

MK = "@bars, @trades, @positions, @marked"
FR["marked"] = """mk0 AS (SELECT p.*, CASE WHEN p.as_of - b.date <= 10 THEN b.close ELSE p.entry_price END AS price FROM positions p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.as_of >= b.date),
marked AS MATERIALIZED (SELECT *, entry_price * shares AS cost, price * shares AS value, price * shares - entry_price * shares AS unrealized, (price / entry_price - 1) * 100 AS unrealized_pct FROM mk0)"""
marked = lambda t: ledger.mark_to_market(t.positions, t.bars)
query("a3_mark_to_market", "position_id:i price:f cost:f4 value:f4 unrealized:f4 unrealized_pct:f", f"WITH {MK} SELECT * FROM marked")(marked)
query("a4_portfolio_summary", "positions:i cost:f2 value:f2 unrealized:f2 realized:f2",
      f"WITH {MK} SELECT count(*) AS positions, sum(cost) AS cost, sum(value) AS value, sum(unrealized) AS unrealized, (SELECT sum((exit_price - entry_price) * shares) FROM trades WHERE status <> 'O') AS realized FROM marked")(
    lambda t: ledger.summary(marked(t), t.trades))
query("a2_portfolio_kpis", "book:i market_value:f4 unrealized:f4 equity:f4 initial_capital:f4 return_pct:f4",
      f"""WITH {MK}, @transactions, x AS (SELECT book, sum(CASE WHEN side = 'BUY' THEN amount ELSE 0 END) AS b, sum(CASE WHEN side = 'SELL' THEN amount ELSE 0 END) AS s FROM transactions
        WHERE status <> 'O' OR side = 'BUY' GROUP BY 1), h AS (SELECT book, sum(value) AS v, sum(unrealized) AS u FROM marked GROUP BY 1)
      SELECT x.book, coalesce(v, 0) AS market_value, coalesce(u, 0) AS unrealized, c_acctbal + coalesce(v, 0) AS equity, c_acctbal + b - s AS initial_capital,
        CASE WHEN c_acctbal + b - s > 0 THEN ((c_acctbal + coalesce(v, 0)) / (c_acctbal + b - s) - 1) * 100 END AS return_pct
      FROM x JOIN customer ON c_custkey = book LEFT JOIN h ON h.book = x.book""")(lambda t: ledger.portfolio_kpis(t.customer, t.transactions, marked(t)))
query("a26_cash_reconciliation", "trade_id:i difference:f2 balanced:b",
      f"""WITH {TX}, g AS (SELECT trade_id, sum(CASE WHEN side = 'BUY' THEN -amount ELSE amount END) AS cash FROM transactions GROUP BY 1)
      SELECT trade_id, cash - (exit_price - entry_price) * shares AS difference, abs(cash - (exit_price - entry_price) * shares) < 0.011 AS balanced FROM g JOIN trades USING (trade_id)""")(
    lambda t: ledger.reconcile(t.transactions, t.trades))


def stats_sql(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    lead = keys + "," if keys else ""
    return f"""WITH {T}, p AS (SELECT *, (exit_price - entry_price) * shares AS pnl, (exit_price / entry_price - 1) * 100 AS pct FROM trades)
      SELECT {lead} count(*) AS trades, avg((pnl > 0) :: INT) * 100 AS win_rate, coalesce(avg(pnl) FILTER (pnl > 0), 0) AS avg_win, coalesce(avg(pnl) FILTER (pnl <= 0), 0) AS avg_loss,
        coalesce(avg(pct) FILTER (pnl > 0), 0) AS avg_win_pct, coalesce(avg(pct) FILTER (pnl <= 0), 0) AS avg_loss_pct,
        CASE WHEN sum(pnl) FILTER (pnl <= 0) < 0 THEN coalesce(sum(pnl) FILTER (pnl > 0), 0) / abs(sum(pnl) FILTER (pnl <= 0)) ELSE 'Infinity' :: DOUBLE END AS profit_factor, avg(exit_date - entry_date) AS avg_hold, sum(pnl) AS total_pnl FROM p {group}"""


ST = "trades:i win_rate:f avg_win:f4 avg_loss:f4 avg_win_pct:f avg_loss_pct:f profit_factor:f avg_hold:f total_pnl:f2"
query("a5_trade_stats", ST, stats_sql(""))(lambda t: ledger.trade_stats(t.trades, []))
query("a6_trade_stats_by_ticker", "ticker " + ST, stats_sql("ticker"))(lambda t: ledger.trade_stats(t.trades, ["ticker"]))
query("a25_sector_groups", "sector trades:i place:i",
      f"""WITH {T}, @sectors, g AS (SELECT coalesce(CASE WHEN trade_id % 11 = 0 THEN NULL ELSE sector END, 'Unknown') AS sector, count(*) AS trades FROM trades LEFT JOIN sectors USING (ticker) GROUP BY 1)
      SELECT *, row_number() OVER (ORDER BY sector = 'Unknown', trades DESC, sector) AS place FROM g""")(lambda t: ledger.sector_groups(t.trades, t.sectors))
query("a7_monthly_grid", "year:i " + " ".join(f"m{m}:f" for m in range(1, 13)),
      "WITH @bars, @bench, e AS (SELECT year(date) AS year, month(date) AS m, max_by(close, date) AS c FROM bench GROUP BY 1, 2), r AS (SELECT *, (c / lag(c) OVER (ORDER BY year, m) - 1) * 100 AS x FROM e) SELECT year, "
      + ", ".join(f"max(CASE WHEN m = {m} THEN x END) AS m{m}" for m in range(1, 13)) + " FROM r GROUP BY year")(
    lambda t: ledger.monthly_grid(t.bench.select("date", F.col("close").alias("equity"))))
query("a1_weighted_persistence", "ticker days:i weighted:f",
      """WITH @bars, @weekly, h AS (SELECT ticker, date FROM (SELECT *, lag(close) OVER[] AS p FROM weekly) WHERE close > p * 1.02),
      d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM h)),
      g AS (SELECT ticker, count(*) AS days, sum(1 + 0.2 * i / greatest(n - 1, 1)) AS weighted FROM h JOIN d USING (date) GROUP BY 1)
      SELECT * FROM g WHERE days >= 3 ORDER BY round(weighted, 6) DESC, ticker LIMIT 15""")(lambda t: ledger.weekly_screen_persistence(t.bars, 1.02, 3, 15))
query("a24_buy_hold_and_yearly", "ticker year:i compounded:f",
      "WITH @bars, x AS (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars) SELECT ticker, year(date) AS year, product(1 + r) - 1 AS compounded FROM x WHERE r IS NOT NULL GROUP BY 1, 2")(
    lambda t: t.bars.withColumn("r", ind.change_pct()).where("r is not null").groupBy("ticker", F.year("date").alias("year")).agg(
        (F.product(1 + F.col("r")) - 1).alias("compounded")))
query("f17_stale_positions", "position_id:i last_bar:d stale:b",
      f"""WITH {PJ}, s AS (SELECT date, lag(date) OVER (ORDER BY date) AS prev FROM (SELECT DISTINCT date FROM bars)),
      l AS (SELECT p.position_id, p.as_of, b.date AS last_bar FROM positions p ASOF LEFT JOIN bars b ON p.ticker = b.ticker AND p.as_of >= b.date)
      SELECT position_id, last_bar, coalesce(last_bar < prev, true) AS stale FROM l ASOF LEFT JOIN s ON l.as_of >= s.date""")(lambda t: ledger.stale_positions(t.positions, t.bars))

FR["queue"] = """queue AS MATERIALIZED (SELECT CAST(date_trunc('week', signal_date) AS DATE) AS run, * FROM intents WHERE intent_status = 'PENDING'),
owned AS MATERIALIZED (SELECT DISTINCT CAST(date_trunc('week', entry_date) AS DATE) AS run, ticker FROM trades WHERE status = 'P' AND trade_id % 3 = 0),
qp AS (SELECT q.*, n.open AS price FROM queue q ASOF LEFT JOIN bars n ON n.ticker = q.ticker AND q.run + 6 < n.date),
q0 AS (SELECT q.*, coalesce(sector, 'Unknown') AS sector, signal_date < run + 2 AS stale, EXISTS (SELECT 1 FROM owned o WHERE o.run = q.run AND o.ticker = q.ticker) AS own FROM qp q LEFT JOIN sectors s USING (ticker)),
q1 AS (SELECT *, CASE WHEN stale THEN 'stale_intent' WHEN row_number() OVER (PARTITION BY run, ticker, stale ORDER BY priority, intent_id) > 1 THEN 'duplicate_pending' WHEN own THEN 'already_owned' END AS why0 FROM q0),
oc AS (SELECT run, coalesce(sector, 'Unknown') AS sector, count(*) AS n FROM owned LEFT JOIN sectors USING (ticker) GROUP BY 1, 2),
q2 AS (SELECT q1.*, coalesce(oc.n, 0) AS in_sector, (SELECT count(*) FROM owned o WHERE o.run = q1.run) AS held_n,
  count(CASE WHEN why0 IS NULL THEN 1 END) OVER (PARTITION BY q1.run, q1.sector ORDER BY priority, intent_id ROWS UNBOUNDED PRECEDING) AS rk FROM q1 LEFT JOIN oc ON oc.run = q1.run AND oc.sector = q1.sector),
q3 AS (SELECT *, why0 IS NULL AND rk + in_sector <= 2 AS fits FROM q2),
q4 AS (SELECT *, coalesce(count(CASE WHEN fits THEN 1 END) OVER (PARTITION BY run ORDER BY priority, intent_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  least(floor(500 / nullif(price - stop_price, 0)), floor(50000.0 / nullif(8 - held_n, 0) / price)) AS sh FROM q3),
decided AS MATERIALIZED (SELECT *, CASE WHEN why0 IS NOT NULL THEN why0 WHEN held_n >= 8 THEN 'portfolio_full' WHEN before >= 8 - held_n THEN 'no_slot_left' WHEN NOT fits THEN 'sector_cap_' || sector
  WHEN NOT coalesce(price > 0, false) THEN 'no_price_data' WHEN price > planned * 1.05 THEN 'gap_up' WHEN NOT coalesce(planned > stop_price, false) THEN 'invalid_stop_data'
  WHEN NOT price > stop_price THEN 'price_below_stop' WHEN sh <= 0 THEN 'allocation_too_small' END AS reason FROM q4)"""
QQ = "@bars, @trades, @intents, @sectors, @queue"
query("p51_buy_selection", "run:d intent_id:i ticker sector status", f"WITH {QQ} SELECT *, CASE WHEN reason IS NULL THEN 'EXECUTED' ELSE 'SKIPPED' END AS status FROM decided")(lambda t: ledger.weekly_buys(t.intents, t.trades, t.sectors, t.bars))
query("p56_intent_outcomes", "run:d intent_id:i status reason shares:i fill_price:f",
      f"WITH {QQ} SELECT run, intent_id, CASE WHEN reason IS NULL THEN 'EXECUTED' ELSE 'SKIPPED' END AS status, reason, CASE WHEN reason IS NULL THEN sh END AS shares, CASE WHEN reason IS NULL THEN price END AS fill_price FROM decided")(
    lambda t: ledger.weekly_buys(t.intents, t.trades, t.sectors, t.bars))
query("j26_candidates_not_held", "intent_id:i ticker",
      f"WITH {QQ} SELECT intent_id, ticker FROM queue q WHERE NOT EXISTS (SELECT 1 FROM owned o WHERE o.run = q.run AND o.ticker = q.ticker)")(
    lambda t: ledger.weekly_queue(t.intents).join(ledger.weekly_owned(t.trades), ["run", "ticker"], "left_anti"))
