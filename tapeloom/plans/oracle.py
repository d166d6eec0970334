"""Shared SQL fragments for the DuckDB twins.

A twin is written as ``WITH @bars, x AS (...) SELECT ...``; ``expand`` replaces
each ``@name`` by the fragment of that name.  Fragments are written independently
of the Spark operators: the walk is one window instead of three levels, and the
recursive averages are a recursive CTE instead of the blocked closed form.
"""

from __future__ import annotations

import re

FRAGMENTS: dict[str, str] = {}

FRAGMENTS["bars"] = """fills AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS date, l_quantity AS q,
         CAST(round(l_discount * 100) AS INTEGER) - 5 AS step,
         row_number() OVER o AS rn
  FROM lineitem JOIN part ON l_partkey = p_partkey
  WINDOW o AS (PARTITION BY p_brand ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey,
               l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus)),
walk AS (SELECT *, sum(step) OVER (PARTITION BY ticker ORDER BY rn) AS cum FROM fills),
bars AS MATERIALIZED (
  SELECT ticker, date,
         round(50 * exp(min_by(cum - step, rn) / 200.0), 4) AS open,
         round(50 * exp(greatest(min_by(cum - step, rn), max(cum)) / 200.0), 4) AS high,
         round(50 * exp(least(min_by(cum - step, rn), min(cum)) / 200.0), 4) AS low,
         round(50 * exp(max_by(cum, rn) / 200.0), 4) AS close,
         sum(q) AS volume
  FROM walk GROUP BY ticker, date)"""

FRAGMENTS["bench"] = """bench AS MATERIALIZED (
  SELECT date, sum(CAST(round(open * 10000) AS BIGINT)) / (count(*) * 10000.0 :: DOUBLE) AS open,
         sum(CAST(round(close * 10000) AS BIGINT)) / (count(*) * 10000.0 :: DOUBLE) AS close FROM bars GROUP BY date)"""

FRAGMENTS["hourly"] = """ticks AS (
  SELECT event_type AS ticker, date_trunc('hour', ts) AS slot,
         (CAST(round(value * 100) AS BIGINT) % 11) - 5 AS step,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events),
tick_walk AS (SELECT *, sum(step) OVER (PARTITION BY ticker ORDER BY rn) AS cum FROM ticks),
hourly AS MATERIALIZED (
  SELECT ticker, CAST(slot AS DATE) AS day, hour(slot) AS hour,
         round(50 * exp(min_by(cum - step, rn) / 200.0), 4) AS open,
         round(50 * exp(greatest(min_by(cum - step, rn), max(cum)) / 200.0), 4) AS high,
         round(50 * exp(least(min_by(cum - step, rn), min(cum)) / 200.0), 4) AS low,
         round(50 * exp(max_by(cum, rn) / 200.0), 4) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM tick_walk GROUP BY ticker, slot)"""

FRAGMENTS["day_bars"] = """day_bars AS MATERIALIZED (
  SELECT ticker, day AS date, min_by(open, hour) AS open, max(high) AS high, min(low) AS low,
         max_by(close, hour) AS close, sum(volume) AS volume FROM hourly GROUP BY ticker, day)"""

FRAGMENTS["trades"] = """first_line AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
         l_extendedprice) AS pick, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS last_ship,
         sum(l_quantity) OVER (PARTITION BY l_orderkey) AS total_quantity FROM lineitem),
order_leg AS (
  SELECT o_orderkey AS trade_id, o_custkey AS book, o_orderstatus AS status, p_brand AS ticker,
         CAST(least(o_orderdate, last_ship) AS DATE) AS entry_date,
         CAST(greatest(o_orderdate, last_ship) AS DATE) AS exit_date,
         total_quantity AS shares, substring(o_orderpriority, 3) AS reason
  FROM orders JOIN first_line ON o_orderkey = l_orderkey AND pick = 1 JOIN part ON l_partkey = p_partkey),
trades AS MATERIALIZED (
  SELECT o.*, e.close AS entry_price, x.close AS exit_price
  FROM order_leg o
  ASOF JOIN bars e ON o.ticker = e.ticker AND o.entry_date >= e.date
  ASOF JOIN bars x ON o.ticker = x.ticker AND o.exit_date >= x.date)"""

FRAGMENTS["releases"] = """releases AS MATERIALIZED (
  SELECT event_id AS guid, ts, event_type AS ticker, user_id,
         CASE WHEN value < 5 THEN 'financing' WHEN value < 15 THEN 'drilling' WHEN value < 40 THEN 'earnings'
              ELSE 'corporate' END AS category,
         CASE WHEN value >= 40 THEN 'high' WHEN value >= 10 THEN 'medium' ELSE 'low' END AS materiality,
         'feed' || CAST(user_id % 4 AS VARCHAR) AS feed, value, props FROM events)"""

FRAGMENTS["sectors"] = """sectors AS MATERIALIZED (
  SELECT ticker, sector FROM (
    SELECT p_brand AS ticker, p_type AS sector,
           row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS r
    FROM part GROUP BY p_brand, p_type) WHERE r = 1)"""

FRAGMENTS["reports"] = """reports AS MATERIALIZED (
  SELECT doc_id AS report_id, doc_id % 24 AS hour, DATE '1998-01-01' + CAST(doc_id % 700 AS INTEGER) AS published, source AS theme,
         lang, n_chars,
         list_distinct_ordered AS tickers
  FROM (SELECT *, CASE doc_id % 3
      WHEN 0 THEN [a]
      WHEN 1 THEN CASE WHEN a = b THEN [a] ELSE [a, b] END
      ELSE CASE WHEN a = b AND b = c THEN [a] WHEN a = b THEN [a, c] WHEN a = c OR b = c THEN [a, b]
           ELSE [a, b, c] END END AS list_distinct_ordered
    FROM (SELECT *, 'Brand#' || CAST((doc_id * 7) % 25 + 1 AS VARCHAR) AS a,
                 'Brand#' || CAST((doc_id * 11 + 3) % 25 + 1 AS VARCHAR) AS b,
                 'Brand#' || CAST((doc_id * 13 + 5) % 25 + 1 AS VARCHAR) AS c FROM documents)))"""

FRAGMENTS["tags"] = """tags AS MATERIALIZED (
  SELECT d.doc_id AS report_id,
         CASE WHEN quality = 1 AND toxic = 0 THEN 'bullish' WHEN toxic = 1 THEN 'bearish' ELSE 'neutral' END AS tone,
         CASE d.doc_id % 5 WHEN 0 THEN 'upgrade' WHEN 1 THEN 'downgrade' WHEN 2 THEN 'initiate'
              ELSE 'reiterate' END AS action
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


# Recursive indicator state, one row per bar, by stepping through the bar numbers.
FRAGMENTS["rec"] = """rec_in AS MATERIALIZED (
  SELECT *, row_number() OVER w AS rn, close - lag(close) OVER w AS move,
         greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
         high - lag(high) OVER w AS up, lag(low) OVER w - low AS down
  FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
rec_x AS MATERIALIZED (
  SELECT ticker, date, rn, close AS x, tr, volume * move AS f,
         CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pd,
         CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS nd,
         greatest(move, 0.0) + 0 * move AS g, greatest(-move, 0.0) + 0 * move AS l FROM rec_in),
rec AS (
  SELECT ticker, date, rn, x AS ema11, x AS ema12, x AS ema13, x AS ema21, x AS ema22, x AS ema26, x AS ema50,
         x AS ema200, tr AS atr, pd AS pdm, nd AS ndm, g AS gain, l AS loss, f AS force_short, f AS force_long,
         0.0 :: DOUBLE AS macd_signal, CAST(NULL AS DOUBLE) AS adx
  FROM rec_x WHERE rn = 1
  UNION ALL
  SELECT ticker, date, rn, ema11, ema12, ema13, ema21, ema22, ema26, ema50, ema200, atr, pdm, ndm, gain, loss,
         force_short, force_long, 0.2 * (ema12 - ema26) + 0.8 * macd_signal,
         CASE WHEN pdm + ndm > 0 AND atr > 0
              THEN CASE WHEN adx IS NULL THEN 100 * abs(pdm - ndm) / (pdm + ndm)
                        ELSE adx + (100 * abs(pdm - ndm) / (pdm + ndm) - adx) / 14 END ELSE adx END
  FROM (SELECT s.ticker, s.date, s.rn, r.macd_signal, r.adx,
          r.ema11 + (s.x - r.ema11) / 6 AS ema11, r.ema12 + (s.x - r.ema12) * 2 / 13 AS ema12,
          r.ema13 + (s.x - r.ema13) / 7 AS ema13, r.ema21 + (s.x - r.ema21) / 11 AS ema21,
          r.ema22 + (s.x - r.ema22) * 2 / 23 AS ema22, r.ema26 + (s.x - r.ema26) * 2 / 27 AS ema26,
          r.ema50 + (s.x - r.ema50) * 2 / 51 AS ema50, r.ema200 + (s.x - r.ema200) * 2 / 201 AS ema200,
          r.atr + (s.tr - r.atr) / 14 AS atr, r.pdm + (s.pd - r.pdm) / 14 AS pdm, r.ndm + (s.nd - r.ndm) / 14 AS ndm,
          CASE WHEN r.gain IS NULL THEN s.g ELSE r.gain + (s.g - r.gain) / 14 END AS gain,
          CASE WHEN r.loss IS NULL THEN s.l ELSE r.loss + (s.l - r.loss) / 14 END AS loss,
          CASE WHEN r.force_short IS NULL THEN s.f ELSE r.force_short + (s.f - r.force_short) * 2 / 3 END AS force_short,
          CASE WHEN r.force_long IS NULL THEN s.f ELSE r.force_long + (s.f - r.force_long) / 7 END AS force_long
        FROM rec r JOIN rec_x s ON s.ticker = r.ticker AND s.rn = r.rn + 1)),
ind AS MATERIALIZED (
  SELECT b.*, rn, ema11, ema12, ema13, ema21, ema22, ema26, ema50, ema200, atr, gain, loss, force_short, force_long,
         macd_signal, adx, ema12 - ema26 AS macd_line, ema12 - ema26 - macd_signal AS macd_hist,
         CASE WHEN atr > 0 THEN 100 * pdm / atr END AS plus_di, CASE WHEN atr > 0 THEN 100 * ndm / atr END AS minus_di,
         CASE WHEN loss = 0 AND gain > 0 THEN 100 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END AS rsi
  FROM bars b JOIN rec USING (ticker, date))"""


FRAGMENTS["positions"] = """positions AS MATERIALIZED (
  SELECT trade_id AS position_id, book, ticker, entry_date, exit_date AS as_of, entry_price, shares,
         entry_price * (1 - (5 + trade_id % 4) / 100.0 :: DOUBLE) AS stop_price, entry_price * (1 + (8 + trade_id % 5) / 100.0 :: DOUBLE) AS target_price,
         CASE WHEN trade_id % 3 <> 0 THEN entry_price * (1 - (5 + trade_id % 4) / 100.0 :: DOUBLE) END AS planned_stop
  FROM trades WHERE status = 'O')"""

FRAGMENTS["dividends"] = """dividends AS MATERIALIZED (
  SELECT ticker, min(date) AS ex_date, CAST(round(min_by(open, date) * 100) AS BIGINT) AS units
  FROM bars GROUP BY ticker, date_trunc('quarter', date))"""


FRAGMENTS["transactions"] = """transactions AS MATERIALIZED (
  SELECT trade_id * 2 AS tx_id, trade_id, book, status, ticker, shares, reason, 'BUY' AS side, entry_date AS trade_date, entry_price AS price,
         floor(entry_price * shares * 100 + 0.5000001) / 100 AS amount FROM trades
  UNION ALL
  SELECT trade_id * 2 + 1, trade_id, book, status, ticker, shares, reason, 'SELL', exit_date, exit_price, floor(exit_price * shares * 100 + 0.5000001) / 100 FROM trades)"""

FRAGMENTS["intents"] = """intents AS MATERIALIZED (
  SELECT trade_id AS intent_id, ticker, entry_date AS signal_date, CASE status WHEN 'F' THEN 'EXECUTED' WHEN 'O' THEN 'PENDING' ELSE 'SKIPPED' END AS intent_status,
         entry_price AS planned, CASE WHEN status = 'F' THEN entry_price END AS executed_price, entry_price * (1 - (5 + trade_id % 4) / 100.0 :: DOUBLE) AS stop_price,
         CASE WHEN trade_id % 7 <> 0 THEN (trade_id % 5) / 2.0 + 1 END AS rr, trade_id % 10 AS priority, exit_date AS processed_at FROM trades)"""

FRAGMENTS["earnings"] = "earnings AS MATERIALIZED (SELECT ticker, ex_date + 25 AS report_date FROM dividends)"

FRAGMENTS["subjects"] = """subjects AS MATERIALIZED (
  SELECT report_id, published, hour, tickers[1] AS symbol, lang AS exchange, theme AS company, len(tickers) AS listed FROM reports)"""

FRAGMENTS["symbol_map"] = """symbol_map AS MATERIALIZED (
  SELECT DISTINCT symbol, exchange, company, symbol || '.TO' AS market_symbol FROM subjects WHERE report_id % 4 <> 3)"""


def ewm(name: str, source: str, specs: dict[str, tuple[str, str]], key: str = "ticker") -> str:
    """Recursive CTE ``name(key, rn, ...)`` over ``source``: one average per ``out: (column, alpha)``."""
    first = ", ".join(f"CAST({c} AS DOUBLE) AS {o}" for o, (c, _) in specs.items())
    step = ", ".join(
        f"CASE WHEN r.{o} IS NULL THEN s.{c} WHEN s.{c} IS NULL THEN r.{o} ELSE r.{o} + (s.{c} - r.{o}) * {a} END"
        for o, (c, a) in specs.items())
    return (f"{name} AS (SELECT {key}, rn, {first} FROM {source} WHERE rn = 1 UNION ALL "
            f"SELECT s.{key}, s.rn, {step} FROM {name} r JOIN {source} s ON s.{key} = r.{key} AND s.rn = r.rn + 1)")


FRAGMENTS["weekly"] = """week_days AS (
  SELECT *, date + CAST((12 - isodow(date)) % 7 AS INTEGER) AS week FROM bars),
weekly AS MATERIALIZED (
  SELECT ticker, week AS date, min_by(open, date) AS open, max(high) AS high, min(low) AS low, max_by(close, date) AS close,
         sum(volume) AS volume, count(*) AS sessions, row_number() OVER (PARTITION BY ticker ORDER BY week) AS rn
  FROM week_days GROUP BY ticker, week
  QUALIFY count(*) >= 4 OR week < max(week) OVER (PARTITION BY ticker))"""

FRAGMENTS["weekly_ind"] = (
    ewm("weekly_ema", "weekly", {"ema12": ("close", "2.0/13"), "ema13": ("close", "2.0/14"), "ema26": ("close", "2.0/27")})
    + ", weekly_macd AS MATERIALIZED (SELECT *, ema12 - ema26 AS line FROM weekly_ema), "
    + ewm("weekly_signal", "weekly_macd", {"signal": ("line", "0.2")})
    + ", weekly_ind AS MATERIALIZED (SELECT w.*, ema13, ema26, line - signal AS macd_hist FROM weekly w "
      "JOIN weekly_macd USING (ticker, rn) JOIN weekly_signal USING (ticker, rn))")


def _bound(text: str, side: str) -> str:
    if text == "u":
        return f"UNBOUNDED {side}"
    n = int(text)
    return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"


def _frame(m: re.Match) -> str:
    keys = m.group(1) or "ticker"
    if m.group(2) is None:
        return f"OVER (PARTITION BY {keys} ORDER BY date)"
    lo, hi = m.group(2).split(",")
    return (f"OVER (PARTITION BY {keys} ORDER BY date "
            f"ROWS BETWEEN {_bound(lo, 'PRECEDING')} AND {_bound(hi, 'FOLLOWING')})")


def expand(sql: str) -> str:
    """Replace every ``@fragment`` and make the statement's WITH recursive.

    ``OVER[-19,0]`` is a row frame over one ticker's bars and ``OVER[]`` the plain
    ordered window; ``u`` is unbounded.
    """
    out = re.sub(r"@(\w+)", lambda m: FRAGMENTS[m.group(1)], sql)
    out = re.sub(r"OVER\[()(?:(-?\w+,-?\w+))?\]", _frame, out)
    return re.sub(r"^\s*WITH\s+(?!RECURSIVE)", "WITH RECURSIVE ", out, count=1)
