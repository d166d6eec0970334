"""Label, divergence, board and time-shaping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.operators import labels, runs, shaping, technicals
from tapeloom.plans import oracle
from tapeloom.plans.registry import query


def slope_sql(c: str, n: int) -> str:
    return (f"CASE WHEN count({c}) OVER[-{n - 1},0] < {n} THEN 'Flat' "
            f"WHEN regr_slope({c}, rn) OVER[-{n - 1},0] / (abs(avg({c}) OVER[-{n - 1},0]) + 1e-9) > 0.001 THEN 'Rising' "
            f"WHEN regr_slope({c}, rn) OVER[-{n - 1},0] / (abs(avg({c}) OVER[-{n - 1},0]) + 1e-9) < -0.001 THEN 'Falling' ELSE 'Flat' END")


oracle.FRAGMENTS["full_ind"] = """fi_a AS (
  SELECT *, CASE WHEN count(low) OVER[-4,0] >= 5 THEN (close - min(low) OVER[-4,0]) /
              nullif(max(high) OVER[-4,0] - min(low) OVER[-4,0], 0) * 100 END AS fast,
         sign(close - lag(close) OVER[]) * volume AS ov,
         CASE WHEN high > low THEN (close - open) / (high - low) * volume ELSE 0 END AS av FROM ind),
fi_b AS (SELECT *, CASE WHEN count(fast) OVER[-2,0] >= 3 THEN avg(fast) OVER[-2,0] END AS stoch_k,
         sum(ov) OVER[u,0] AS obv, sum(av) OVER[u,0] AS ad FROM fi_a),
full_ind AS MATERIALIZED (
  SELECT *, CASE WHEN count(stoch_k) OVER[-2,0] >= 3 THEN avg(stoch_k) OVER[-2,0] END AS stoch_d FROM fi_b)"""

oracle.FRAGMENTS["labelled"] = f"""lab_a AS (
  SELECT *, {slope_sql('ema22', 10)} AS ma_slope, {slope_sql('close', 5)} AS price_slope,
    {slope_sql('macd_hist', 5)} AS macd_hist_slope, {slope_sql('adx', 10)} AS adx_trend, {slope_sql('obv', 10)} AS obv_trend,
    {slope_sql('ad', 10)} AS ad_trend, {slope_sql('ema11', 2)} AS fs, {slope_sql('macd_hist', 2)} AS hs,
    CASE WHEN macd_hist >= max(macd_hist) OVER[-62,0] THEN 'New High'
         WHEN macd_hist <= min(macd_hist) OVER[-62,0] THEN 'New Low' ELSE 'No' END AS macd_hist_extreme,
    CASE WHEN count(*) OVER[-10,-1] < 10 THEN 'Normal'
         WHEN (volume - avg(volume) OVER[-10,-1]) / avg(volume) OVER[-10,-1] * 100 >= 25 THEN 'High'
         WHEN (volume - avg(volume) OVER[-10,-1]) / avg(volume) OVER[-10,-1] * 100 <= -25 THEN 'Low' ELSE 'Normal' END AS volume_vs_avg,
    coalesce(adx < least(plus_di, minus_di), false) AS below
  FROM full_ind),
lab_b AS (SELECT *, max(CASE WHEN NOT below THEN rn ELSE 0 END) OVER[u,0] AS last_break FROM lab_a),
labelled AS MATERIALIZED (
  SELECT *,
    CASE WHEN close > ema22 THEN 'Above' WHEN close < ema22 THEN 'Below' ELSE 'At' END AS price_vs_ma,
    CASE WHEN close > greatest(ema11, ema22) THEN 'Above' WHEN close < least(ema11, ema22) THEN 'Below' ELSE 'In Zone' END AS value_zone,
    CASE WHEN macd_line > macd_signal THEN 'Bull' WHEN macd_line < macd_signal THEN 'Bear' ELSE 'Neutral' END AS macd_cross,
    CASE WHEN 'Flat' IN (price_slope, macd_hist_slope) THEN 'Unclear' WHEN price_slope = macd_hist_slope THEN 'Safe' ELSE 'Weak' END AS trend_health,
    CASE WHEN plus_di > minus_di THEN 'Bull' WHEN plus_di < minus_di THEN 'Bear' ELSE 'Neutral' END AS di_bias,
    CASE WHEN adx IS NULL OR plus_di IS NULL OR minus_di IS NULL THEN 'Unknown'
         WHEN below THEN CASE WHEN adx - min(adx) OVER (PARTITION BY ticker, last_break, below ORDER BY date) >= 4 THEN 'Waking Up' ELSE 'Choppy' END
         WHEN adx > greatest(plus_di, minus_di) THEN 'Overheated' ELSE 'Trending' END AS adx_regime,
    CASE WHEN force_short < 0 THEN 'Negative' WHEN force_short > 0 THEN 'Positive' ELSE 'Zero' END AS force_short_zone,
    CASE WHEN force_long > 0 THEN 'Bull' WHEN force_long < 0 THEN 'Bear' ELSE 'Neutral' END AS force_long_bias,
    CASE WHEN fs = 'Rising' AND hs = 'Rising' THEN 'Green' WHEN fs = 'Falling' AND hs = 'Falling' THEN 'Red' ELSE 'Blue' END AS impulse_daily,
    CASE ma_slope WHEN 'Rising' THEN 'Up' WHEN 'Falling' THEN 'Down' ELSE 'Flat' END AS daily_trend
  FROM lab_b)"""

oracle.FRAGMENTS["weekly_lab"] = f"""weekly_lab AS MATERIALIZED (
  SELECT ticker, date, CASE {slope_sql('ema26', 10)} WHEN 'Rising' THEN 'Up' WHEN 'Falling' THEN 'Down' ELSE 'Flat' END AS weekly_trend,
    CASE WHEN {slope_sql('ema13', 2)} = 'Rising' AND {slope_sql('macd_hist', 2)} = 'Rising' THEN 'Green'
         WHEN {slope_sql('ema13', 2)} = 'Falling' AND {slope_sql('macd_hist', 2)} = 'Falling' THEN 'Red' ELSE 'Blue' END AS impulse_weekly
  FROM weekly_ind)"""


def divergence_sql(c: str, cross: bool) -> str:
    """Scalar subqueries over the pivots of one ticker ``t.ticker``."""
    more_low = f" AND EXISTS (SELECT 1 FROM full_ind z WHERE z.ticker = l.ticker AND z.rn > l.p1 AND z.rn < l.p2 AND z.{c} > 0)" if cross else ""
    more_high = f" AND EXISTS (SELECT 1 FROM full_ind z WHERE z.ticker = h.ticker AND z.rn > h.p1 AND z.rn < h.p2 AND z.{c} < 0)" if cross else ""
    return (f"CASE WHEN EXISTS (SELECT 1 FROM last_lows l JOIN full_ind a ON a.ticker = l.ticker AND a.rn = l.p1 JOIN full_ind b "
            f"ON b.ticker = l.ticker AND b.rn = l.p2 WHERE l.ticker = t.ticker AND l.p2 - l.p1 BETWEEN 20 AND 40 AND b.close < a.close "
            f"AND b.{c} > a.{c}{more_low}) THEN 'Bullish' "
            f"WHEN EXISTS (SELECT 1 FROM last_highs h JOIN full_ind a ON a.ticker = h.ticker AND a.rn = h.p1 JOIN full_ind b "
            f"ON b.ticker = h.ticker AND b.rn = h.p2 WHERE h.ticker = t.ticker AND h.p2 - h.p1 BETWEEN 20 AND 40 AND b.close > a.close "
            f"AND b.{c} < a.{c}{more_high}) THEN 'Bearish' ELSE 'None' END AS {c}_divergence")


oracle.FRAGMENTS["diverged"] = ("""piv AS MATERIALIZED (
  SELECT ticker, rn, close < min(close) OVER[-3,-1] AND close < min(close) OVER[1,3] AND count(*) OVER[-3,3] = 7 AS lo,
         close > max(close) OVER[-3,-1] AND close > max(close) OVER[1,3] AND count(*) OVER[-3,3] = 7 AS hi FROM full_ind),
last_lows AS MATERIALIZED (SELECT ticker, max(rn) AS p2, list_sort(list(rn))[-2] AS p1 FROM piv WHERE lo GROUP BY ticker HAVING count(*) >= 2),
last_highs AS MATERIALIZED (SELECT ticker, max(rn) AS p2, list_sort(list(rn))[-2] AS p1 FROM piv WHERE hi GROUP BY ticker HAVING count(*) >= 2),
diverged AS MATERIALIZED (SELECT t.ticker, """ + ", ".join(divergence_sql(c, x) for c, x in labels.BOARD_DIVERGENCES.items())
                                + " FROM (SELECT DISTINCT ticker FROM bars) t)")

LABELLED = "WITH @bars, @rec, @full_ind, @labelled SELECT * FROM labelled"


def labelled(t):
    return labels.trend_labels(labels.daily_set(t.bars))


query("p1_slope_label", "ticker date:d ma_slope macd_hist_slope adx_trend obv_trend ad_trend", LABELLED)(labelled)
query("p2_price_zone", "ticker date:d price_vs_ma value_zone", LABELLED)(labelled)
query("p3_macd_labels", "ticker date:d macd_cross trend_health macd_hist_extreme", LABELLED)(labelled)
query("p4_adx_regime", "ticker date:d di_bias adx_regime", LABELLED)(labelled)
query("p5_oscillator_zone", "ticker date:d rsi_zone stoch_zone",
      """WITH @bars, @rec, @full_ind SELECT *,
      CASE WHEN round(rsi, 9) >= round(quantile_cont(rsi, 0.95) OVER[-119,0], 9) THEN 'Overbought'
        WHEN round(rsi, 9) <= round(quantile_cont(rsi, 0.05) OVER[-119,0], 9) THEN 'Oversold' ELSE 'Neutral' END AS rsi_zone,
      CASE WHEN round(stoch_k, 9) >= round(quantile_cont(stoch_k, 0.95) OVER[-119,0], 9) THEN 'Overbought'
        WHEN round(stoch_k, 9) <= round(quantile_cont(stoch_k, 0.05) OVER[-119,0], 9) THEN 'Oversold' ELSE 'Neutral' END AS stoch_zone FROM full_ind""")(
    lambda t: labels.daily_set(t.bars).select(
        "ticker", "date", labels.zone("rsi").alias("rsi_zone"), labels.zone("stoch_k").alias("stoch_zone")))
query("p6_volume_and_force", "ticker date:d volume_vs_avg force_short_zone force_long_bias", LABELLED)(labelled)
query("p7_impulse", "ticker date:d impulse_daily", LABELLED)(labelled)
query("p8_triple_screen_alignment", "ticker date:d weekly_trend impulse_weekly daily_trend triple_screen",
      """WITH @bars, @rec, @full_ind, @labelled, @weekly, @weekly_ind, @weekly_lab
      SELECT w.*, l.daily_trend, CASE WHEN weekly_trend = 'Up' AND daily_trend = 'Down' THEN 'Go long setup'
        WHEN weekly_trend = 'Down' AND daily_trend = 'Up' THEN 'Go short setup' ELSE 'Stand aside' END AS triple_screen
      FROM weekly_lab w ASOF JOIN labelled l ON w.ticker = l.ticker AND w.date >= l.date""")(
    lambda t: labels.weekly_with_daily(t.bars))
query("p9_divergence", "ticker macd_hist_divergence rsi_divergence stoch_k_divergence obv_divergence ad_divergence "
      "force_short_divergence force_long_divergence", "WITH @bars, @rec, @full_ind, @diverged SELECT * FROM diverged")(
    lambda t: labels.last_bars(labels.with_divergences(labels.daily_set(t.bars), labels.BOARD_DIVERGENCES), 1))

BOARD_OUT = (
    "ticker run_date:d price:f pct_chg:f ma22:f4 ma50:f4 ma200:f4 ma_slope price_vs_ma value_zone macd_line:f4 macd_signal:f4 "
    "macd_hist:f4 macd_cross macd_hist_slope trend_health macd_hist_extreme macd_hist_divergence plus_di:f4 minus_di:f4 adx:f4 "
    "di_bias adx_trend adx_regime atr:f4 atr_pct:f4 rsi:f4 rsi_zone rsi_divergence stoch_k:f4 stoch_d:f4 stoch_zone "
    "stoch_k_divergence volume:f volume_vs_avg obv:f obv_trend obv_divergence ad:f4 ad_trend ad_divergence force_short:f4 "
    "force_short_zone force_short_divergence force_long:f4 force_long_bias force_long_divergence impulse_daily impulse_weekly "
    "weekly_trend daily_trend triple_screen")
query("p10_board", BOARD_OUT,
      """WITH @bars, @rec, @full_ind, @labelled, @weekly, @weekly_ind, @weekly_lab, @diverged,
      z AS (SELECT *, (close / lag(close) OVER[] - 1) * 100 AS pct_chg, quantile_cont(rsi, 0.95) OVER[-119,0] AS r95,
        quantile_cont(rsi, 0.05) OVER[-119,0] AS r05, quantile_cont(stoch_k, 0.95) OVER[-119,0] AS s95,
        quantile_cont(stoch_k, 0.05) OVER[-119,0] AS s05 FROM labelled),
      l AS (SELECT *, date AS run_date, close AS price, ema22 AS ma22, ema50 AS ma50, ema200 AS ma200, atr / close * 100 AS atr_pct,
        CASE WHEN round(rsi, 9) >= round(r95, 9) THEN 'Overbought' WHEN round(rsi, 9) <= round(r05, 9) THEN 'Oversold' ELSE 'Neutral' END AS rsi_zone,
        CASE WHEN round(stoch_k, 9) >= round(s95, 9) THEN 'Overbought' WHEN round(stoch_k, 9) <= round(s05, 9) THEN 'Oversold' ELSE 'Neutral' END AS stoch_zone
        FROM z QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
      w AS (SELECT * FROM weekly_lab QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1)
      SELECT l.*, d.* EXCLUDE (ticker), coalesce(w.weekly_trend, 'Flat') AS weekly_trend, coalesce(impulse_weekly, 'Blue') AS impulse_weekly,
        CASE WHEN weekly_trend = 'Up' AND daily_trend = 'Down' THEN 'Go long setup'
        WHEN weekly_trend = 'Down' AND daily_trend = 'Up' THEN 'Go short setup' ELSE 'Stand aside' END AS triple_screen
      FROM l JOIN diverged d USING (ticker) LEFT JOIN w USING (ticker)""")(lambda t: labels.board(t.bars))

# --- time shaping -----------------------------------------------------------------------------------------------

query("t1_weekly_bars", "ticker date:d open:f high:f low:f close:f volume:f sessions:i", "WITH @bars, @weekly SELECT * FROM weekly")(
    lambda t: shaping.weekly_bars(t.bars))
query("m4_weekly_ema", "ticker date:d ema13:f4 ema26:f4 macd_hist:f4", "WITH @bars, @weekly, @weekly_ind SELECT * FROM weekly_ind")(
    lambda t: labels.weekly_indicators(t.bars))
query("t2_calendar_alignment", "ticker date:d open:f high:f low:f close:f volume:f traded:b",
      """WITH @bars, @bench, s AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM bench),
      g AS (SELECT ticker, s.date, session FROM (SELECT DISTINCT ticker FROM bars) CROSS JOIN s),
      j AS (SELECT g.*, b.open, b.high, b.low, b.close, b.volume,
              last_value(CASE WHEN b.close IS NOT NULL THEN session END IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY session) AS own,
              last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY session) AS held
            FROM g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date)
      SELECT ticker, date, coalesce(open, CASE WHEN session - own <= 5 THEN held END) AS open,
             coalesce(high, CASE WHEN session - own <= 5 THEN held END) AS high, coalesce(low, CASE WHEN session - own <= 5 THEN held END) AS low,
             CASE WHEN session - own <= 5 THEN held END AS close, coalesce(volume, CASE WHEN session - own <= 5 THEN 0 END) AS volume,
             close IS NOT NULL AS traded FROM j""")(lambda t: shaping.align_to_calendar(t.bars, t.bench))
query("t3_duplicate_dates", "o_custkey:i date:d o_orderkey:i o_totalprice:f2",
      """SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, max(o_orderkey) AS o_orderkey, max_by(o_totalprice, o_orderkey) AS o_totalprice
      FROM orders GROUP BY o_custkey, o_orderdate""")(
    lambda t: shaping.drop_duplicates_keep_last(
        t.orders.select("o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice"), ["o_custkey", "date"], "o_orderkey"))
query("t4_month_ends", "month:d date:d", "WITH @bars SELECT date_trunc('month', date) :: DATE AS month, max(date) AS date FROM bars GROUP BY 1")(
    lambda t: shaping.month_ends(t.bars))
BRANDS = [f"Brand#{k}" for k in range(1, 26)]
WIDE = [f"b{k}" for k in range(1, 26)]
query("t5_wide_close", "date:d " + " ".join(f"{c}:f" for c in WIDE),
      "WITH @bars SELECT date, " + ", ".join(f"max(CASE WHEN ticker = '{b}' THEN close END) AS {c}" for b, c in zip(BRANDS, WIDE)) + " FROM bars GROUP BY date")(
    lambda t: shaping.wide_close(t.bars, BRANDS).toDF("date", *WIDE))
HOLIDAYS = shaping.exchange_holidays(range(1990, 2005))
query("t6_trading_calendar", "day:d is_session:b previous:d on_or_before:d next:d",
      f"""WITH @bars, d AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS day FROM bars),
      s AS (SELECT day, isodow(day) < 6 AND CAST(day AS VARCHAR) NOT IN ({', '.join(repr(h) for h in HOLIDAYS)}) AS is_session FROM d)
      SELECT day, is_session, (SELECT max(x.day) FROM s x WHERE x.is_session AND x.day < s.day) AS previous,
             (SELECT max(x.day) FROM s x WHERE x.is_session AND x.day <= s.day) AS on_or_before,
             (SELECT min(x.day) FROM s x WHERE x.is_session AND x.day > s.day) AS next FROM s""")(
    lambda t: shaping.session_neighbours(shaping.calendar_days(t.bars), HOLIDAYS))
CHECKPOINTS = [9, 10, 11, 12, 13, 14, 15]
query("t7_intraday_checkpoints", "ticker day:d checkpoint:i cum_volume:f price:f",
      """WITH @hourly, @day_bars, h AS (SELECT unnest([9, 10, 11, 12, 13, 14, 15]) AS checkpoint),
      x AS (SELECT ticker, day, checkpoint, sum(volume) AS cum_volume, max_by(close, hour) AS p FROM hourly JOIN h ON hour <= checkpoint
            GROUP BY ALL),
      e AS (SELECT ticker, day, max_by(close, hour) AS last_hourly FROM hourly GROUP BY ALL)
      SELECT x.*, p * d.close / last_hourly AS price FROM x JOIN e USING (ticker, day) JOIN day_bars d ON d.ticker = x.ticker AND d.date = x.day""")(
    lambda t: shaping.intraday_checkpoints(t.hourly, t.day_bars, CHECKPOINTS))
query("t8_equal_folds", "ticker date:d fold:i",
      """WITH @bars, b AS (SELECT min(date) AS a, max(date) AS z FROM bars)
      SELECT ticker, date, least(floor((date - a) * 16 / (z - a) :: DOUBLE), 15) AS fold FROM bars, b""")(
    lambda t: shaping.equal_folds(t.bars, 16))
query("t9_sliding_windows", "number:i is_start:d is_end:d oos_end:d rows:i",
      """WITH @bars, s AS (SELECT CAST(date_trunc('month', min(date)) AS DATE) AS a, max(date) AS b FROM bars),
      n AS (SELECT unnest(range(200)) AS number),
      w AS (SELECT number, CAST(a + INTERVAL 3 MONTH * number AS DATE) AS is_start, CAST(a + INTERVAL 3 MONTH * number + INTERVAL 12 MONTH AS DATE) AS is_end,
        CAST(a + INTERVAL 3 MONTH * number + INTERVAL 15 MONTH AS DATE) AS oos_end, b FROM s, n)
      SELECT number, is_start, is_end, oos_end, count(bars.date) AS rows FROM w JOIN bars ON date >= is_end AND date < oos_end
      WHERE oos_end <= b GROUP BY ALL""")(lambda t: shaping.window_rows(t.bars, shaping.sliding_windows(t.bars, 12, 3, 3)))
query("t10_walk_forward_splits", "test_year:i part rows:i first:d last:d",
      """WITH @bars, s AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM bars)),
      f AS (SELECT year(date) AS y, min(pos) AS p FROM s WHERE year(date) IN (1998, 1999, 2000) GROUP BY 1),
      c AS (SELECT y, s.date AS cut FROM f JOIN s ON s.pos = f.p - 21)
      SELECT y AS test_year, 'train' AS part, count(*) AS rows, min(date) AS first, max(date) AS last FROM bars JOIN c ON date <= cut GROUP BY 1
      UNION ALL SELECT y, 'test', count(*), min(date), max(date) FROM bars JOIN c ON year(date) = y GROUP BY 1""")(
    lambda t: shaping.walk_forward_splits(t.bars, [1998, 1999, 2000], 20).groupBy("test_year", "part").agg(
        F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")))
query("t11_year_folds", "ticker year:i sessions:i start:d end:d",
      """WITH @bars SELECT ticker, year(date) AS year, count(*) AS sessions, min(date) AS start, max(date) AS "end" FROM bars GROUP BY 1, 2
      HAVING count(*) >= 120 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY year(date) DESC) <= 3""")(
    lambda t: shaping.year_folds(t.bars, 120, 3))
query("t12_newest_first", "run_date:d rows:i place:i",
      """WITH @bars SELECT strftime(date, '%Y%m') || '-01' AS m, strptime(strftime(date, '%Y%m') || '01', '%Y%m%d') :: DATE AS run_date, count(*) AS rows,
      row_number() OVER (ORDER BY strftime(date, '%Y%m') DESC) AS place FROM bars GROUP BY strftime(date, '%Y%m')""")(
    lambda t: shaping.newest_blocks(t.bars))
