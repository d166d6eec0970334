"""Screener, universe and row-filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators import labels, screener
from tapeloom.plans import oracle
from tapeloom.plans.labels import slope_sql
from tapeloom.plans.registry import query

LAST = "QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1"


def norm(c: str, n: int, signed: bool = False) -> str:
    level = f"avg({c}) OVER[-{n - 1},0]"
    level = level if signed else f"abs({level})"
    return f"CASE WHEN count({c}) OVER[-{n - 1},0] >= {n} THEN regr_slope({c}, rn) OVER[-{n - 1},0] / ({level} + 1e-9) END"


FR = oracle.FRAGMENTS
FR["stage2"] = f"""s2a AS (SELECT *, CASE WHEN rn >= 30 THEN avg(close) OVER[-29,0] END AS m30, avg(close) OVER[-9,0] AS m10 FROM weekly),
s2b AS (SELECT *, {norm('m30', 10)} AS sl, (close - m30) / m30 * 100 AS a FROM s2a),
stage2 AS MATERIALIZED (SELECT ticker, CASE WHEN rn >= 40 AND sl > 0.001 AND close > m30 AND m10 > m30 THEN
   least(100, CASE WHEN a <= 5 THEN 30 WHEN a <= 15 THEN 50 + (a - 5) * 3 WHEN a <= 25 THEN 80 + (a - 15) * 2
     ELSE greatest(0, 100 - (a - 25) * 4) END + CASE WHEN close > m10 THEN 5 ELSE 0 END) ELSE 0 END AS stage2_score FROM s2b {LAST})"""
FR["urs"] = f"""urs AS MATERIALIZED (SELECT ticker, rs FROM (SELECT b.ticker, b.date, count(*) OVER (PARTITION BY b.ticker) AS n,
   (b.close / lag(b.close, 59) OVER o - m.close / lag(m.close, 59) OVER o) * 100 AS rs FROM bars b JOIN bench m USING (date)
   WINDOW o AS (PARTITION BY b.ticker ORDER BY b.date)) WHERE n >= 120 {LAST})"""
FR["wrs"] = """ends AS (SELECT ticker, max(date) AS e, count(*) AS n, max_by(close, date) AS c FROM bars GROUP BY ticker),
tgt AS (SELECT e.*, p, w, CASE isodow(e) WHEN 6 THEN e + 2 WHEN 7 THEN e + 1 ELSE e END - CAST(p / 5 * 7 AS INTEGER) AS d
   FROM ends e, (VALUES (20, 0.5), (60, 0.3), (120, 0.2)) v(p, w) WHERE n >= p),
near AS (SELECT t.*, b.date AS nd, b.close AS nc FROM tgt t JOIN bars b USING (ticker)
   QUALIFY row_number() OVER (PARTITION BY t.ticker, p ORDER BY abs(b.date - d), b.date DESC) = 1),
wrs AS MATERIALIZED (SELECT ticker, sum(w * (c / nc - x.close / y.close) * 100) / sum(w) AS avg_rs
   FROM near JOIN bench x ON x.date = e JOIN bench y ON y.date = nd GROUP BY ticker)"""
FR["rs_sc"] = """rs_sc AS MATERIALIZED (SELECT w.ticker, avg_rs, (SELECT CASE WHEN count(*) > 10 THEN (count_if(rs < avg_rs) + count_if(rs <= avg_rs)
   + CASE WHEN count_if(rs = avg_rs) > 0 THEN 1 ELSE 0 END) * 50.0 / count(*) ELSE least(100, greatest(0, 50 + avg_rs * 2.5)) END FROM urs) AS rs_score FROM wrs w)"""
FR["macd_sc"] = f"""mca AS (SELECT *, coalesce({norm('macd_hist', 5)}, 0) AS sl, coalesce(lag(macd_hist) OVER[], 0) AS ph,
   CASE WHEN macd_hist > 0 AND lag(macd_hist) OVER[] < 0 THEN 1 ELSE 0 END AS x FROM ind),
macd_sc AS MATERIALIZED (SELECT ticker, least(100, greatest(0, 50 + CASE WHEN macd_line > macd_signal THEN 20 ELSE -20 END
   + CASE WHEN sl > 0.001 THEN 15 WHEN sl < -0.001 THEN -15 ELSE 0 END + CASE WHEN macd_hist > 0 THEN 10 ELSE -10 END
   + CASE WHEN macd_hist > ph THEN 5 ELSE -5 END + 10 * max(x) OVER[-9,0])) AS macd_score FROM mca {LAST})"""
FR["obv_sc"] = f"""oba AS (SELECT *, row_number() OVER[] AS rn, sign(close - lag(close) OVER[]) * volume AS ov FROM bars),
obb AS (SELECT *, sum(ov) OVER[u,0] AS obv FROM oba),
obc AS (SELECT *, {norm('obv', 20)} AS s20, {norm('obv', 60)} AS s60, {norm('close', 60)} AS p60,
  min(close) OVER[-59,0] AS cl6, min(close) OVER[-19,0] AS cl2, min(obv) OVER[-59,0] AS ol6, min(obv) OVER[-19,0] AS ol2,
  max(close) OVER[-59,0] AS ch6, max(close) OVER[-19,0] AS ch2, max(obv) OVER[-59,0] AS oh6, max(obv) OVER[-19,0] AS oh2 FROM obb),
obv_sc AS MATERIALIZED (SELECT ticker, CASE WHEN rn < 60 THEN 50 ELSE least(100, greatest(0, 50
  + CASE WHEN s60 > 0.001 THEN 20 WHEN s60 < -0.001 THEN -20 ELSE 0 END + CASE WHEN s20 > s60 THEN 15 WHEN s20 < s60 THEN -15 ELSE 0 END
  + CASE WHEN cl2 < cl6 AND ol2 > ol6 THEN 20 ELSE 0 END - CASE WHEN ch2 > ch6 AND oh2 < oh6 THEN 20 ELSE 0 END
  + CASE WHEN p60 > 0 AND s60 > 0 THEN 10 ELSE 0 END)) END AS obv_score FROM obc {LAST})"""
FR["adx_sc"] = f"""ada AS (SELECT *, coalesce({norm('adx', 10)}, 0) AS sl, CASE WHEN adx >= 40 THEN 100 WHEN adx >= 25 THEN 60 + (adx - 25) * 2.67
  WHEN adx >= 20 THEN 40 + (adx - 20) * 4 ELSE adx * 2 END AS base FROM ind),
adx_sc AS MATERIALIZED (SELECT ticker, coalesce(CASE WHEN sl > 0.1 THEN least(100, base + 15) WHEN sl < -0.1 THEN greatest(0, base - 15) ELSE base END, 0)
  AS adx_score FROM ada {LAST})"""
FR["vam_sc"] = f"""vma AS (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars),
vmb AS (SELECT ticker, date, count(r) OVER[u,0] AS n, unnest([20, 60, 120]) AS p, unnest([0.5, 0.3, 0.2]) AS w,
  unnest([close / lag(close, 20) OVER[], close / lag(close, 60) OVER[], close / lag(close, 120) OVER[]]) AS t,
  unnest([stddev_samp(r) OVER[-19,0], stddev_samp(r) OVER[-59,0], stddev_samp(r) OVER[-119,0]]) * sqrt(252) AS v FROM vma),
vmc AS (SELECT * FROM vmb QUALIFY date = max(date) OVER (PARTITION BY ticker)),
vam_sc AS MATERIALIZED (SELECT ticker, CASE WHEN max(n) < 60 OR count_if(n >= p AND t > 0 AND v >= 0.001) = 0 THEN 50 ELSE
  sum(least(100, greatest(0, 50 + (t ** (252.0 / p) - 1) / v * 25)) * w) FILTER (n >= p AND t > 0 AND v >= 0.001)
  / sum(w) FILTER (n >= p AND t > 0 AND v >= 0.001) END AS vam_score FROM vmc GROUP BY ticker)"""
FR["brk_sc"] = f"""bra AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back, row_number() OVER[] AS rn FROM bars),
brb AS (SELECT ticker, max(rn) AS n, max(high) FILTER (back <= 252) AS top, max(close) FILTER (back = 1) AS c, avg(volume) FILTER (back <= 50) AS v50,
  avg(volume) FILTER (back <= 10) AS v10, avg(volume) FILTER (back <= 5) AS v5 FROM bra GROUP BY ticker),
brc AS (SELECT b.*, (top - c) / top * 100 AS off, (SELECT count(*) FROM bra a WHERE a.ticker = b.ticker AND back <= 20 AND high > top * 0.95) AS nh FROM brb b),
brd AS (SELECT *, CASE WHEN off <= 2 THEN 90 WHEN off <= 5 THEN 75 WHEN off <= 10 THEN 60 WHEN off <= 20 THEN 40 ELSE greatest(0, 40 - (off - 20) * 1.5) END AS s0 FROM brc),
brk_sc AS MATERIALIZED (SELECT ticker, CASE WHEN n < 252 THEN 50 ELSE least(100, least(100, least(100, s0 + CASE WHEN v10 / (v50 + 1e-9) > 1.5 THEN 10 ELSE 0 END)
  + CASE WHEN v5 / (v50 + 1e-9) > 2 THEN 15 ELSE 0 END) + CASE WHEN nh >= 3 THEN 10 ELSE 0 END) END AS breakout_score FROM brd)"""
FR["screened"] = f"""scr_a AS (SELECT *, avg(volume) OVER[-19,0] AS avg_volume, close / lag(close, 20) OVER[] - 1 AS r1, close / lag(close, 62) OVER[] - 1 AS r3,
  CASE WHEN rn >= 50 THEN avg(close) OVER[-49,0] END AS ma50, CASE WHEN rn >= 200 THEN avg(close) OVER[-199,0] END AS ma200 FROM ind),
scr_b AS (SELECT * FROM scr_a {LAST}),
screened AS MATERIALIZED (SELECT s.ticker, s.date, close AS price, stage2_score, rs_score, macd_score, obv_score, adx_score, vam_score, breakout_score,
  0.2 * stage2_score + 0.2 * rs_score + 0.15 * macd_score + 0.15 * obv_score + 0.1 * adx_score + 0.1 * vam_score + 0.1 * breakout_score AS composite_score,
  rsi, avg_volume, CASE WHEN rn > 21 THEN r1 * 100 ELSE 0 END AS ret_1m, CASE WHEN rn > 63 THEN r3 * 100 ELSE 0 END AS ret_3m,
  coalesce(ma50 > ma200, false) AS ma50_gt_ma200,
  CASE WHEN stage2_score > 70 AND close > ma50 AND ma50 > ma200 THEN '▲ Strong Stage II' WHEN stage2_score > 50 THEN '▶ Stage II'
    WHEN stage2_score > 30 THEN '→ Early Stage II' WHEN close > ma200 THEN '▼ Above 200MA' ELSE '▼ Weak' END AS trend_tag
  FROM scr_b s JOIN stage2 USING (ticker) JOIN rs_sc USING (ticker) JOIN macd_sc USING (ticker) JOIN obv_sc USING (ticker) JOIN adx_sc USING (ticker)
  JOIN vam_sc USING (ticker) JOIN brk_sc USING (ticker) WHERE avg_volume >= 20 AND close >= 2)"""

query("p11_stage2_score", "ticker stage2_score:f", "WITH @bars, @weekly, @stage2 SELECT * FROM stage2")(lambda t: screener.stage2(t.bars))
query("p12_rs_score", "ticker avg_rs:f rs_score:f", "WITH @bars, @bench, @urs, @wrs, @rs_sc SELECT * FROM rs_sc")(
    lambda t: screener.rs_score(t.bars, t.bench))
query("p13_universe_rs", "ticker rs:f", "WITH @bars, @bench, @urs SELECT * FROM urs")(lambda t: screener.universe_rs(t.bars, t.bench))
query("p14_macd_score", "ticker macd_score:f", "WITH @bars, @rec, @macd_sc SELECT * FROM macd_sc")(lambda t: screener.macd_score(t.bars))
query("p15_obv_score", "ticker obv_score:f", "WITH @bars, @obv_sc SELECT * FROM obv_sc")(lambda t: screener.obv_score(t.bars))
query("p16_adx_score", "ticker adx_score:f4", "WITH @bars, @rec, @adx_sc SELECT * FROM adx_sc")(lambda t: screener.adx_score(t.bars))
query("p17_vam_score", "ticker vam_score:f", "WITH @bars, @vam_sc SELECT * FROM vam_sc")(lambda t: screener.vam_score(t.bars))
query("p18_breakout_score", "ticker breakout_score:f", "WITH @bars, @brk_sc SELECT * FROM brk_sc")(lambda t: screener.breakout_score(t.bars))
SCREEN = ("@bars, @bench, @rec, @weekly, @stage2, @urs, @wrs, @rs_sc, @macd_sc, @obv_sc, @adx_sc, @vam_sc, @brk_sc, @screened")
SCREEN_OUT = ("ticker date:d price:f composite_score:f4 stage2_score:f rs_score:f macd_score:f obv_score:f adx_score:f4 vam_score:f "
              "breakout_score:f rsi:f4 avg_volume:f ret_1m:f ret_3m:f ma50_gt_ma200:b trend_tag")
screened = lambda t: screener.screen(t.bars, t.bench, 20, 2.0)
query("p19_composite_screen", SCREEN_OUT, f"WITH {SCREEN} SELECT * FROM screened")(screened)
query("f4_score_gate", "passed:i dropped:i", f"WITH {SCREEN} SELECT count_if(composite_score >= 50) AS passed, count_if(composite_score < 50) AS dropped FROM screened")(
    lambda t: screened(t).agg(F.count_if(F.col("composite_score") >= 50).alias("passed"), F.count_if(F.col("composite_score") < 50).alias("dropped")))
query("k1_top_screened", "ticker composite_score:f4",
      f"WITH {SCREEN} SELECT * FROM screened ORDER BY round(composite_score, 6) DESC, ticker LIMIT 10")(
    lambda t: screened(t).orderBy(F.round("composite_score", 6).desc(), "ticker").limit(10))
query("f1_liquidity_gate", "ticker date:d close:f avg_volume:f",
      "WITH @bars, x AS (SELECT *, avg(volume) OVER[-19,0] AS avg_volume FROM bars) SELECT * FROM x WHERE avg_volume >= 40 AND close >= 30")(
    lambda t: t.bars.withColumn("avg_volume", F.avg("volume").over(Window.partitionBy("ticker").orderBy("date").rowsBetween(-19, 0)))
    .where("avg_volume >= 40 and close >= 30"))
query("a8_risk_metrics", "ticker max_dd:f sharpe:f win_rate:f profit_factor:f skew:f kurtosis:f var_95:f calmar:f",
      """WITH @bars, x AS (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars),
      y AS (SELECT *, max(CASE WHEN r IS NOT NULL THEN close END) OVER[u,0] AS peak FROM x),
      g AS (SELECT ticker, count(r) AS n, min((close - peak) / peak) AS dd, avg(r) AS m, stddev_samp(r) AS sd, avg(CASE WHEN r > 0 THEN 1.0 WHEN r <= 0 THEN 0 END) AS win_rate,
        avg(r) FILTER (r > 0) AS win, abs(avg(r) FILTER (r < 0)) AS loss, skewness(r) AS skew, kurtosis(r) AS kurtosis, quantile_cont(r, 0.05) AS v,
        max_by(close, date) / min_by(close, date) - 1 AS tot FROM y GROUP BY ticker)
      SELECT ticker, dd * 100 AS max_dd, m / sd * sqrt(252) AS sharpe, win_rate * 100 AS win_rate, win / loss AS profit_factor, skew, kurtosis,
        v * 100 AS var_95, abs(tot / dd) AS calmar FROM g WHERE n >= 60""")(lambda t: screener.risk_metrics(t.bars))

FR["swing"] = f"""swa AS (SELECT b.ticker, b.date, b.close, b.volume, b.high, b.low, m.close AS mc, row_number() OVER w AS rn,
  greatest(b.high - b.low, abs(b.high - lag(b.close) OVER w), abs(b.low - lag(b.close) OVER w)) AS tr, b.close / lag(b.close) OVER w - 1 AS r
  FROM bars b JOIN bench m USING (date) WINDOW w AS (PARTITION BY b.ticker ORDER BY b.date)),
swb AS (SELECT *, CASE WHEN rn >= 50 THEN avg(close) OVER[-49,0] END AS sma50, CASE WHEN rn >= 200 THEN avg(close) OVER[-199,0] END AS sma200,
  CASE WHEN rn >= 20 THEN avg(volume) OVER[-19,0] END AS v20, CASE WHEN rn >= 50 THEN avg(volume) OVER[-49,0] END AS v50,
  CASE WHEN rn >= 20 THEN avg(close * volume) OVER[-19,0] END AS adv, CASE WHEN rn >= 14 THEN avg(tr) OVER[-13,0] END / close AS atr_pct_14,
  min(r) OVER[-125,0] AS worst, close / lag(close, 20) OVER[] - mc / lag(mc, 20) OVER[] AS rs_1m,
  close / lag(close, 62) OVER[] - mc / lag(mc, 62) OVER[] AS rs_3m FROM swa),
swing AS MATERIALIZED (SELECT *, {norm('sma50', 10, True)} AS sma50_slope, coalesce(close > sma50, false) AS above_50d, coalesce(close > sma200, false) AS above_200d FROM swb)"""
LIMITS = dict(min_price=20.0, min_dollar_volume=1500.0, max_atr=0.05, max_drop=-0.15, max_stale=5)


def swing_result(source: str) -> str:
    return f"""swr AS (SELECT *, list_filter([CASE WHEN coalesce(close < 20, true) THEN 'price_too_low' END,
  CASE WHEN coalesce(adv < 1500, true) THEN 'low_dollar_volume' END, CASE WHEN coalesce(atr_pct_14 > 0.05, true) THEN 'too_volatile_atr' END,
  CASE WHEN coalesce(worst < -0.15, true) THEN 'large_gap_risk' END, CASE WHEN NOT above_50d THEN 'below_50d' END,
  CASE WHEN days_stale > 5 THEN 'stale_data_' || days_stale || 'd' END], lambda x: x IS NOT NULL) AS rs FROM {source}),
  swz AS (SELECT *, len(rs) = 0 AS tradable, coalesce(array_to_string(rs, ','), '') AS reject_reasons, close AS last_close, adv AS avg_dollar_vol_20, worst AS worst_1d_ret_126,
  CASE WHEN len(rs) = 0 THEN coalesce(least(3, log10(adv) - 5), 0) + above_50d :: INT + 2 * above_200d :: INT
    + CASE WHEN sma50_slope > 0 THEN least(1.5, sma50_slope * 500) ELSE 0 END
    + coalesce(greatest(-2, least(2, rs_1m * 20)), 0) + coalesce(greatest(-1.5, least(1.5, rs_3m * 10)), 0)
    + CASE WHEN v20 > v50 THEN 0.8 ELSE 0 END + CASE WHEN v20 / v50 > 1.1 THEN least(0.5, (v20 / v50 - 1) * 2) ELSE 0 END
    - coalesce(least(2, atr_pct_14 * 15), 0) - coalesce(least(2.5, abs(worst) * 10), 0) END AS score FROM swr)"""


SW_LAST = f"swl AS (SELECT *, max(date) OVER () - date AS days_stale FROM (SELECT * FROM swing {LAST}))"
last_universe = lambda t: screener.swing_universe(screener.with_staleness(screener.last_bar(screener.swing_metrics(t.bars, t.bench))), **LIMITS)
query("f2_universe_filter", "ticker tradable:b reject_reasons days_stale:i",
      f"WITH @bars, @bench, @swing, {SW_LAST}, {swing_result('swl')} SELECT * FROM swz")(last_universe)
query("f3_rejection_histogram", "reason n:i",
      f"WITH @bars, @bench, @swing, {SW_LAST}, {swing_result('swl')}, u AS (SELECT unnest(rs) AS reason FROM swz) SELECT reason, count(*) AS n FROM u GROUP BY 1")(
    lambda t: screener.rejection_histogram(last_universe(t)))
query("p20_swing_score", "ticker score:f",
      f"WITH @bars, @bench, @swing, {SW_LAST}, {swing_result('swl')} SELECT * FROM swz WHERE tradable")(
    lambda t: last_universe(t).where("tradable"))
query("p21_universe_builder", "ticker date:d tradable:b score:f last_close:f avg_dollar_vol_20:f atr_pct_14:f worst_1d_ret_126:f above_50d:b above_200d:b "
      "sma50_slope:f8 rs_1m:f rs_3m:f reject_reasons", f"WITH @bars, @bench, @swing, {SW_LAST}, {swing_result('swl')} SELECT * FROM swz")(last_universe)
query("p22_weekly_universe", "ticker week_start:d date:d tradable:b score:f reject_reasons",
      f"""WITH @bars, @bench, @swing, swk AS (SELECT *, week_start - date AS days_stale FROM (SELECT *, CAST(date_trunc('week', date) AS DATE) + 7 AS week_start FROM swing)
      QUALIFY row_number() OVER (PARTITION BY ticker, week_start ORDER BY date DESC) = 1), {swing_result('swk')} SELECT * FROM swz""")(
    lambda t: screener.weekly_universe(t.bars, t.bench, **LIMITS))
query("k2_two_key_sort", "ticker place:i",
      f"""WITH @bars, @bench, @swing, {SW_LAST}, {swing_result('swl')} SELECT ticker, row_number() OVER (ORDER BY round(score, 6) DESC, round(adv, 4) DESC, ticker) AS place
      FROM swz WHERE tradable""")(
    lambda t: last_universe(t).where("tradable").withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(
        F.round("score", 6).desc(), F.round("avg_dollar_vol_20", 4).desc(), "ticker"))))
query("f6_board_criteria", "ticker price:f rsi:f4 ma_slope",
      "WITH @bars, @rec, @full_ind, @labelled SELECT ticker, close AS price, rsi, ma_slope FROM labelled WHERE rsi >= 50 AND close < 60 AND ma_slope <> 'Flat' AND lower(ticker) LIKE '%brand#1%'")(
    lambda t: screener.criteria(labels.trend_labels(labels.daily_set(t.bars)).withColumnRenamed("close", "price"),
                                [("rsi", ">=", 50), ("price", "<", 60), ("ma_slope", "is not", "Flat"), ("ticker", "contains", "BRAND#1")],
                                [("rsi", True), ("ticker", False)]))
