"""Indicator queries over daily bars (window functions and recursive averages)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions import recursive as rec
from tapeloom.operators import runs, scans, technicals
from tapeloom.plans.registry import query
from tapeloom.sources.tables import Tables


def bars_with(t: Tables, **columns: Column) -> DataFrame:
    return t.bars.select("*", *[c.alias(n) for n, c in columns.items()])


def over_bars(select: str, extra: str = "") -> str:
    return f"WITH @bars SELECT ticker, date, {select} FROM bars {extra}"


def full(value: str, column: str, lo: int, hi: int, need: int) -> str:
    """SQL twin of ``indicators.full``."""
    return f"CASE WHEN count({column}) OVER[{lo},{hi}] >= {need} THEN {value} OVER[{lo},{hi}] END"


query("m1_bars", "ticker date:d open:f high:f low:f close:f volume:f", "WITH @bars SELECT * FROM bars")(lambda t: t.bars)
query("m2_benchmark", "date:d open:f8 close:f8", "WITH @bars, @bench SELECT * FROM bench")(lambda t: t.bench)
query("m3_hourly_bars", "ticker day:d hour:i open:f high:f low:f close:f volume:f", "WITH @hourly SELECT * FROM hourly")(
    lambda t: t.hourly)

query(
    "p41_volume_spike_scan",
    "ticker date:d close:f volume:f avg_volume:f spike_pct:f place:i",
    """WITH @bars, v AS (
      SELECT *, lag(close) OVER[] AS prior, avg(volume) OVER[-20,-1] AS avg_volume FROM bars),
    hit AS (SELECT *, (volume - avg_volume) / avg_volume * 100 AS spike_pct FROM v
            WHERE close > prior AND volume > avg_volume AND avg_volume > 0)
    SELECT *, rank() OVER (PARTITION BY date ORDER BY round(spike_pct, 6) DESC) AS place FROM hit""",
)(lambda t: scans.volume_spikes(t.bars))

query("w1_sma", "ticker date:d sma20:f sma50:f sma200:f7",
      over_bars(f"{full('avg(close)', 'close', -19, 0, 20)} AS sma20, {full('avg(close)', 'close', -49, 0, 50)} AS sma50, "
                f"{full('avg(close)', 'close', -199, 0, 200)} AS sma200"))(
    lambda t: bars_with(t, sma20=ind.sma("close", 20), sma50=ind.sma("close", 50), sma200=ind.sma("close", 200)))

query("w2_ema", "ticker date:d ema21:f4 ema50:f4", "WITH @bars, @rec SELECT * FROM ind")(
    lambda t: rec.averages(t.bars, {"ema21": (F.col("close"), rec.span(21)), "ema50": (F.col("close"), rec.span(50))}))

query("w3_wilder", "ticker date:d gain:f4 loss:f4", "WITH @bars, @rec SELECT * FROM ind")(
    lambda t: rec.averages(bars_with(t, move=F.col("close") - ind.lag("close")),
                           {"gain": (technicals.gains(F.col("move")), rec.wilder(14)),
                            "loss": (technicals.gains(-F.col("move")), rec.wilder(14))}))

query("w4_rsi", "ticker date:d rsi:f4", "WITH @bars, @rec SELECT * FROM ind")(lambda t: technicals.rsi(t.bars))
query("w5_macd", "ticker date:d macd_line:f4 macd_signal:f4 macd_hist:f4", "WITH @bars, @rec SELECT * FROM ind")(
    lambda t: rec.macd(t.bars))

query("w6_true_range", "ticker date:d tr:f",
      over_bars("greatest(high - low, abs(high - lag(close) OVER[]), abs(low - lag(close) OVER[])) AS tr"))(
    lambda t: bars_with(t, tr=ind.true_range()))

query("w7_atr_wilder", "ticker date:d atr:f4", "WITH @bars, @rec SELECT * FROM ind")(lambda t: technicals.atr(t.bars))

query("w8_atr_simple", "ticker date:d atr:f7",
      "WITH @bars, x AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER[]), abs(low - lag(close) OVER[])) AS tr "
      f"FROM bars) SELECT *, {full('avg(tr)', 'tr', -13, 0, 14)} AS atr FROM x")(
    lambda t: bars_with(t, tr=ind.true_range()).withColumn("atr", ind.sma("tr", 14)))

query("w9_directional_system", "ticker date:d plus_di:f4 minus_di:f4 adx:f4", "WITH @bars, @rec SELECT * FROM ind")(
    lambda t: technicals.directional(t.bars))

query("w10_obv", "ticker date:d obv:f",
      "WITH @bars, x AS (SELECT *, sign(close - lag(close) OVER[]) * volume AS v FROM bars) "
      "SELECT *, sum(v) OVER[u,0] AS obv FROM x")(lambda t: technicals.accumulation(t.bars))

query("w11_accumulation_distribution", "ticker date:d ad:f4",
      "WITH @bars, x AS (SELECT *, CASE WHEN high > low THEN (close - open) / (high - low) * volume ELSE 0 END AS v "
      "FROM bars) SELECT *, sum(v) OVER[u,0] AS ad FROM x")(lambda t: technicals.accumulation(t.bars))

query("w12_force_index", "ticker date:d force_raw:f4 force_short:f4 force_long:f4",
      "WITH @bars, @rec SELECT *, volume * (close - lag(close) OVER[]) AS force_raw FROM ind")(
    lambda t: technicals.force_index(t.bars))

query("w13_stochastic", "ticker date:d stoch_k:f stoch_d:f",
      f"""WITH @bars, a AS (SELECT *, {full('min(low)', 'low', -4, 0, 5)} AS lo, {full('max(high)', 'high', -4, 0, 5)} AS hi FROM bars),
      f AS (SELECT *, (close - lo) / nullif(hi - lo, 0) * 100 AS fast FROM a),
      k AS (SELECT *, {full('avg(fast)', 'fast', -2, 0, 3)} AS stoch_k FROM f)
      SELECT *, {full('avg(stoch_k)', 'stoch_k', -2, 0, 3)} AS stoch_d FROM k""")(lambda t: technicals.stochastic(t.bars))

query("w14_elder_ray_power", "ticker date:d bull_power:f4 bear_power:f4",
      "WITH @bars, @rec SELECT *, high - ema13 AS bull_power, low - ema13 AS bear_power FROM ind")(
    lambda t: technicals.elder_power(t.bars))

query("w15_norm_slope", "ticker date:d slope:f",
      f"""WITH @bars, x AS (SELECT *, row_number() OVER[] AS bar FROM bars)
      SELECT *, coalesce(CASE WHEN count(*) OVER[-19,0] >= 20 THEN (20 * sum(close * bar) OVER[-19,0]
        - sum(close) OVER[-19,0] * sum(bar) OVER[-19,0]) / (20 * sum(bar * bar) OVER[-19,0] - (sum(bar) OVER[-19,0]) ** 2)
        / (abs(avg(close) OVER[-19,0]) + 1e-9) END, 0) AS slope FROM x""")(
    lambda t: bars_with(t, bar=ind.bar_number()).withColumn("slope", F.coalesce(ind.norm_slope("close", 20), F.lit(0.0))))

query("w16_signed_slope", "ticker date:d sma50_slope:f8",
      f"""WITH @bars, x AS (SELECT *, row_number() OVER[] AS bar, {full('avg(close)', 'close', -49, 0, 50)} AS m FROM bars)
      SELECT *, CASE WHEN count(m) OVER[-9,0] >= 10 THEN regr_slope(m, bar) OVER[-9,0] / (avg(m) OVER[-9,0] + 1e-9) END
        AS sma50_slope FROM x""")(
    lambda t: bars_with(t, bar=ind.bar_number(), m=ind.sma("close", 50)).withColumn(
        "sma50_slope", ind.norm_slope("m", 10, signed=True)))

query("w17_rolling_volatility", "ticker date:d vol_pct:f",
      f"WITH @bars, x AS (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars) SELECT *, {full('stddev_samp(r)', 'r', -9, 0, 10)} * 100 AS vol_pct FROM x"
      .replace("END * 100", "* 100 END"))(
    lambda t: bars_with(t, r=ind.change_pct()).withColumn("vol_pct", ind.rolling_std("r", 10) * 100))

query("w18_prior_extremes", "ticker date:d prior_low:f prior_high:f",
      over_bars(f"{full('min(low)', 'low', -20, -1, 20)} AS prior_low, {full('max(high)', 'high', -120, -1, 96)} AS prior_high"))(
    lambda t: bars_with(t, prior_low=ind.prior_min("low", 20), prior_high=ind.prior_max("high", 120, need=96)))

query("w19_prior_volume", "ticker date:d avg_volume:f volume_ratio:f",
      over_bars(f"{full('avg(volume)', 'volume', -20, -1, 16)} AS avg_volume, volume / ({full('avg(volume)', 'volume', -20, -1, 16)}) AS volume_ratio"))(
    lambda t: bars_with(t, avg_volume=ind.prior_mean("volume", 20, need=16)).withColumn(
        "volume_ratio", F.col("volume") / F.col("avg_volume")))

query("w20_year_extremes", "ticker date:d dist_high:f dist_low:f",
      over_bars(f"close / ({full('max(high)', 'high', -251, 0, 252)}) - 1 AS dist_high, close / ({full('min(low)', 'low', -251, 0, 252)}) - 1 AS dist_low"))(
    lambda t: bars_with(t, dist_high=ind.ratio("close", ind.rolling_max("high", 252)) - 1,
                        dist_low=ind.ratio("close", ind.rolling_min("low", 252)) - 1))

query("w21_momentum", "ticker date:d ret_5:f ret_21:f ret_63:f mom_12_1:f",
      over_bars("close / lag(close, 5) OVER[] - 1 AS ret_5, close / lag(close, 21) OVER[] - 1 AS ret_21, "
                "close / lag(close, 63) OVER[] - 1 AS ret_63, lag(close, 21) OVER[] / lag(close, 252) OVER[] - 1 AS mom_12_1"))(
    lambda t: bars_with(t, ret_5=ind.change_pct(n=5), ret_21=ind.change_pct(n=21), ret_63=ind.change_pct(n=63),
                        mom_12_1=ind.ratio(ind.lag("close", 21), ind.lag("close", 252)) - 1))

query("w22_log_volatility", "ticker date:d vol_5:f vol_20:f vol_60:f",
      "WITH @bars, x AS (SELECT *, ln(close) - ln(lag(close) OVER[]) AS r FROM bars) SELECT *, "
      f"{full('stddev_samp(r)', 'r', -4, 0, 5)} AS vol_5, {full('stddev_samp(r)', 'r', -19, 0, 20)} AS vol_20, "
      f"{full('stddev_samp(r)', 'r', -59, 0, 60)} AS vol_60 FROM x")(
    lambda t: bars_with(t, r=F.ln("close") - F.ln(ind.lag("close"))).select(
        "*", *[ind.rolling_std("r", n).alias(f"vol_{n}") for n in (5, 20, 60)]))

query("w23_rolling_beta", "ticker date:d beta_60:f",
      """WITH @bars, @bench, m AS (SELECT date, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS y FROM bench),
      x AS (SELECT b.*, ln(b.close) - ln(lag(b.close) OVER (PARTITION BY b.ticker ORDER BY b.date)) AS r, y
            FROM bars b JOIN m USING (date))
      SELECT *, CASE WHEN count(r) OVER[-59,0] >= 60 AND count(y) OVER[-59,0] >= 60
        THEN covar_samp(r, y) OVER[-59,0] / var_samp(y) OVER[-59,0] END AS beta_60 FROM x""")(
    lambda t: scans.rolling_beta(t.bars, t.bench, 60))

query("w24_mean_gap", "ticker date:d gap_abs_20:f",
      f"WITH @bars, x AS (SELECT *, abs(open / lag(close) OVER[] - 1) AS g FROM bars) SELECT *, {full('avg(g)', 'g', -19, 0, 20)} AS gap_abs_20 FROM x")(
    lambda t: bars_with(t, g=F.abs(ind.ratio("open", ind.lag("close")) - 1)).withColumn("gap_abs_20", ind.sma("g", 20)))

query("w25_worst_day", "ticker date:d worst_126:f",
      "WITH @bars, x AS (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars) SELECT *, min(r) OVER[-125,0] AS worst_126 FROM x")(
    lambda t: bars_with(t, r=ind.change_pct()).withColumn("worst_126", F.min("r").over(ind.rows(-125, 0))))

query("w26_relative_strength", "ticker date:d rs_1m:f rs_3m:f",
      """WITH @bars, @bench, x AS (SELECT b.ticker, b.date, b.close, m.close AS mc FROM bars b JOIN bench m USING (date))
      SELECT *, close / lag(close, 20) OVER[] - mc / lag(mc, 20) OVER[] AS rs_1m,
             close / lag(close, 62) OVER[] - mc / lag(mc, 62) OVER[] AS rs_3m FROM x""")(
    lambda t: scans.relative_strength(t.bars, t.bench))

query("w27_volume_trend", "ticker date:d vol_trend_up:b vol_ratio_20_50:f8",
      f"WITH @bars, x AS (SELECT *, {full('avg(volume)', 'volume', -19, 0, 20)} AS v20, {full('avg(volume)', 'volume', -49, 0, 50)} AS v50 FROM bars) "
      "SELECT *, coalesce(v20 > v50, false) AS vol_trend_up, v20 / v50 AS vol_ratio_20_50 FROM x")(
    lambda t: bars_with(t, v20=ind.sma("volume", 20), v50=ind.sma("volume", 50))
    .withColumn("vol_trend_up", F.coalesce(F.col("v20") > F.col("v50"), F.lit(False)))
    .withColumn("vol_ratio_20_50", F.col("v20") / F.col("v50")))

query("w28_days_stale", "ticker last_date:d days_stale:i",
      "WITH @bars SELECT ticker, max(date) AS last_date, (SELECT max(date) FROM bars) - max(date) AS days_stale FROM bars GROUP BY ticker")(
    lambda t: scans.staleness(t.bars))

query("w29_drawdown", "ticker date:d peak:f drawdown:f",
      over_bars("max(close) OVER[u,0] AS peak, close / max(close) OVER[u,0] - 1 AS drawdown"))(
    lambda t: bars_with(t, peak=F.max("close").over(ind.to_date())).withColumn("drawdown", ind.ratio("close", "peak") - 1))

query("w30_strict_runs", "ticker date:d rising:b falling:b",
      """WITH @bars, x AS (SELECT *, lag(close) OVER[] AS p, lag(close, 2) OVER[] AS pp FROM bars)
      SELECT *, coalesce(close > p AND p > pp, false) AS rising, coalesce(close < p AND p < pp, false) AS falling FROM x""")(
    lambda t: bars_with(t, rising=runs.strict_run("close", 3, True), falling=runs.strict_run("close", 3, False)))

query("w31_true_run", "ticker date:d run_start:d run_length:i run_low:f",
      """WITH @bars, x AS (SELECT *, close < open AS flag, row_number() OVER[] AS rn FROM bars),
      g AS (SELECT *, rn - row_number() OVER (PARTITION BY ticker, flag ORDER BY date) AS island FROM x)
      SELECT *, min(date) OVER o AS run_start, count(*) OVER o AS run_length, min(low) OVER o AS run_low FROM g WHERE flag
      WINDOW o AS (PARTITION BY ticker, island ORDER BY date)""")(
    lambda t: runs.true_runs(bars_with(t, flag=F.col("close") < F.col("open")), "flag", "low"))

query("w32_forward_window", "ticker date:d fut_min:f fut_vol:f",
      "WITH @bars, x AS (SELECT *, ln(close) - ln(lag(close) OVER[]) AS r FROM bars) SELECT *, "
      f"{full('min(close)', 'close', 1, 20, 20)} AS fut_min, {full('stddev_samp(r)', 'r', 1, 20, 20)} AS fut_vol FROM x")(
    lambda t: bars_with(t, r=F.ln("close") - F.ln(ind.lag("close"))).select(
        "*", ind.full(F.min("close").over(ind.rows(1, 20)), "close", ind.rows(1, 20), 20).alias("fut_min"),
        ind.full(F.stddev_samp("r").over(ind.rows(1, 20)), "r", ind.rows(1, 20), 20).alias("fut_vol")))

query("w33_cross_sectional_rank", "ticker date:d score:f",
      """WITH @bars SELECT ticker, date, (rank() OVER (PARTITION BY date ORDER BY volume)
        + (count(*) OVER (PARTITION BY date, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY date) - 0.5 AS score FROM bars""")(
    lambda t: t.bars.withColumn("score", ind.centred_rank("volume", ["date"])))

query("w34_percentile_of_score", "ticker date:d percentile:f",
      """WITH @bars SELECT a.ticker, a.date, (count_if(b.volume < a.volume) + count_if(b.volume <= a.volume) + 1) * 50.0 / count(*)
      AS percentile FROM bars a JOIN bars b USING (date) GROUP BY a.ticker, a.date""")(
    lambda t: t.bars.withColumn("percentile", ind.percentile_of_score("volume", ["date"])))

query("w35_pivots", "ticker date:d pivot_low:b pivot_high:b",
      """WITH @bars, x AS (SELECT *, min(close) OVER[-3,-1] AS ll, min(close) OVER[1,3] AS rl, max(close) OVER[-3,-1] AS lh,
        max(close) OVER[1,3] AS rh, count(*) OVER[-3,3] AS n FROM bars)
      SELECT *, close < ll AND close < rl AS pivot_low, close > lh AND close > rh AS pivot_high FROM x
      WHERE n = 7 AND ((close < ll AND close < rl) OR (close > lh AND close > rh))""")(
    lambda t: runs.with_pivots(t.bars, "close", 3).where("pivot_low or pivot_high"))

query("w36_swings", "ticker date:d peak:b trough:b",
      """WITH @bars, x AS (SELECT *, count(*) OVER[-2,2] AS n, max(high) OVER[-2,2] AS hh, min(low) OVER[-2,2] AS ll FROM bars)
      SELECT *, high >= hh AS peak, low <= ll AS trough FROM x WHERE n = 5 AND (high >= hh OR low <= ll)""")(
    lambda t: runs.with_swings(t.bars).where("peak or trough"))

query("w37_momentum_extreme", "ticker date:d momentum:f new_high:b new_low:b",
      """WITH @bars, x AS (SELECT *, close - lag(close, 10) OVER[] AS momentum FROM bars),
      y AS (SELECT *, max(momentum) OVER[-19,0] AS hi, min(momentum) OVER[-19,0] AS lo, count(momentum) OVER[-19,0] AS n FROM x)
      SELECT *, momentum = hi AS new_high, momentum = lo AS new_low FROM y WHERE n = 20""")(
    lambda t: scans.momentum_extremes(t.bars).where("momentum_high is not null")
    .withColumn("new_high", F.col("momentum") == F.col("momentum_high"))
    .withColumn("new_low", F.col("momentum") == F.col("momentum_low")))

query("w38_reference_lines", "ticker date:d lower_5:f4 upper_95:f4",
      "WITH @bars, @rec SELECT *, quantile_cont(rsi, 0.05) OVER[-119,0] AS lower_5, quantile_cont(rsi, 0.95) OVER[-119,0] AS upper_95 FROM ind")(
    lambda t: technicals.rsi(t.bars).select(
        "*", F.percentile("rsi", F.lit(0.05)).over(ind.rows(-119, 0)).alias("lower_5"),
        F.percentile("rsi", F.lit(0.95)).over(ind.rows(-119, 0)).alias("upper_95")))

query("w39_histogram_extreme", "ticker date:d reading",
      """WITH @bars, @rec SELECT *, CASE WHEN macd_hist >= max(macd_hist) OVER[-62,0] THEN 'New High'
        WHEN macd_hist <= min(macd_hist) OVER[-62,0] THEN 'New Low' ELSE 'No' END AS reading FROM ind""")(
    lambda t: rec.macd(t.bars).withColumn("reading", scans.extreme_reading("macd_hist", 63)))

query("w42_price_context",
      "ticker date:d close:f high_52w:f low_52w:f pct_off_high:f range_pos:f ret_20d:f above_sma50:b turning_up:b",
      """WITH @bars, x AS (SELECT *, avg(close) OVER[-19,0] AS s20, avg(close) OVER[-49,0] AS s50, count(*) OVER[u,0] AS n,
        max(close) OVER y AS hi, min(close) OVER y AS lo FROM bars
        WINDOW y AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW))
      SELECT ticker, date, close, hi AS high_52w, lo AS low_52w, close / hi - 1 AS pct_off_high,
             CASE WHEN hi > lo THEN (close - lo) / (hi - lo) END AS range_pos, close / lag20 - 1 AS ret_20d,
             close > s50 AS above_sma50, close > s20 AND s20 > s20_5 AS turning_up
      FROM (SELECT *, lag(close, 20) OVER[] AS lag20, lag(s20, 5) OVER[] AS s20_5 FROM x) WHERE n >= 60""")(
    lambda t: scans.price_context(t.bars))

query("w43_latest_row", "ticker date:d close:f volume:f",
      "WITH @bars SELECT ticker, max(date) AS date, max_by(close, date) AS close, max_by(volume, date) AS volume FROM bars GROUP BY ticker")(
    lambda t: scans.latest(t.bars))
