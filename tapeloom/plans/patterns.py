"""Pattern, signal-lifecycle and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import patterns as pat
from tapeloom.plans import oracle
from tapeloom.plans.registry import query

FR = oracle.FRAGMENTS
CENTS = lambda x: f"floor(({x}) * 100 + 0.5000001) / 100"

def vcp_sql(shrink: float, max_vol: float) -> str:
    return f"""va AS MATERIALIZED (SELECT *, row_number() OVER[] AS bar, high >= max(high) OVER[-2,2] AND count(*) OVER[-2,2] = 5 AS peak,
  low <= min(low) OVER[-2,2] AND count(*) OVER[-2,2] = 5 AS trough, CASE WHEN count(*) OVER[-149,0] = 150 THEN avg(close) OVER[-149,0] END AS ma150,
  close / lag(close) OVER[] - 1 AS r, volume / (avg(volume) OVER[-49,0] + 1e-9) AS vr FROM bars),
vb AS MATERIALIZED (SELECT *, stddev_samp(r) OVER[-9,0] * 100 AS vol FROM va),
vt AS MATERIALIZED (SELECT * FROM vb WHERE close >= ma150 AND vol <= {max_vol}),
vp AS MATERIALIZED (SELECT p.ticker, p.bar, p.high, t.bar AS tb, t.low FROM va p ASOF LEFT JOIN (SELECT * FROM va WHERE trough) t
  ON p.ticker = t.ticker AND p.bar < t.bar WHERE p.peak),
vc AS (SELECT t.ticker, t.date, p.bar, (p.high - p.low) / p.high * 100 AS d FROM vt t JOIN vp p ON p.ticker = t.ticker AND p.bar BETWEEN t.bar - 57 AND t.bar - 2
  AND p.tb <= t.bar - 2),
vd AS (SELECT *, lag(d) OVER (PARTITION BY ticker, date ORDER BY bar) AS pd FROM vc),
vg AS (SELECT ticker, date FROM vd GROUP BY ticker, date HAVING count(*) >= 2 AND count_if(d >= pd * {shrink}) = 0),
vx AS (SELECT t.*, (SELECT arg_max(p.high, p.bar) FROM vp p WHERE p.ticker = t.ticker AND p.bar <= t.bar - 2 AND p.bar >= t.bar - 57) AS pv
  FROM vt t SEMI JOIN vg ON vg.ticker = t.ticker AND vg.date = t.date),
vcp AS MATERIALIZED (SELECT ticker, date, 'VCP' AS pattern, CASE WHEN close > pv AND vr >= 1.5 THEN 'CONFIRMED' WHEN close >= pv * 0.98 THEN 'AT_PIVOT' ELSE 'FORMING' END AS state,
  {CENTS('pv')} AS pivot FROM vx)"""


FR["vcp"] = vcp_sql(0.85, 4.0)
FR["vcp_loose"] = vcp_sql(1.5, 8.0)
FR["pullback"] = f"""pa AS (SELECT *, CASE WHEN rn >= 150 THEN avg(close) OVER[-149,0] END AS ma150, lag(close) OVER[] AS prev, min(low) OVER[-2,0] AS low3,
  volume >= avg(volume) OVER[-19,0] * 0.8 AS vol_ok, CASE WHEN rn >= 10 THEN regr_slope(ema21, rn) OVER[-9,0] END AS s1, CASE WHEN rn >= 10 THEN regr_slope(ema50, rn) OVER[-9,0] END AS s2 FROM ind),
pb AS (SELECT ticker, date, close, ma150, prev, low3, vol_ok, 'PB-EMA21' AS pattern, ema21 AS e, s1 AS s FROM pa UNION ALL
  SELECT ticker, date, close, ma150, prev, low3, vol_ok, 'PB-EMA50', ema50, s2 FROM pa),
pullback AS MATERIALIZED (SELECT ticker, date, pattern, CASE WHEN close > e AND prev <= e * 1.005 AND vol_ok THEN 'CONFIRMED' ELSE 'AT_PIVOT' END AS state, {CENTS('e')} AS pivot
  FROM pb WHERE close >= ma150 AND s > 0 AND low3 <= e * 1.01)"""


def breakout_sql(out: str, name: str, look: int, need: int, base: bool) -> str:
    keep = "AND (top - flo) / flo * 100 <= 20" if base else "AND close >= top * 0.98"
    return f"""{out}_a AS (SELECT *, row_number() OVER[] AS bar, max(high) OVER[-{look - 1},-1] AS top, min(low) OVER[-{look - 1},-1] AS flo,
  volume / (avg(volume) OVER[-49,0] + 1e-9) AS vr FROM bars),
{out} AS MATERIALIZED (SELECT ticker, date, '{name}' AS pattern, CASE WHEN close > top AND vr >= 1.5 THEN 'CONFIRMED' WHEN close >= top * 0.98 THEN 'AT_PIVOT' ELSE 'FORMING' END AS state,
  {CENTS('top')} AS pivot FROM {out}_a WHERE bar >= {need} {keep})"""


FR["basebrk"] = breakout_sql("basebrk", "BASE", 40, 90, True)
FR["mombrk"] = breakout_sql("mombrk", "MOMENTUM", 55, 60, False)
FR["best"] = """allpat AS (SELECT * FROM vcp UNION ALL SELECT * FROM pullback UNION ALL SELECT * FROM basebrk UNION ALL SELECT * FROM mombrk),
best AS MATERIALIZED (SELECT * FROM allpat QUALIFY row_number() OVER (PARTITION BY ticker, date ORDER BY
  list_position(['CONFIRMED', 'AT_PIVOT', 'FORMING', 'FAILED'], state), list_position(['VCP', 'PB-EMA21', 'PB-EMA50', 'BASE', 'MOMENTUM'], pattern)) = 1)"""
FR["states"] = """sta AS (SELECT *, lag(state) OVER (PARTITION BY ticker, pattern ORDER BY date) AS old,
  row_number() OVER (PARTITION BY ticker, pattern ORDER BY date) AS n FROM best),
stb AS (SELECT *, max(CASE WHEN old IS NULL OR old <> state THEN n END) OVER (PARTITION BY ticker, pattern ORDER BY date) AS start,
  min(date) OVER (PARTITION BY ticker, pattern) AS first_seen FROM sta),
states AS MATERIALIZED (SELECT *, n - start + 1 AS days_in_state, old IS NULL OR old <> state AS changed,
  CASE WHEN old IS NULL THEN 'NEW ' || state WHEN old = state THEN 'held ' || state WHEN old = 'FORMING' AND state = 'AT_PIVOT' THEN 'ADVANCING'
  WHEN old = 'AT_PIVOT' AND state = 'CONFIRMED' THEN 'BREAKOUT' WHEN old = 'FORMING' AND state = 'CONFIRMED' THEN 'JUMP' ELSE old || ' > ' || state END AS transition FROM stb)"""
FR["levels"] = f"""la AS MATERIALIZED (SELECT ticker, date, close, volume, atr, rn, min(low) OVER[-19,0] AS sl, high,
  high >= max(high) OVER[-2,2] AND count(*) OVER[-2,2] = 5 AS peak FROM ind),
lb AS (SELECT b.*, l.close, l.volume, l.atr, l.rn, {CENTS('"pivot" * 1.005')} AS entry, sl FROM best b JOIN la l USING (ticker, date)),
lc AS (SELECT *, greatest(least(entry - 1.5 * atr, sl * 0.99), entry * 0.93) AS stop FROM lb),
ld AS (SELECT *, greatest(entry - stop, 0.01) AS risk FROM lc),
lr AS (SELECT d.ticker, d.date, min(p.high) AS res FROM ld d JOIN la p ON p.ticker = d.ticker AND p.peak AND p.rn BETWEEN d.rn - 249 AND d.rn - 2 AND p.high > d.entry + 2 * d.risk GROUP BY ALL),
levels AS MATERIALIZED (SELECT d.*, risk / entry * 100 AS risk_pct, coalesce(res, entry + 2 * risk) AS target_2r, entry + 3 * risk AS target_3r, res IS NOT NULL AS resistance_based,
  round((coalesce(res, entry + 2 * risk) - entry) / greatest(entry - stop, 0.01), 6) AS rr FROM ld d LEFT JOIN lr USING (ticker, date))"""
FR["regime"] = """regime AS MATERIALIZED (SELECT date, close, sma, coalesce(close >= sma, true) AS market_ok FROM (SELECT *, CASE WHEN count(*) OVER y = 200 THEN avg(close) OVER y END AS sma
  FROM bench WINDOW y AS (ORDER BY date ROWS 199 PRECEDING)))"""
BEST = "@bars, @rec, @vcp, @pullback, @basebrk, @mombrk, @best"
PO = "ticker date:d pattern state pivot:f2"
query("p23_vcp", PO, "WITH @bars, @vcp SELECT * FROM vcp")(lambda t: pat.vcp(t.bars))
query("p23_vcp_loose", PO, "WITH @bars, @vcp_loose SELECT * FROM vcp")(lambda t: pat.vcp(t.bars, shrink=1.5, max_vol=8.0))
query("p24_ema_pullback", PO, "WITH @bars, @rec, @pullback SELECT * FROM pullback")(lambda t: pat.ema_pullback(t.bars))
query("p25_base_breakout", PO, "WITH @bars, @basebrk SELECT * FROM basebrk")(lambda t: pat.base_breakout(t.bars))
query("p26_momentum_breakout", PO, "WITH @bars, @mombrk SELECT * FROM mombrk")(lambda t: pat.momentum_breakout(t.bars))
best = lambda t: pat.best_pattern(pat.all_patterns(t.bars))
query("p27_best_pattern", PO, f"WITH {BEST} SELECT * FROM best")(best)
LV = "ticker date:d pattern state entry:f2 stop:f risk_pct:f target_2r:f target_3r:f atr:f4 resistance_based:b"
levels = lambda t: pat.with_levels(best(t), t.bars)
query("p28_trade_levels", LV, f"WITH {BEST}, @levels SELECT * FROM levels")(levels)
query("p29_position_size", "ticker date:d shares:i position_value:f2 account_pct:f4",
      f"WITH {BEST}, @levels, z AS (SELECT *, floor(500 / greatest(entry - stop, 0.01)) AS shares FROM levels) SELECT *, shares * entry AS position_value, shares * entry / 50000 * 100 AS account_pct FROM z")(
    lambda t: levels(t).select("ticker", "date", *pat.position_size(50000.0, 1.0)))
query("p30_invalidation", "ticker date:d pattern state check_date:d failed:b",
      f"""WITH {BEST}, @levels, nx AS (SELECT ticker, date AS check_date, lag(date) OVER[] AS date, close AS now, ema50, volume > avg(volume) OVER[-20,-1] * 1.2 AS heavy FROM ind)
      SELECT l.ticker, l.date, l.pattern, l.state, check_date, coalesce(CASE WHEN pattern = 'VCP' THEN stop > 0 AND now < stop WHEN pattern LIKE 'PB%' THEN now < ema50 AND heavy
        ELSE state IN ('CONFIRMED', 'AT_PIVOT') AND "pivot" > 0 AND now < "pivot" * 0.98 END, false) AS failed FROM levels l JOIN nx USING (ticker, date)""")(
    lambda t: pat.invalidated(levels(t), t.bars))
query("p31_signal_state_merge", "ticker date:d pattern state transition days_in_state:i first_seen:d changed:b", f"WITH {BEST}, @states SELECT * FROM states")(
    lambda t: pat.signal_states(best(t)))
query("p32_expire_missing", "ticker pattern state detail",
      f"""WITH {BEST}, s AS (SELECT ticker, pattern, max(date) AS last_seen, max_by(state, date) AS state FROM best GROUP BY ALL),
      a AS (SELECT DISTINCT ticker FROM bars WHERE date = (SELECT max(date) FROM bars)), m AS (SELECT max(date) AS z FROM bars)
      SELECT ticker, pattern, CASE WHEN x THEN 'EXPIRED' ELSE state END AS state, CASE WHEN x THEN 'Left screener after ' || (z - last_seen) || 'd' END AS detail
      FROM (SELECT s.*, z, s.ticker NOT IN (SELECT ticker FROM a) AND z - last_seen > 2 AS x FROM s, m)""")(
    lambda t: pat.expire_current(best(t), t.bars))
query("p33_alerts_and_intents", "ticker date:d pattern state place:i priority:i",
      f"""WITH {BEST}, @bench, @states, @levels, @regime,
      j AS (SELECT l.*, s.days_in_state FROM levels l JOIN states s USING (ticker, date, pattern)),
      al AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY list_position(['CONFIRMED', 'AT_PIVOT', 'FORMING'], state), days_in_state DESC, ticker) AS place FROM j
        WHERE state IN ('CONFIRMED', 'AT_PIVOT') OR rr >= 2),
      i AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY days_in_state DESC, ticker) AS priority FROM j WHERE state = 'CONFIRMED' AND date IN (SELECT date FROM regime WHERE market_ok))
      SELECT al.*, priority FROM al LEFT JOIN i USING (ticker, date)""")(
    lambda t: pat.alerts_with_intents(t.bars, t.bench))
query("p34_market_regime", "date:d close:f8 sma:f4 market_ok:b", "WITH @bars, @bench, @regime SELECT * FROM regime")(lambda t: pat.market_regime(t.bench))

FR["tails"] = """tla AS (SELECT *, row_number() OVER[] AS bar, least(open, close) - low AS wick, high - low AS rng, CASE WHEN count(*) OVER[-10,-1] = 10 THEN min(low) OVER[-10,-1] END AS prior_low,
  volume / CASE WHEN count(*) OVER[-20,-1] = 20 THEN avg(volume) OVER[-20,-1] END AS volume_ratio, lead(close) OVER[] AS next_close, lead(date) OVER[] AS next_date FROM ind),
tails AS MATERIALIZED (SELECT *, (close - low) / rng AS close_pos, wick / rng AS wick_pct, abs(close - open) / rng AS body_pct FROM tla WHERE bar >= 21 AND rng > 0 AND atr > 0 AND close > prior_low
  AND (close - low) / rng >= 0.5 AND wick / rng >= 0.55 AND wick >= 1.2 * atr AND abs(close - open) / rng <= 0.35 AND volume_ratio >= 1.3)"""
query("p35_tail_scan", "ticker date:d open:f high:f low:f close:f atr:f4 prior_low:f close_pos:f wick_pct:f body_pct:f volume_ratio:f",
      "WITH @bars, @rec, @tails SELECT * FROM tails")(lambda t: pat.tails(t.bars))
query("p36_next_bar_confirmation", "ticker date:d above_high:b above_mid:b",
      "WITH @bars, @rec, @tails SELECT ticker, date, coalesce(next_close > high, false) AS above_high, coalesce(next_close > (high + low) / 2, false) AS above_mid FROM tails")(
    lambda t: pat.tails(t.bars).select("ticker", "date", F.coalesce(F.col("next_close") > F.col("high"), F.lit(False)).alias("above_high"),
                                       F.coalesce(F.col("next_close") > (F.col("high") + F.col("low")) / 2, F.lit(False)).alias("above_mid")))
query("p37_breakout_intents", "ticker signal_date:d trigger:f stop:f target:f status",
      """WITH @bars, @rec, @tails, n AS (SELECT ticker, date, high AS h, row_number() OVER[] AS b FROM bars)
      SELECT t.ticker, t.date AS signal_date, any_value(t.high) AS trigger, any_value(t.low) AS stop, any_value(t.high + 1.5 * (t.high - t.low)) AS target,
        CASE WHEN count_if(h >= t.high) > 0 THEN 'TRIGGERED' WHEN count(h) >= 10 THEN 'EXPIRED' ELSE 'PENDING' END AS status
      FROM tails t LEFT JOIN n ON n.ticker = t.ticker AND b BETWEEN t.bar + 1 AND t.bar + 10 WHERE t.high > t.low GROUP BY t.ticker, t.date""")(
    lambda t: pat.breakout_triggers(pat.tail_intents(pat.tails(t.bars)), t.bars))
query("p38_breakout_trigger_fill", "ticker signal_date:d trigger_date:d shares:i cost:f2",
      """WITH @bars, @rec, @tails, n AS (SELECT ticker, date, high AS h, row_number() OVER[] AS b FROM bars),
      f AS (SELECT t.ticker, t.date AS signal_date, any_value(t.high) AS trigger, any_value(t.low) AS stop, min(n.date) AS trigger_date
        FROM tails t JOIN n ON n.ticker = t.ticker AND b BETWEEN t.bar + 1 AND t.bar + 10 AND h >= t.high GROUP BY t.ticker, t.date),
      z AS (SELECT *, least(floor(200 / (trigger - stop)), floor(2000 / trigger)) AS shares FROM f WHERE trigger > stop)
      SELECT *, shares * trigger AS cost FROM z WHERE shares > 0""")(lambda t: pat.breakout_fills(t.bars, 10000.0, 2.0, 5))

FR["elder"] = ("wkm AS MATERIALIZED (SELECT * FROM weekly), " + oracle.ewm("wk13", "wkm", {"ema": ("close", "2.0/14")}) + """,
wtr AS (SELECT w.ticker, w.date, w.rn, CASE WHEN e.ema > lag(e.ema, 3) OVER o THEN 'up' WHEN e.ema < lag(e.ema, 3) OVER o THEN 'down' ELSE 'flat' END AS t
  FROM weekly w JOIN wk13 e USING (ticker, rn) WINDOW o AS (PARTITION BY w.ticker ORDER BY w.rn)),
wtl AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, lag(t) OVER[] AS weekly_trend FROM wtr) WHERE weekly_trend IS NOT NULL),
eda AS (SELECT *, high - ema13 AS bull, low - ema13 AS bear, CASE WHEN ema13 > lag(ema13, 3) OVER[] THEN 'up' WHEN ema13 < lag(ema13, 3) OVER[] THEN 'down' ELSE 'flat' END AS trend FROM ind),
edb AS (SELECT *, lag(bull) OVER[] AS bull_1, lag(bear) OVER[] AS bear_1 FROM eda),
elder AS MATERIALIZED (SELECT e.*, w.weekly_trend, CASE WHEN bull > 0 AND bear > 0 THEN 'BULLS IN CONTROL' WHEN bull < 0 AND bear < 0 THEN 'BEARS IN CONTROL'
  WHEN trend = 'up' AND bear < 0 AND bear > bear_1 THEN CASE WHEN weekly_trend = 'down' THEN 'STAND ASIDE (weekly trend disagrees)' ELSE 'BUY SETUP (bears fading in uptrend)' END
  WHEN trend = 'down' AND bull > 0 AND bull < bull_1 THEN CASE WHEN weekly_trend = 'up' THEN 'STAND ASIDE (weekly trend disagrees)' ELSE 'SELL SETUP (bulls fading in downtrend)' END
  ELSE 'STAND ASIDE' END AS read FROM edb e ASOF LEFT JOIN wtl w ON w.ticker = e.ticker AND e.date >= w.date)""")
ELDER = "@bars, @rec, @weekly, @elder"
query("p39_elder_ray_reads", "ticker date:d bull:f4 bear:f4 trend weekly_trend read", f"WITH {ELDER} SELECT * FROM elder")(lambda t: pat.elder_reads(t.bars))
query("j2_weekly_trend_asof", "ticker date:d weekly_trend", f"WITH {ELDER} SELECT * FROM elder")(lambda t: pat.elder_reads(t.bars))
#: The nine pairs of the reference, and one with a slower week.
ELDER_SPANS = [(d, w) for d in (8, 13, 21) for w in (8, 13, 21)] + [(13, 26)]
query("p58_elder_ray_grid", "daily_span:i weekly_span:i read n:i")(
    lambda t: pat.elder_grid(t.bars, ELDER_SPANS).groupBy("daily_span", "weekly_span", "read").agg(F.count("*").alias("n")))
FR["triple"] = """tsw AS (SELECT w.ticker, w.date, CASE WHEN w.rn < 16 THEN 'FLAT' WHEN e.ema > lag(e.ema, 3) OVER o THEN 'UP' WHEN e.ema < lag(e.ema, 3) OVER o THEN 'DOWN' ELSE 'FLAT' END AS trend
  FROM weekly w JOIN wk13 e USING (ticker, rn) WINDOW o AS (PARTITION BY w.ticker ORDER BY w.rn)),
tsa AS (SELECT *, close - lag(close, 10) OVER[] AS m, lag(high) OVER[] AS h1, lag(low) OVER[] AS l1, CASE WHEN rn > 20 THEN avg(volume) OVER[-20,-1] END AS v20 FROM ind),
tsb AS (SELECT *, max(m) OVER[-19,0] AS mh, min(m) OVER[-19,0] AS ml FROM tsa),
tsc AS (SELECT b.*, coalesce(w.trend, 'FLAT') AS trend FROM tsb b ASOF LEFT JOIN tsw w ON w.ticker = b.ticker AND b.date >= w.date),
tsd AS (SELECT *, coalesce((trend = 'UP' AND force_short < 0) OR (trend = 'DOWN' AND force_short > 0), false) AS pullback,
  coalesce(rn >= 30 AND volume > v20 * 1.5 AND ((trend = 'UP' AND high > h1 AND m = mh) OR (trend = 'DOWN' AND low < l1 AND m = ml)), false) AS triggered FROM tsc),
triple AS MATERIALIZED (SELECT *, CASE WHEN trend = 'UP' AND pullback AND triggered THEN 'BUY' ELSE 'WAIT' END AS signal, CASE WHEN trend = 'DOWN' THEN 'SELL' ELSE 'HOLD' END AS open_signal FROM tsd)"""
query("p40_triple_screen", "ticker date:d trend pullback:b triggered:b signal open_signal", f"WITH {ELDER}, @triple SELECT * FROM triple")(lambda t: pat.triple_screen(t.bars))

FR["masks"] = """mka AS (SELECT *, row_number() OVER[] AS bar, CASE WHEN count(*) OVER[-100,-1] >= 80 THEN avg(volume) OVER[-100,-1] END AS base_vol, CASE WHEN count(*) OVER[-20,-1] >= 20 THEN avg(volume) OVER[-20,-1] END AS vol20,
  CASE WHEN count(*) OVER[-100,-1] >= 80 THEN avg(close * volume) OVER[-100,-1] END AS dollar, CASE WHEN count(*) OVER[-120,-1] >= 96 THEN max(close) OVER[-120,-1] END AS hi,
  CASE WHEN count(*) OVER[-60,-1] >= 60 THEN max(close) OVER[-60,-1] / min(close) OVER[-60,-1] END AS rng, lag(close) OVER[] AS prior FROM bars),
mkb AS (SELECT *, volume / base_vol AS volx, coalesce(dollar >= 1000 AND close >= 0.2, false) AS eligible FROM mka),
masks AS MATERIALIZED (SELECT *, eligible AND coalesce(volume > vol20 AND close > prior, false) AS current_rule, eligible AND coalesce(close > hi, false) AS breakout_only,
  eligible AND coalesce(close > hi AND volx >= 3, false) AS breakout_vol3, eligible AND coalesce(close > hi AND volx >= 3 AND vol20 <= 1.2 * base_vol AND rng <= 1.5, false) AS breakout_vol3_quiet,
  eligible AND coalesce(close > hi AND volx >= 5 AND vol20 <= 1.2 * base_vol AND rng <= 1.5, false) AS breakout_vol5_quiet FROM mkb),
variants AS MATERIALIZED (SELECT ticker, date, bar, variant, volx, open, low, close FROM (SELECT *, unnest(['current_rule', 'breakout_only', 'breakout_vol3', 'breakout_vol3_quiet', 'breakout_vol5_quiet']) AS variant,
  unnest([current_rule, breakout_only, breakout_vol3, breakout_vol3_quiet, breakout_vol5_quiet]) AS held FROM masks) WHERE held)"""
query("p42_breakout_variants", "ticker date:d variant volx:f", "WITH @bars, @masks SELECT * FROM variants")(lambda t: pat.variant_rows(pat.breakout_masks(t.bars)))
query("f14_eligibility_mask", "ticker date:d eligible:b", "WITH @bars, @masks SELECT * FROM masks")(lambda t: pat.breakout_masks(t.bars))
query("p43_dip_candidates", "ticker current:f high_52w:f pct_off_high:f sector",
      """WITH @bars, @sectors, e AS (SELECT ticker, max(date) AS z FROM bars GROUP BY 1),
      g AS (SELECT ticker, max(close) AS high_52w, max_by(close, date) AS current FROM bars JOIN e USING (ticker) WHERE z - date < 365 GROUP BY 1)
      SELECT g.*, (high_52w - current) / high_52w AS pct_off_high, coalesce(sector, 'Unknown') AS sector FROM g LEFT JOIN sectors USING (ticker) WHERE (high_52w - current) / high_52w >= 0.1""")(
    lambda t: pat.dip_candidates(t.bars, t.sectors, 0.10))
