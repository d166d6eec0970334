"""Event-study queries."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import patterns, scans, shaping, studies
from tapeloom.plans import oracle
from tapeloom.plans.registry import query

FR = oracle.FRAGMENTS
EXITS = ["hold_5", "hold_20", "hold_60"]

query("e1_forward_returns", "ticker date:d fwd_1:f fwd_2:f fwd_5:f fwd_10:f",
      "WITH @bars SELECT *, " + ", ".join(f"lead(close, {k}) OVER[] / close - 1 - 0.0005 AS fwd_{k}" for k in (1, 2, 5, 10)) + " FROM bars")(
    lambda t: studies.close_returns(t.bars, [1, 2, 5, 10], 0.0005))
query("e2_open_to_close_returns", "ticker date:d hold_5:f hold_20:f hold_60:f",
      "WITH @bars SELECT *, " + ", ".join(f"lead(close, {k}) OVER[] / lead(open) OVER[] - 1 - 0.01 AS hold_{k}" for k in (5, 20, 60)) + " FROM bars")(
    lambda t: studies.open_returns(t.bars, [5, 20, 60], 0.01))
FR["cooled"] = """cooled AS (SELECT ticker, variant, min(bar) AS bar FROM variants WHERE variant <> 'current_rule' GROUP BY 1, 2
  UNION ALL SELECT c.ticker, c.variant, (SELECT min(v.bar) FROM variants v WHERE v.ticker = c.ticker AND v.variant = c.variant AND v.bar >= c.bar + 60) AS nb
  FROM cooled c WHERE c.bar IS NOT NULL),
cool AS MATERIALIZED (SELECT v.* FROM variants v JOIN cooled USING (ticker, variant, bar))"""
V = "@bars, @masks, @cooled"
variants = lambda t: patterns.variant_rows(patterns.breakout_masks(t.bars)).where("variant <> 'current_rule'")
cooled = lambda t: studies.cool_down(variants(t), 60, ["ticker", "variant"])
query("e3_cool_down", "ticker variant date:d bar:i", f"WITH {V} SELECT * FROM cool")(cooled)
FR["trail"] = """tp AS MATERIALIZED (SELECT DISTINCT ticker, bar, low AS stop0 FROM cool), nb AS MATERIALIZED (SELECT ticker, row_number() OVER[] AS b, open, high, low, close FROM bars),
ta AS (SELECT p.*, b - bar AS j, nb.open, nb.high, nb.low, nb.close, max(nb.close) OVER (PARTITION BY p.ticker, bar ORDER BY b) AS peak FROM tp p JOIN nb ON nb.ticker = p.ticker AND b BETWEEN bar + 1 AND bar + 120),
trail AS MATERIALIZED (SELECT ticker, bar, coalesce(min_by(close, j) FILTER (close <= peak * 0.8 OR close < stop0), max(close) FILTER (j = 120)) / max(open) FILTER (j = 1) - 1 - 0.01 AS trail FROM ta GROUP BY ticker, bar)"""
query("e4_trailing_exit", "ticker bar:i trail:f", f"WITH {V}, @trail SELECT * FROM trail")(
    lambda t: studies.trail_returns(cooled(t).select("ticker", "bar", F.col("low").alias("stop0")), t.bars))
# Profit targets in per cent.
TARGETS_PCT = [3, 5, 7, 10, 15, 20, 30, 50]
TARGET_LIST = ", ".join(map(str, TARGETS_PCT))
query("e5_target_stop_grid", "ticker bar:i target:i stop_mode hold:i ret:f",
      f"""WITH {V}, @trail, en AS (SELECT ticker, bar, open AS entry FROM ta WHERE j = 1),
      gr AS (SELECT * FROM (SELECT unnest([{TARGET_LIST}]) AS target), (SELECT unnest(['none', 'signal_low']) AS stop_mode), (SELECT unnest([20, 60]) AS hold)),
      x AS (SELECT ta.ticker, ta.bar, stop0, entry, target, stop_mode, hold, min(j) FILTER (high >= entry * (1 + target / 100.0 :: DOUBLE)) AS jt, min(j) FILTER (stop_mode = 'signal_low' AND low < stop0) AS js,
        max(close) FILTER (j = hold) AS c FROM ta JOIN en USING (ticker, bar) JOIN gr ON j <= hold GROUP BY ALL),
      y AS (SELECT x.*, s.open AS so, g.open AS "to" FROM x LEFT JOIN ta s ON s.ticker = x.ticker AND s.bar = x.bar AND s.j = js LEFT JOIN ta g ON g.ticker = x.ticker AND g.bar = x.bar AND g.j = jt)
      SELECT *, CASE WHEN js IS NOT NULL AND (jt IS NULL OR js <= jt) THEN least(so, stop0) WHEN jt IS NOT NULL THEN greatest("to", entry * (1 + target / 100.0 :: DOUBLE)) ELSE c END / entry - 1 - 0.01 AS ret
      FROM y WHERE c IS NOT NULL""")(
    lambda t: studies.target_grid(cooled(t).select("ticker", "bar", F.col("low").alias("stop0")), t.bars, TARGETS_PCT, [20, 60]))
query("e7_persistence_tags", "ticker date:d tag_1 tag_2 tag_4",
      "WITH @bars, @masks, x AS (SELECT *, " + ", ".join(
          f"CASE WHEN lead(close, {d}) OVER[] IS NOT NULL THEN 'D{d}_' || CASE WHEN min(volume) OVER[1,{d}] >= 2 * base_vol AND lead(close, {d}) OVER[] >= close THEN 'confirmed' "
          f"WHEN min(volume) OVER[1,{d}] >= 2 * base_vol THEN 'hot_not_held' WHEN lead(close, {d}) OVER[] >= close THEN 'held_not_hot' ELSE 'faded' END END AS tag_{d}" for d in (1, 2, 4))
      + " FROM masks) SELECT * FROM x WHERE breakout_only AND volx >= 3")(lambda t: studies.persistence_tags(t.bars))
query("e8_earnings_events", "ticker report_date:d date:d reaction:f volx:f tag",
      """WITH @bars, @dividends, @earnings, b AS (SELECT *, CASE WHEN count(*) OVER[-100,-1] >= 80 THEN avg(volume) OVER[-100,-1] END AS base, lag(close) OVER[] AS c_1, lead(close) OVER[] AS c1,
        lead(volume) OVER[] AS v1, lead(date) OVER[] AS nd FROM bars),
      e AS (SELECT e.ticker, report_date, nd AS date, (c1 / c_1 - 1) * 100 AS reaction, greatest(volume, v1) / base AS volx FROM earnings e ASOF JOIN b ON e.ticker = b.ticker AND e.report_date <= b.date
        WHERE c_1 IS NOT NULL AND c1 IS NOT NULL AND base > 0)
      SELECT *, 'earn_all' AS tag FROM e UNION ALL SELECT *, 'react_up' FROM e WHERE reaction >= 5 UNION ALL SELECT *, 'react_down' FROM e WHERE reaction <= -5
      UNION ALL SELECT *, 'up_vol' FROM e WHERE reaction >= 5 AND volx >= 2""")(lambda t: studies.earnings_events(t.bars, t.earnings))
query("e8_spikes_by_earnings", "ticker date:d volx:f tag",
      """WITH @bars, @dividends, @earnings, b AS (SELECT *, row_number() OVER[] AS bar, volume / CASE WHEN count(*) OVER[-100,-1] >= 80 THEN avg(volume) OVER[-100,-1] END AS volx, close / lag(close) OVER[] - 1 AS r, lead(date) OVER[] AS nd FROM bars),
      s AS MATERIALIZED (SELECT * FROM b WHERE r >= 0.05 AND volx >= 3),
      k AS (SELECT ticker, min(bar) AS bar FROM s GROUP BY 1 UNION ALL SELECT k.ticker, (SELECT min(s.bar) FROM s WHERE s.ticker = k.ticker AND s.bar >= k.bar + 20) FROM k WHERE k.bar IS NOT NULL),
      d AS (SELECT e.ticker, b.date AS d0, b.nd AS d1 FROM earnings e ASOF JOIN b ON e.ticker = b.ticker AND e.report_date <= b.date)
      SELECT s.ticker, s.date, s.volx, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.ticker = s.ticker AND s.date IN (d.d0, d.d1)) THEN 'spike_on_earnings' ELSE 'spike_no_earnings' END AS tag
      FROM s JOIN k USING (ticker, bar)""")(lambda t: studies.spike_events(t.bars, t.earnings))
query("e10_baseline_pool", "ticker date:d trail:f",
      """WITH @bars, @masks, z AS (SELECT *, row_number() OVER[] - 1 AS n FROM masks WHERE eligible), cool AS MATERIALIZED (SELECT * FROM z), @trail
      SELECT c.ticker, date, trail FROM cool c JOIN trail USING (ticker, bar)""")(lambda t: studies.baseline_sample(t.bars))
FR["folded"] = """span AS (SELECT min(date) AS a, max(date) AS z FROM bars), hr AS MATERIALIZED (SELECT ticker, date, row_number() OVER[] AS bar, lead(close, 5) OVER[] / lead(open) OVER[] - 1.01 AS hold_5,
  lead(close, 20) OVER[] / lead(open) OVER[] - 1.01 AS hold_20, lead(close, 60) OVER[] / lead(open) OVER[] - 1.01 AS hold_60 FROM bars),
hl AS MATERIALIZED (SELECT ticker, date, least(floor((date - a) * 16 / (z - a) :: DOUBLE), 15) AS fold, exit, ret FROM hr, span, LATERAL (SELECT unnest(['hold_5', 'hold_20', 'hold_60']) AS exit, unnest([hold_5, hold_20, hold_60]) AS ret) WHERE ret IS NOT NULL),
ev AS (SELECT ticker, date, variant FROM cool UNION ALL SELECT ticker, date, variant FROM variants WHERE variant = 'current_rule'),
fe AS (SELECT variant, exit, fold, count(*) AS n, avg(ret) AS candidate FROM ev JOIN hl USING (ticker, date) GROUP BY ALL HAVING count(*) >= 3),
fb AS (SELECT exit, fold, avg(ret) AS baseline FROM hl JOIN masks m USING (ticker, date) WHERE eligible GROUP BY ALL),
folded AS MATERIALIZED (SELECT fe.*, baseline, candidate - baseline AS diff FROM fe JOIN fb USING (exit, fold))"""
query("e11_fold_table", "variant exit fold:i n:i candidate:f baseline:f diff:f", f"WITH {V}, @folded SELECT * FROM folded")(
    lambda t: studies.fold_table(*studies.breakout_study(t.bars), ["variant"], 3))
query("e11_fold_summary", "variant exit events:i folds:i wins:i mean_diff:f t:f",
      f"WITH {V}, @folded SELECT variant, exit, sum(n) AS events, count(*) AS folds, count_if(diff > 0) AS wins, avg(diff) AS mean_diff, avg(diff) / (stddev_samp(diff) / sqrt(count(*))) AS t FROM folded GROUP BY 1, 2")(
    lambda t: studies.fold_summary(studies.fold_table(*studies.breakout_study(t.bars), ["variant"], 3), ["variant"]))
query("v1_one_sample_t", "variant exit folds:i t:f",
      f"WITH {V}, @folded SELECT variant, exit, count(*) AS folds, CASE WHEN count(*) > 1 THEN avg(diff) / (stddev_samp(diff) / sqrt(count(*))) END AS t FROM folded GROUP BY 1, 2")(
    lambda t: studies.fold_summary(studies.fold_table(*studies.breakout_study(t.bars), ["variant"], 3), ["variant"]))

FR["ckpt"] = """ch AS (SELECT unnest([9, 10, 12, 14, 23]) AS checkpoint),
ca AS (SELECT ticker, day, checkpoint, sum(volume) AS cum_volume, max_by(close, hour) AS p FROM hourly JOIN ch ON hour <= checkpoint GROUP BY ALL),
cl AS (SELECT ticker, day, max_by(close, hour) AS last_hourly FROM hourly GROUP BY ALL),
cd AS (SELECT ticker, date AS day, close AS x0, lead(close) OVER[] AS x1, lead(close, 2) OVER[] AS x2, lag(close) OVER[] AS pc, CASE WHEN count(*) OVER[-20,-1] = 20 THEN avg(volume) OVER[-20,-1] END AS av FROM day_bars),
ce AS (SELECT ca.*, p * x0 / last_hourly AS price, (cum_volume / av - 1) * 100 AS spike_pct, x0, x1, x2, cum_volume > av AND p * x0 / last_hourly > pc AS is_event FROM ca JOIN cl USING (ticker, day) JOIN cd USING (ticker, day) WHERE av > 0 AND pc IS NOT NULL),
ckpt AS MATERIALIZED (SELECT * FROM (SELECT ticker, day, checkpoint, spike_pct, is_event, unnest(['same_session_close', 'next_day_close', '2day_close']) AS exit, unnest([x0 / price, x1 / price, x2 / price]) - 1.0005 AS ret FROM ce)
  WHERE ret IS NOT NULL AND NOT (checkpoint = 23 AND exit = 'same_session_close'))"""
C = "@hourly, @day_bars, @ckpt"
ckpt = lambda t: studies.checkpoint_returns(shaping.intraday_checkpoints(t.hourly, t.day_bars, studies.CHECKPOINTS), t.day_bars)
query("e12_checkpoint_returns", "ticker day:d checkpoint:i exit spike_pct:f is_event:b ret:f", f"WITH {C} SELECT * FROM ckpt")(ckpt)
query("e13_same_day_lookahead_diagnostic", "is_event:b n:i mean_ret:f",
      f"""WITH {C}, e AS (SELECT ticker, date AS day, coalesce(volume > CASE WHEN count(*) OVER[-20,-1] = 20 THEN avg(volume) OVER[-20,-1] END AND close > lag(close) OVER[], false) AS ev FROM day_bars)
      SELECT ev AS is_event, count(*) AS n, avg(ret + 0.0005) AS mean_ret FROM ckpt JOIN e USING (ticker, day) WHERE checkpoint = 12 AND exit = 'same_session_close' GROUP BY 1""")(
    lambda t: studies.same_day_diagnostic(ckpt(t), t.day_bars))
query("e14_magnitude_by_checkpoint", "checkpoint:i exit bucket n:i win_rate:f mean_ret:f",
      f"""WITH {C} SELECT checkpoint, exit, CASE WHEN spike_pct < 50 THEN '0-50%' WHEN spike_pct < 100 THEN '50-100%' WHEN spike_pct < 200 THEN '100-200%' ELSE '>200%' END AS bucket, count(*) AS n, avg((ret > 0) :: INT) AS win_rate, avg(ret) AS mean_ret
      FROM ckpt WHERE spike_pct >= 0 GROUP BY 1, 2, 3""")(
    lambda t: ckpt(t).where("spike_pct >= 0").groupBy("checkpoint", "exit", studies.magnitude_bucket().alias("bucket")).agg(
        F.count("*").alias("n"), F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"), F.avg("ret").alias("mean_ret")))
query("v2_welch_t", "exit n_a:i n_b:i mean_a:f mean_b:f t:f4",
      """WITH @bars, h AS (SELECT *, volume > avg(volume) OVER[-20,-1] AS hot, unnest(['fwd_1', 'fwd_5']) AS exit, unnest([lead(close) OVER[], lead(close, 5) OVER[]]) / close - 1 AS ret FROM bars),
      g AS (SELECT exit, count(ret) FILTER (hot) AS n_a, count(ret) FILTER (NOT hot) AS n_b, avg(ret) FILTER (hot) AS mean_a, avg(ret) FILTER (NOT hot) AS mean_b, var_samp(ret) FILTER (hot) AS va, var_samp(ret) FILTER (NOT hot) AS vb
        FROM h WHERE ret IS NOT NULL GROUP BY 1) SELECT *, (mean_a - mean_b) / sqrt(va / n_a + vb / n_b) AS t FROM g""")(
    lambda t: studies.welch_t(studies.unpivot_returns(
        studies.close_returns(t.bars, [1, 5], 0.0).withColumn("hot", F.col("volume") > F.avg("volume").over(ind.rows(-20, -1))), ["hot"], ["fwd_1", "fwd_5"]), ["exit"], F.col("hot"), "ret"))

CONFIGS = {"strict": (1.0, 0.5, 0.6, 1.5, 0.35, 1.3), "loose_wick": (1.0, 0.5, 0.5, 1.0, 0.35, 1.3), "no_break": (-999.0, 0.5, 0.6, 1.5, 0.35, 1.3),
           "sweet_spot": (-999.0, 0.5, 0.55, 1.2, 0.35, 1.3), "loose_all": (-999.0, 0.5, 0.5, 0.7, 0.35, 1.3)}
CONFIG_COLS = ["config", "break_atr", "close_back", "wick_share", "wick_atr", "max_body", "volume_mult"]
query("e15_entry_timing", "config timing ticker date:d exit ret:f",
      f"""WITH @bars, @rec, cf({', '.join(CONFIG_COLS)}) AS (VALUES {', '.join(str((n, *v)) for n, v in CONFIGS.items())}),
      ta AS (SELECT *, row_number() OVER[] AS bar, least(open, close) - low AS wick, high - low AS rng, CASE WHEN count(*) OVER[-10,-1] = 10 THEN min(low) OVER[-10,-1] END AS pl,
        volume / CASE WHEN count(*) OVER[-20,-1] = 20 THEN avg(volume) OVER[-20,-1] END AS vr, lead(close) OVER[] AS nc, lead(date) OVER[] AS nd FROM ind),
      hit AS (SELECT * FROM ta JOIN cf ON bar >= 21 AND rng > 0 AND atr > 0 AND close > pl AND pl - low >= break_atr * atr AND (close - low) / rng >= close_back AND wick / rng >= wick_share AND wick >= wick_atr * atr
        AND abs(close - open) / rng <= max_body AND vr >= volume_mult),
      e AS (SELECT config, ticker, 'same_day' AS timing, date, close AS price FROM hit UNION ALL SELECT config, ticker, 'confirmed_high', nd, nc FROM hit WHERE nc > high
        UNION ALL SELECT config, ticker, 'confirmed_mid', nd, nc FROM hit WHERE nc > (high + low) / 2),
      f AS (SELECT ticker, date, unnest(['fwd_5', 'fwd_10', 'fwd_20']) AS exit, unnest([lead(close, 5) OVER[], lead(close, 10) OVER[], lead(close, 20) OVER[]]) AS x FROM bars)
      SELECT e.*, exit, x / price - 1 AS ret FROM e JOIN f USING (ticker, date) WHERE x IS NOT NULL""")(
    lambda t: studies.entry_timings(t.bars, t.spark.createDataFrame([(n, *v) for n, v in CONFIGS.items()], CONFIG_COLS), [5, 10, 20]))
query("e9_parameter_grid", "config timing n:i mean_ret:f")(
    lambda t: studies.entry_timings(t.bars, t.spark.createDataFrame([(n, *v) for n, v in CONFIGS.items()], CONFIG_COLS), [5, 10, 20]).groupBy("config", "timing").agg(
        F.count("*").alias("n"), F.avg("ret").alias("mean_ret")))
query("e21_mean_without_top", "variant n:i mean_rest:f",
      f"WITH {V}, @folded, r AS (SELECT variant, ret, row_number() OVER (PARTITION BY variant ORDER BY ret DESC) AS k, count(*) OVER (PARTITION BY variant) AS n FROM ev JOIN hl USING (ticker, date) WHERE exit = 'hold_20') "
      "SELECT variant, any_value(n) AS n, avg(ret) AS mean_rest FROM r WHERE k > 5 GROUP BY 1")(lambda t: studies.variant_mean_without_top(t.bars))

# Look-backs, skips and sizes of the rotation grid.
LOOKBACKS, SKIPS, TOP_N = [63, 126, 189, 252], [0, 21], [10, 20, 30]
CELLS = list(product(LOOKBACKS, SKIPS, TOP_N, [False, True]))
LAGS = sorted({*LOOKBACKS, *SKIPS} - {0})

FR["rot"] = f"""rc AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) AS s FROM bench), re AS (SELECT date_trunc('month', date) AS month, max(s) AS a FROM rc GROUP BY 1),
rl AS MATERIALIZED (SELECT * FROM (SELECT month, a, a + 1 AS buy, lead(a) OVER (ORDER BY a) + 1 AS sell FROM re) WHERE sell IS NOT NULL AND a > {max(LOOKBACKS) + 1}),
rp AS MATERIALIZED (SELECT b.ticker, s, b.close, avg(b.close * volume) OVER w99 AS dv, count(*) OVER w99 AS n, CASE WHEN count(*) OVER w199 >= 180 THEN avg(b.close) OVER w199 END AS ma200 FROM bars b JOIN rc USING (date)
  WINDOW w99 AS (PARTITION BY b.ticker ORDER BY s ROWS 99 PRECEDING), w199 AS (PARTITION BY b.ticker ORDER BY s ROWS 199 PRECEDING)),
rb AS MATERIALIZED (SELECT month, a, p.ticker, p.close, p.ma200, least(y.close / x.close - 1, 5) AS fwd FROM rp p JOIN rl ON p.s = a
  JOIN rp x ON x.ticker = p.ticker AND x.s = buy JOIN rp y ON y.ticker = p.ticker AND y.s = sell WHERE p.n >= 80 AND p.dv >= 1000 AND p.close >= 1),
rgrid(cell, lb, sk, top_n, trend) AS (VALUES {', '.join(str((i, *c)) for i, c in enumerate(CELLS))}),
rk AS (SELECT month, a, rb.ticker, fwd, cell, top_n, CASE WHEN sk = 0 THEN rb.close ELSE near.close END / far.close - 1 AS mom FROM rb CROSS JOIN rgrid
  LEFT JOIN rp near ON near.ticker = rb.ticker AND near.s = a - sk LEFT JOIN rp far ON far.ticker = rb.ticker AND far.s = a - lb WHERE NOT trend OR rb.close > rb.ma200),
rpick AS MATERIALIZED (SELECT *, dense_rank() OVER (PARTITION BY cell ORDER BY a) AS i FROM (SELECT * FROM rk WHERE mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY month, cell ORDER BY mom DESC, ticker) <= top_n)),
rew AS (SELECT month, a, avg(fwd) AS equal_weight, count(*) AS universe FROM rb GROUP BY 1, 2),
rsum AS (SELECT p.month, p.cell, avg(p.fwd) - count_if(q.ticker IS NULL) / p.top_n * 0.01 AS ret, count_if(q.ticker IS NULL) / p.top_n AS turnover, count(*) AS picks
  FROM rpick p LEFT JOIN rpick q ON q.cell = p.cell AND q.ticker = p.ticker AND q.i = p.i - 1 GROUP BY p.month, p.cell, p.top_n),
rot AS MATERIALIZED (SELECT rew.month, rew.a AS m, g.cell, coalesce(ret, 0) AS ret, coalesce(turnover, 0) AS turnover, coalesce(picks, 0) AS picks, equal_weight, universe FROM rew CROSS JOIN rgrid g LEFT JOIN rsum ON rsum.month = rew.month AND rsum.cell = g.cell)"""
rot = lambda t: studies.rotation(t.bars, t.bench, CELLS, 1.0, 1000.0)
query("e19_momentum_rotation", "month:d cell:i ret:f turnover:f equal_weight:f universe:i", "WITH @bars, @bench, @rot SELECT * REPLACE (month :: DATE AS month) FROM rot")(rot)
query("k4_top_n_per_date", "month:d cell:i ticker place:i mom:f",
      "WITH @bars, @bench, @rot SELECT month :: DATE AS month, cell, ticker, mom, row_number() OVER (PARTITION BY month, cell ORDER BY mom DESC, ticker) AS place FROM rpick")(
    lambda t: studies.rotation_picks(t.bars, t.bench, CELLS, 1.0, 1000.0))
query("u2_turnover_set_difference", "month:d cell:i kept:i bought:i sold:i",
      """WITH @bars, @bench, @rot, now AS (SELECT month, cell, list(ticker) AS t, min(i) AS i FROM rpick GROUP BY 1, 2)
      SELECT now.month :: DATE AS month, now.cell, len(list_intersect(now.t, coalesce(was.t, []))) AS kept, len(now.t) - len(list_intersect(now.t, coalesce(was.t, []))) AS bought,
        len(coalesce(was.t, [])) - len(list_intersect(now.t, coalesce(was.t, []))) AS sold FROM now LEFT JOIN now was ON was.cell = now.cell AND was.i = now.i - 1""")(
    lambda t: studies.rotation_changes(studies.rotation_picks(t.bars, t.bench, CELLS, 1.0, 1000.0)))
query("e20_walk_forward_choice", "month:d cell:i ret:f equal_weight:f",
      """WITH @bars, @bench, @rot, p AS (SELECT *, avg(ret - equal_weight) OVER w AS past, count(*) OVER w AS n FROM rot WINDOW w AS (PARTITION BY cell ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      SELECT month :: DATE AS month, cell, ret, equal_weight FROM p WHERE n >= 12 QUALIFY row_number() OVER (PARTITION BY month ORDER BY round(past, 10) DESC, cell) = 1""")(lambda t: studies.walk_forward_choice(rot(t)))

H = [1, 5, 20, 60]
FR["outcomes"] = """rx AS (SELECT *, CASE WHEN hour(ts) * 60 + minute(ts) < 570 THEN ts :: DATE ELSE ts :: DATE + 1 END AS want, CASE WHEN hour(ts) >= 16 THEN ts :: DATE ELSE ts :: DATE - 1 END AS known FROM releases),
rd AS MATERIALIZED (SELECT ticker, date, open, close, lag(close) OVER[] AS prior_close FROM day_bars),
dbench AS MATERIALIZED (SELECT date, sum(CAST(round(open * 10000) AS BIGINT)) / (count(*) * 10000.0 :: DOUBLE) AS open, sum(CAST(round(close * 10000) AS BIGINT)) / (count(*) * 10000.0 :: DOUBLE) AS close FROM day_bars GROUP BY date),
bx AS MATERIALIZED (SELECT *, """ + ", ".join(f"lead(date, {h - 1}) OVER (ORDER BY date) AS x{h}, lead(close, {h - 1}) OVER (ORDER BY date) AS c{h}" for h in H) + """ FROM dbench),
ry AS (SELECT r.guid, r.ts, r.ticker, r.category, r.materiality, r.feed, r.value, e.date AS entry_date, e.open AS entry_open, e.prior_close, k.close AS pre_close FROM rx r ASOF JOIN rd e ON e.ticker = r.ticker AND r.want <= e.date
  ASOF LEFT JOIN rd k ON k.ticker = r.ticker AND r.known >= k.date),
rz AS (SELECT ry.*, b.open AS b_open, """ + ", ".join(f"x{h}, c{h}" for h in H) + """ FROM ry ASOF JOIN bx b ON ry.entry_date <= b.date),
outcomes AS MATERIALIZED (SELECT rz.*, """ + ", ".join(f"p{h}.close / entry_open - 1 AS ret_{h}d, c{h} / b_open - 1 AS bench_ret_{h}d" for h in H) + f", p{H[-1]}.close IS NOT NULL AS complete FROM rz " + " ".join(
    f"ASOF LEFT JOIN rd p{h} ON p{h}.ticker = rz.ticker AND x{h} >= p{h}.date" for h in H) + ")"
O = "@releases, @hourly, @day_bars, @outcomes"
query("j4_first_tradeable_session", "guid:i entry_date:d entry_open:f", f"WITH {O} SELECT * FROM outcomes")(lambda t: studies.outcomes(t))
query("j5_last_finished_close", "guid:i pre_close:f prior_close:f", f"WITH {O} SELECT * FROM outcomes")(lambda t: studies.outcomes(t))
query("e16_release_outcomes", "guid:i entry_date:d entry_open:f prior_close:f pre_close:f " + " ".join(f"ret_{h}d:f bench_ret_{h}d:f" for h in H) + " complete:b", f"WITH {O} SELECT * FROM outcomes")(lambda t: studies.outcomes(t))
FR["oevents"] = """oevents AS MATERIALIZED (SELECT * FROM outcomes QUALIFY row_number() OVER (PARTITION BY ticker, entry_date ORDER BY (materiality = 'high') :: INT + (category = 'financing') :: INT DESC, guid) = 1),
olong AS MATERIALIZED (SELECT category, unnest([1, 5, 20, 60]) AS horizon, unnest([ret_1d - bench_ret_1d, ret_5d - bench_ret_5d, ret_20d - bench_ret_20d, ret_60d - bench_ret_60d]) AS x FROM oevents)"""
query("u4_event_deduplication", "guid:i ticker entry_date:d", f"WITH {O}, @oevents SELECT * FROM oevents")(lambda t: studies.deduped_outcomes(t))
olong = lambda t: studies.excess_by_horizon(studies.outcomes(t), ["category"], H)
FR["oall"] = """oall AS MATERIALIZED (SELECT category, unnest([1, 5, 20, 60]) AS horizon, unnest([ret_1d - bench_ret_1d, ret_5d - bench_ret_5d, ret_20d - bench_ret_20d, ret_60d - bench_ret_60d]) AS x FROM outcomes)"""
query("a15_outcome_summary", "category horizon:i n:i mean:f trimmed:f median:f beat:f z:f4",
      f"""WITH {O}, @oall, p AS (SELECT horizon, avg((x > 0) :: INT) AS pool FROM oall WHERE x IS NOT NULL GROUP BY 1),
      r AS (SELECT *, row_number() OVER (PARTITION BY category, horizon ORDER BY x) AS k, count(*) OVER (PARTITION BY category, horizon) AS n FROM oall WHERE x IS NOT NULL),
      g AS (SELECT category, horizon, count(*) AS n, avg(x) AS mean, avg(x) FILTER (k > n // 100 AND k <= n - n // 100) AS trimmed, median(x) AS median, avg((x > 0) :: INT) AS beat FROM r GROUP BY 1, 2)
      SELECT g.*, (beat - pool) / sqrt(pool * (1 - pool) / n) AS z FROM g JOIN p USING (horizon)""")(lambda t: studies.horizon_summary(olong(t), "category"))
query("a17_pooled_beat_rate", "horizon:i pool_beat:f n:i", f"WITH {O}, @oall SELECT horizon, avg((x > 0) :: INT) AS pool_beat, count(*) AS n FROM oall WHERE x IS NOT NULL GROUP BY 1")(lambda t: studies.pooled_beat(olong(t)))

NH = [5, 20, 60]
FR["notes"] = """sn AS (SELECT *, CASE WHEN hour < 16 THEN published ELSE published + 1 END AS want FROM subjects),
sb AS MATERIALIZED (SELECT ticker, date, close, """ + ", ".join(f"lead(close, {h}) OVER[] AS c{h}, lead(date, {h}) OVER[] AS x{h}" for h in NH) + """ FROM bars),
sm AS (SELECT report_id, symbol, published, b.date AS entry_date, b.close AS entry_close, """ + ", ".join(f"c{h}, x{h}" for h in NH) + """ FROM sn ASOF JOIN sb b ON b.ticker = sn.symbol AND sn.want <= b.date),
notes AS MATERIALIZED (SELECT sm.*, """ + ", ".join(f"c{h} / entry_close - 1 AS ret_{h}, b{h}.close / b0.close - 1 AS bench_{h}" for h in NH) + " FROM sm ASOF LEFT JOIN bench b0 ON entry_date >= b0.date " + " ".join(
    f"ASOF LEFT JOIN bench b{h} ON x{h} >= b{h}.date" for h in NH) + ")"
N = "@bars, @bench, @reports, @subjects, @notes"
notes = lambda t: studies.note_outcomes(t.subjects, t.bars, t.bench, NH)
query("e17_note_outcomes", "report_id:i entry_date:d entry_close:f " + " ".join(f"ret_{h}:f bench_{h}:f" for h in NH), f"WITH {N} SELECT * FROM notes")(notes)
FR["track"] = """ctx AS MATERIALIZED (SELECT ticker, date, close / hi - 1 AS off_high, close > s20 AND s20 > s5 AS turning_up, close, n FROM (SELECT *, lag(s20, 5) OVER[] AS s5 FROM (SELECT *, avg(close) OVER[-19,0] AS s20, count(*) OVER[u,0] AS n, max(close) OVER y AS hi FROM bars
  WINDOW y AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW))) WHERE n >= 60),
scored AS MATERIALIZED (SELECT n.*, tone, off_high, turning_up FROM notes n JOIN tags g USING (report_id) LEFT JOIN ctx c ON c.ticker = n.symbol AND c.date = n.entry_date),
trackl AS (SELECT tone, off_high, turning_up, unnest([5, 20, 60]) AS horizon, unnest([ret_5 - bench_5, ret_20 - bench_20, ret_60 - bench_60]) AS x FROM scored),
grouped AS (SELECT 'bullish, beaten down, turning up' AS label, * FROM trackl WHERE tone = 'bullish' AND off_high <= -0.1 AND turning_up UNION ALL SELECT 'bullish, beaten down', * FROM trackl WHERE tone = 'bullish' AND off_high <= -0.1
  UNION ALL SELECT 'bullish, not beaten down', * FROM trackl WHERE tone = 'bullish' AND off_high > -0.1 UNION ALL SELECT 'all bullish', * FROM trackl WHERE tone = 'bullish' UNION ALL SELECT 'neutral', * FROM trackl WHERE tone = 'neutral'
  UNION ALL SELECT 'bearish', * FROM trackl WHERE tone = 'bearish')"""
scored = lambda t: studies.scored_notes(notes(t), t.tags, t.bars)
query("j19_scored_notes", "report_id:i tone off_high:f turning_up:b ret_20:f", f"WITH {N}, @tags, @track SELECT * FROM scored")(scored)
query("a16_track_record", "label horizon:i n:i avg_excess:f median_excess:f hit_rate:f",
      f"WITH {N}, @tags, @track SELECT label, horizon, count(*) AS n, avg(x) AS avg_excess, median(x) AS median_excess, avg((x > 0) :: INT) AS hit_rate FROM grouped WHERE x IS NOT NULL GROUP BY 1, 2")(
    lambda t: studies.track_record(scored(t), NH))
