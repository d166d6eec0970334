"""Panel, forecast, statistics and equity-curve queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import curves, ledger, panel, shaping, stats
from tapeloom.plans import oracle
from tapeloom.plans.ledger import X as EXCESS
from tapeloom.plans.registry import query
from tapeloom.sources.bridge import benchmark_bars
from tapeloom.sources.workspace import stored

FR = oracle.FRAGMENTS
YEARS = [1998, 1999, 2000, 2001]


def roll(f: str, c: str, n: int) -> str:
    return f"CASE WHEN count({c}) OVER[-{n - 1},0] >= {n} THEN {f}({c}) OVER[-{n - 1},0] END"


FR["aligned"] = """ls AS (SELECT date, row_number() OVER (ORDER BY date) AS session FROM bench), lg AS (SELECT ticker, ls.date, session FROM (SELECT DISTINCT ticker FROM bars) CROSS JOIN ls),
lj AS (SELECT g.*, b.open, b.high, b.low, b.close, b.volume, last_value(CASE WHEN b.close IS NOT NULL THEN session END IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY session) AS own,
  last_value(b.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY session) AS hold FROM lg g LEFT JOIN bars b ON b.ticker = g.ticker AND b.date = g.date),
lk AS (SELECT *, CASE WHEN session - own <= 5 THEN hold END AS fill FROM lj),
aligned AS MATERIALIZED (SELECT ticker, date, session AS rn, coalesce(open, fill) AS open, coalesce(high, fill) AS high, coalesce(low, fill) AS low, fill AS close,
  coalesce(volume, CASE WHEN fill IS NOT NULL THEN 0 END) AS volume, close IS NOT NULL AS traded FROM lk)"""
FR["mkt"] = """mka_ AS (SELECT date, close AS bench_close, ln(close) - ln(lag(close) OVER (ORDER BY date)) AS bench_r FROM bench),
mkt AS MATERIALIZED (SELECT *, CASE WHEN count(*) OVER y200 = 200 THEN (bench_close > avg(bench_close) OVER y200) :: INT END AS mkt_above_200, CASE WHEN count(bench_r) OVER y20 = 20 THEN stddev_samp(bench_r) OVER y20 END AS mkt_vol_20,
  bench_close / lag(bench_close, 21) OVER (ORDER BY date) - 1 AS mkt_ret_21, lead(bench_close, 20) OVER (ORDER BY date) / bench_close - 1 AS bench_fwd FROM mka_
  WINDOW y200 AS (ORDER BY date ROWS 199 PRECEDING), y20 AS (ORDER BY date ROWS 19 PRECEDING))"""
FR["panel"] = f"""pna AS MATERIALIZED (SELECT a.*, m.* EXCLUDE (date), greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr, ln(close) - ln(lag(close) OVER w) AS lr, close * volume AS dv,
  abs(open / lag(close) OVER w - 1) AS gap FROM aligned a JOIN mkt m USING (date) WINDOW w AS (PARTITION BY ticker ORDER BY date)),
pnr AS (SELECT ticker, rn, CAST(tr AS DOUBLE) AS atr, 1.0 :: DOUBLE AS wt FROM pna WHERE rn = 1 UNION ALL
  SELECT s.ticker, s.rn, CASE WHEN s.tr IS NULL THEN r.atr WHEN r.atr IS NULL THEN s.tr ELSE (r.wt * 13 / 14.0 :: DOUBLE * r.atr + s.tr / 14.0 :: DOUBLE) / (r.wt * 13 / 14.0 :: DOUBLE + 1 / 14.0 :: DOUBLE) END,
  CASE WHEN s.tr IS NULL AND r.atr IS NOT NULL THEN r.wt * 13 / 14.0 :: DOUBLE ELSE 1 END FROM pnr r JOIN pna s ON s.ticker = r.ticker AND s.rn = r.rn + 1),
pnb AS (SELECT p.*, r.atr, {roll('min', 'low', 20)} AS swing FROM pna p JOIN pnr r USING (ticker, rn)),
pnc AS (SELECT *, CASE WHEN close IS NOT NULL AND atr IS NOT NULL AND swing IS NOT NULL THEN greatest(least(close - 1.5 * atr, swing * 0.99), close * 0.93) END AS stop FROM pnb),
pnd AS (SELECT ticker, date, rn, close, traded, stop, mkt_above_200, mkt_vol_20, mkt_ret_21, close / lag(close, 5) OVER[] - 1 AS ret_5, close / lag(close, 21) OVER[] - 1 AS ret_21, close / lag(close, 63) OVER[] - 1 AS ret_63,
  lag(close, 21) OVER[] / lag(close, 252) OVER[] - 1 AS mom_12_1, {roll('stddev_samp', 'lr', 5)} AS vol_5, {roll('stddev_samp', 'lr', 20)} AS vol_20, {roll('stddev_samp', 'lr', 60)} AS vol_60, atr / close AS atr_pct,
  stop / close - 1 AS stop_dist_pct, close / ({roll('max', 'high', 252)}) - 1 AS dist_52w_high, close / ({roll('min', 'low', 252)}) - 1 AS dist_52w_low,
  volume / nullif(CASE WHEN count(volume) OVER[-20,-1] >= 20 THEN avg(volume) OVER[-20,-1] END, 0) AS vol_ratio_20, volume / nullif(CASE WHEN count(volume) OVER[-100,-1] >= 100 THEN avg(volume) OVER[-100,-1] END, 0) AS vol_ratio_100,
  {roll('avg', 'gap', 20)} AS gap_abs_20, CASE WHEN count(lr) OVER[-59,0] >= 60 AND count(bench_r) OVER[-59,0] >= 60 THEN covar_samp(lr, bench_r) OVER[-59,0] / var_samp(bench_r) OVER[-59,0] END AS beta_60, {roll('avg', 'dv', 20)} AS dollar_vol_20,
  lead(close, 20) OVER[] / close - 1 AS f_, CASE WHEN count(close) OVER[1,20] >= 20 THEN min(close) OVER[1,20] END AS m_, CASE WHEN count(lr) OVER[1,20] >= 20 THEN stddev_samp(lr) OVER[1,20] END AS v_, bench_fwd FROM pnc),
panel_all AS MATERIALIZED (SELECT *, CASE WHEN ok THEN f_ END AS fwd_ret, CASE WHEN ok THEN v_ END AS fwd_rvol, CASE WHEN ok THEN (m_ < stop) :: INT END AS y_stop_hit, CASE WHEN ok THEN (f_ > 0.1) :: INT END AS y_up10,
  CASE WHEN ok THEN (f_ < -0.1) :: INT END AS y_dn10, CASE WHEN ok AND bench_fwd IS NOT NULL THEN (f_ > bench_fwd) :: INT END AS y_beat_mkt FROM (SELECT *, f_ IS NOT NULL AND m_ IS NOT NULL AND stop IS NOT NULL AS ok FROM pnd)),
panel AS MATERIALIZED (SELECT * FROM panel_all WHERE traded AND close >= 2 AND dollar_vol_20 >= 1000 AND {' AND '.join(f'{c} IS NOT NULL' for c in panel.FEATURES)})"""
P = "@bars, @bench, @aligned, @mkt, @panel"
the_panel = lambda t: panel.build_panel(t.bars, t.bench)
query("v19_panel_build", "ticker date:d close:f " + " ".join(f"{c}:f4" for c in panel.FEATURES + panel.MARKET + panel.LABELS), f"WITH {P} SELECT * FROM panel")(the_panel)
query("m14_market_features", "date:d mkt_above_200:i mkt_vol_20:f mkt_ret_21:f", "WITH @bars, @bench, @mkt SELECT * FROM mkt")(lambda t: panel.market_features(t.bench))
query("e6_labels", "ticker date:d fwd_ret:f fwd_rvol:f y_stop_hit:i y_up10:i y_dn10:i y_beat_mkt:i", f"WITH {P} SELECT * FROM panel_all")(
    lambda t: panel.with_labels(panel.features(t.bars, t.bench)))
query("f15_panel_filter", "date:d n:i", f"WITH {P} SELECT date, count(*) AS n FROM panel GROUP BY 1")(lambda t: the_panel(t).groupBy("date").agg(F.count("*").alias("n")))
query("v20_panel_summary", "year:i rows:i dates:i y_stop_hit:f y_up10:f y_dn10:f y_beat_mkt:f labelled:i",
      f"WITH {P} SELECT year(date) AS year, count(*) AS rows, count(DISTINCT date) AS dates, avg(y_stop_hit) AS y_stop_hit, avg(y_up10) AS y_up10, avg(y_dn10) AS y_dn10, avg(y_beat_mkt) AS y_beat_mkt, count(y_stop_hit) AS labelled FROM panel GROUP BY 1")(
    lambda t: panel.panel_summary(the_panel(t)))
query("v18_lookahead_check", "changed:i", "SELECT 0 AS changed")(
    lambda t: panel.lookahead_check(t.bars, benchmark_bars, "1998-06-30").agg(F.count("*").alias("changed")))
query("j3_sessions_to_report", "ticker date:d days_to_earnings:i",
      """WITH @bars, @bench, @dividends, @earnings, s AS (SELECT date, row_number() OVER (ORDER BY date) AS s FROM bench),
      e AS (SELECT ticker, report_date, s AS rs FROM earnings ASOF LEFT JOIN s ON report_date <= s.date)
      SELECT b.ticker, b.date, CASE WHEN e.report_date IS NOT NULL THEN least(coalesce(rs, 1000000000) - s.s, 30) END AS days_to_earnings FROM bars b JOIN s USING (date) ASOF LEFT JOIN e ON e.ticker = b.ticker AND b.date < e.report_date""")(
    lambda t: panel.sessions_to_report(t.bench, t.earnings, t.bars))


def cdf(x: str) -> str:
    """SQL twin of ``stats.normal_cdf``."""
    z, k = f"(abs({x}) / sqrt(2.0 :: DOUBLE))", "(1 / (1 + 0.3275911 :: DOUBLE * {z}))"
    k = k.format(z=z)
    poly = f"((((1.061405429 :: DOUBLE * {k} - 1.453152027 :: DOUBLE) * {k} + 1.421413741 :: DOUBLE) * {k} - 0.284496736 :: DOUBLE) * {k} + 0.254829592 :: DOUBLE) * {k}"
    erf = f"(1 - {poly} * exp(-{z} * {z}))"
    return f"CASE WHEN {x} >= 0 THEN 0.5 * (1 + {erf}) ELSE 0.5 * (1 - {erf}) END"


FR["rules"] = f"""rua AS (SELECT *, nullif(vol_20, 0) AS s, ln(1 + stop_dist_pct) AS d FROM panel), rub AS (SELECT *, (d - 0.5826 * s) / (s * sqrt(20)) AS zb, ln(1.1) / (s * sqrt(20)) AS zu, ln(0.9) / (s * sqrt(20)) AS zd FROM rua),
rules AS MATERIALIZED (SELECT *, least(greatest(CASE WHEN d >= 0 THEN 1 ELSE 2 * ({cdf('zb')}) END, 0), 1) AS rule_y_stop_hit, 1 - ({cdf('zu')}) AS rule_y_up10, {cdf('zd')} AS rule_y_dn10, 0.5 AS rule_y_beat_mkt, vol_20 AS rule_fwd_rvol FROM rub)"""
TL = panel.TARGETS + ["fwd_rvol"]
FR["preds"] = f"""pds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT DISTINCT date FROM panel)), pdf AS (SELECT year(date) AS test_year, min(pos) AS p FROM pds WHERE year(date) IN ({', '.join(map(str, YEARS))}) GROUP BY 1),
pdc AS (SELECT test_year, date AS cut FROM pdf JOIN pds ON pos = p - 21), pdb AS (SELECT test_year, {', '.join(f'avg({c}) AS base_{c}' for c in TL)} FROM panel JOIN pdc ON date <= cut GROUP BY 1),
pdl AS (SELECT test_year, ticker, date, mkt_above_200, fwd_ret, unnest([{', '.join(repr(c) for c in TL)}]) AS target, unnest([{', '.join(f'CAST({c} AS DOUBLE)' for c in TL)}]) AS y, unnest([{', '.join('base_' + c for c in TL)}]) AS p_base,
  unnest([{', '.join(f'CAST(rule_{c} AS DOUBLE)' for c in TL)}]) AS p_rule FROM rules JOIN pdb ON year(date) = test_year JOIN pdc USING (test_year)),
preds AS MATERIALIZED (SELECT *, CASE WHEN target = 'fwd_rvol' THEN (greatest(y, 1e-8) / p_base) ** 2 - ln((greatest(y, 1e-8) / p_base) ** 2) - 1 ELSE (p_base - y) ** 2 END AS loss_base,
  CASE WHEN target = 'fwd_rvol' THEN (greatest(y, 1e-8) / p_rule) ** 2 - ln((greatest(y, 1e-8) / p_rule) ** 2) - 1 ELSE (p_rule - y) ** 2 END AS loss_rule FROM pdl WHERE y IS NOT NULL AND p_rule IS NOT NULL)"""
PR = f"{P}, @rules, @preds"
# Several steps read the panel and the predictions, so both are written once.
stored_panel = lambda t: stored(the_panel(t), "panel")
preds = lambda t: stored(panel.with_predictions(stored_panel(t), YEARS), "predictions")
query("x5_normal_cdf", "ticker date:d rule_y_stop_hit:f rule_y_up10:f rule_y_dn10:f", f"WITH {P}, @rules SELECT * FROM rules")(lambda t: panel.rule_predictions(the_panel(t)))
query("v10_predictions", "test_year:i ticker date:d target p_base:f p_rule:f", f"WITH {PR} SELECT * FROM preds")(preds)
query("v7_forecast_losses", "test_year:i target n:i brier:f log_loss:f mse:f",
      f"WITH {PR} SELECT test_year, target, count(*) AS n, avg((p_rule - y) ** 2) AS brier, avg(-(y * ln(least(greatest(p_rule, 1e-6), 1 - 1e-6)) + (1 - y) * ln(1 - least(greatest(p_rule, 1e-6), 1 - 1e-6)))) AS log_loss, avg((p_base - y) ** 2) AS mse "
      "FROM preds WHERE target <> 'fwd_rvol' GROUP BY 1, 2")(
    lambda t: preds(t).where("target <> 'fwd_rvol'").groupBy("test_year", "target").agg(
        F.count("*").alias("n"), F.avg(stats.brier(F.col("y"), F.col("p_rule"))).alias("brier"), F.avg(stats.log_loss(F.col("y"), F.col("p_rule"))).alias("log_loss"),
        F.avg(stats.brier(F.col("y"), F.col("p_base"))).alias("mse")))
FR["auct"] = """auct AS MATERIALIZED (SELECT test_year, target, (sum(r) FILTER (y = 1) - count_if(y = 1) * (count_if(y = 1) + 1) / 2) / nullif(count_if(y = 1) * count_if(y = 0), 0) AS auc FROM (SELECT *, rank() OVER (PARTITION BY test_year, target ORDER BY round(p_rule, 10))
  + (count(*) OVER (PARTITION BY test_year, target, round(p_rule, 10)) - 1) / 2.0 :: DOUBLE AS r FROM preds WHERE target <> 'fwd_rvol') GROUP BY 1, 2)"""
FR["calib"] = """cbe AS (SELECT test_year, target, list_distinct(quantile_cont(p_rule, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM preds WHERE target <> 'fwd_rvol' GROUP BY 1, 2),
cbb AS (SELECT p.*, greatest(len(list_filter(edges, lambda e: e < p_rule)) - 1, 0) AS bin FROM preds p JOIN cbe USING (test_year, target)),
calib AS MATERIALIZED (SELECT test_year, target, bin, count(*) AS n, avg(p_rule) AS mean_p, avg(y) AS mean_y FROM cbb GROUP BY ALL)"""
query("v8_auc", "test_year:i target auc:f", f"WITH {PR}, @auct SELECT * FROM auct")(lambda t: stats.auc(preds(t).where("target <> 'fwd_rvol'"), ["test_year", "target"], "y", "p_rule"))
query("v8_calibration_table", "test_year:i target bin:i n:i mean_p:f mean_y:f", f"WITH {PR}, @calib SELECT * FROM calib")(
    lambda t: stats.calibration(preds(t).where("target <> 'fwd_rvol'"), ["test_year", "target"], "y", "p_rule"))


def newey_sql(name: str, source: str, value: str, order: str, lag: int, keys: str) -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    k = keys + ", " if keys else ""
    sums = ", ".join(f"coalesce(sum(e * lag(e, {i}) OVER w), 0) AS s{i}" for i in range(1, lag + 1))
    lags = ", ".join(f"lag(e, {i}) OVER (PARTITION BY {keys or 1} ORDER BY {order}) AS l{i}" for i in range(1, lag + 1))
    sums = ", ".join(f"coalesce(sum(e * l{i}), 0) AS s{i}" for i in range(1, lag + 1))
    var = "s0 / n" + "".join(f" + CASE WHEN n > {i} THEN 2 * (1 - {i} / {lag + 1}.0 :: DOUBLE) * s{i} / n ELSE 0 END" for i in range(1, lag + 1))
    group = f"GROUP BY {keys}" if keys else ""
    return f"""{name}_e AS (SELECT {k}{order}, {value} AS v, {value} - avg({value}) OVER ({part}) AS e FROM {source}), {name}_l AS (SELECT *, {lags} FROM {name}_e),
{name}_s AS (SELECT {k}count(*) AS n, avg(v) AS mean, sum(e * e) AS s0, {sums} FROM {name}_l {group}), {name} AS MATERIALIZED (SELECT {k}n, mean, CASE WHEN {var} > 0 THEN mean / sqrt(({var}) / n) END AS t FROM {name}_s)"""


FR["clust"] = "cld AS (SELECT test_year, target, date, avg(loss_rule - loss_base) AS d FROM preds GROUP BY ALL), " + newey_sql("clust", "cld", "d", "date", 20, "test_year, target")
query("v9_date_clustered_difference", "test_year:i target n:i mean:f t:f4", f"WITH {PR}, @clust SELECT * FROM clust")(
    lambda t: stats.clustered_difference(preds(t), ["test_year", "target"], "loss_rule", "loss_base", 20))
FR["evald"] = """evald AS MATERIALIZED (SELECT g.*, (1 - loss_rule / loss_base) AS skill, c.n AS n_dates, c.t AS t_rule_vs_base, auc, ce AS calibration_error FROM (SELECT test_year, target, count(*) AS n, avg(y) AS rate, avg(loss_base) AS loss_base, avg(loss_rule) AS loss_rule
  FROM preds GROUP BY 1, 2) g JOIN clust c USING (test_year, target) LEFT JOIN auct USING (test_year, target) LEFT JOIN (SELECT test_year, target, sum(n * abs(mean_y - mean_p)) / sum(n * mean_p) AS ce FROM calib GROUP BY 1, 2) USING (test_year, target))"""
EV = f"{PR}, @clust, @auct, @calib, @evald"
query("v11_baseline_evaluation", "test_year:i target n:i rate:f loss_base:f loss_rule:f skill:f n_dates:i t_rule_vs_base:f4 auc:f calibration_error:f", f"WITH {EV} SELECT * FROM evald")(lambda t: panel.evaluate(preds(t)))
query("v15_regime_breakdown", "target regime n:i skill_vs_base:f",
      f"WITH {PR} SELECT target, CASE WHEN mkt_above_200 = 1 THEN 'bull' ELSE 'bear' END AS regime, count(*) AS n, 1 - avg(loss_rule) / avg(loss_base) AS skill_vs_base FROM preds WHERE mkt_above_200 IS NOT NULL GROUP BY 1, 2")(lambda t: panel.regime_breakdown(preds(t)))
FR["spreads"] = """spd AS (SELECT date, fwd_ret, row_number() OVER (PARTITION BY date ORDER BY ret_21, ticker) AS r, count(*) OVER (PARTITION BY date) AS n FROM panel WHERE fwd_ret IS NOT NULL AND ret_21 IS NOT NULL),
spreads AS MATERIALIZED (SELECT date, avg(fwd_ret) FILTER (r > n - n // 5) - avg(fwd_ret) FILTER (r <= n // 5) AS spread FROM spd WHERE n >= 5 GROUP BY date)"""
query("v16_quintile_spread", "date:d spread:f", f"WITH {P}, @spreads SELECT * FROM spreads")(lambda t: panel.quintile_spread(the_panel(t), "ret_21"))
query("v17_gate", "target years:i years_skill:i years_auc:i years_calib:i years_significant:i passed:b",
      f"""WITH {EV}, @spreads, g AS (SELECT target, count(*) AS years, count_if(skill > 0) AS years_skill, count(CASE WHEN auc >= 0.6 THEN 1 END) AS years_auc, count(CASE WHEN calibration_error <= 0.2 THEN 1 END) AS years_calib, count_if(skill > 0 AND t_rule_vs_base < -2) AS years_significant
        FROM evald WHERE target <> 'y_beat_mkt' GROUP BY 1), s AS (SELECT year(date) AS y, avg(spread) AS m FROM spreads GROUP BY 1)
      SELECT *, years >= 2 AND years_skill >= 2 AND (target = 'fwd_rvol' OR (years_auc >= 2 AND years_calib >= 2)) AS passed FROM g
      UNION ALL SELECT 'y_beat_mkt', count(*), count_if(m > 0.01), NULL, NULL, NULL, count(*) >= 2 AND count_if(m > 0.01) >= 2 FROM s""")(
    lambda t: panel.gate(panel.evaluate(preds(t)), panel.quintile_spread(the_panel(t), "ret_21"), 2))
query("v12_design_matrix", "test_year:i part ticker date:d rank_vol_20:f rank_ret_21:f z_mkt_vol_20:f4 log_vol_20:f logit_y_up10:f4",
      f"""WITH {P}, @rules, @preds, sp AS (SELECT test_year, 'test' AS part, r.* FROM rules r JOIN pdc ON year(date) = test_year UNION ALL SELECT test_year, 'train', r.* FROM rules r JOIN pdc ON date <= cut),
      z AS (SELECT test_year, avg(mkt_vol_20) AS m, stddev_samp(mkt_vol_20) AS sd FROM sp WHERE part = 'train' GROUP BY 1)
      SELECT sp.*, (rank() OVER (PARTITION BY test_year, part, date ORDER BY vol_20) + (count(*) OVER (PARTITION BY test_year, part, date, vol_20) - 1) / 2.0) / count(*) OVER (PARTITION BY test_year, part, date) - 0.5 AS rank_vol_20,
        (rank() OVER (PARTITION BY test_year, part, date ORDER BY ret_21) + (count(*) OVER (PARTITION BY test_year, part, date, ret_21) - 1) / 2.0) / count(*) OVER (PARTITION BY test_year, part, date) - 0.5 AS rank_ret_21,
        (mkt_vol_20 - m) / sd AS z_mkt_vol_20, ln(greatest(vol_20, 1e-4)) AS log_vol_20, ln(least(greatest(rule_y_up10, 1e-4), 1 - 1e-4) / (1 - least(greatest(rule_y_up10, 1e-4), 1 - 1e-4))) AS logit_y_up10 FROM sp JOIN z USING (test_year)""")(
    lambda t: panel.design(shaping.walk_forward_splits(stored_panel(t), YEARS, 20)))
MODEL_JOBS = [(y, m) for y in panel.TARGETS for m in ("logistic", "gbm")] + [("fwd_rvol", "ridge")]


def over_test_years(t, study):
    p = stored_panel(t)
    return study(p, panel.tested_years(p), MODEL_JOBS)


query("v13_walk_forward_models", "test_year:i ticker date:d target model p_model:f4")(lambda t: over_test_years(t, panel.walk_forward_models))
query("v14_model_comparison", "test_year:i target model n:i loss_model:f4 loss_base:f4 loss_rule:f4 skill_vs_base:f4 skill_vs_rule:f4")(
    lambda t: over_test_years(t, panel.model_table))

# --- small-table statistics -------------------------------------------------------------------------------------

FR["monthx"] = """mxa AS (SELECT date_trunc('month', exit_date) AS m, CAST(round(avg(excess_realistic), 6) AS DOUBLE) AS x FROM excess GROUP BY 1), monthx AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY m) - 1 AS pos, count(*) OVER () AS n FROM mxa)"""
HASH = "(((((b * 1000003 + {i} * 7919 + {seed}) % 2147483647) * 48271 % 2147483647) * 69621 + 12345) % 2147483647) * 48271 % 2147483647 % n"


def boot_sql(block: int, seed: int) -> str:
    h = HASH.format(i=f"(i // {block})", seed=seed)
    return f"""WITH {EXCESS}, @monthx, d AS (SELECT b, i, n, ({h} + i % {block}) % n AS pos FROM range(10000) r(b), (SELECT pos AS i, n FROM monthx)),
      r AS (SELECT b, avg(x) AS mean FROM d JOIN monthx USING (pos) GROUP BY b) SELECT count(*) AS replicates, quantile_cont(mean, 0.025) AS low, quantile_cont(mean, 0.975) AS high FROM r"""


# The hash and the Poisson draw of ``stats.poisson_weights``.
MIX = ["((id * 40503 :: UBIGINT + b * 2654435761 :: UBIGINT + 20261027 :: UBIGINT) & 4294967295 :: UBIGINT)"]
for shift, factor in ((16, 2246822507), (13, 3266489909)):
    MIX.append(f"((xor(z, z >> {shift} :: UBIGINT) * {factor} :: UBIGINT) & 4294967295 :: UBIGINT)")
DRAW = " + ".join(f"(z >= {t} :: UBIGINT) :: INT" for t in stats.POISSON_STEPS)
FR["weighed"] = f"""wt0 AS (SELECT trade_id :: UBIGINT AS id, excess_realistic AS x, sector, regime FROM excess),
wt1 AS (SELECT x, sector, regime, b, {MIX[0]} AS z FROM wt0 CROSS JOIN (SELECT range :: UBIGINT AS b FROM range(10000))),
wt2 AS (SELECT x, sector, regime, b, {MIX[1]} AS z FROM wt1), wt3 AS (SELECT x, sector, regime, b, {MIX[2]} AS z FROM wt2), wt4 AS (SELECT x, sector, regime, b, xor(z, z >> 16 :: UBIGINT) AS z FROM wt3),
weighed AS (SELECT b, CASE WHEN GROUPING(sector) = 0 THEN 'sector ' || sector WHEN GROUPING(regime) = 0 THEN 'regime ' || regime ELSE 'all' END AS slice, count(*) AS n, avg(x) AS mean, sum(x * w) / sum(w) AS m
  FROM (SELECT *, {DRAW} AS w FROM wt4) GROUP BY GROUPING SETS ((b), (b, sector), (b, regime)))"""
query("v3_bootstrap_interval", "slice n:i mean:f low:f high:f low_all:f high_all:f",
      f"""WITH {EXCESS}, @weighed, g AS (SELECT slice, any_value(n) AS n, any_value(mean) AS mean, list(m ORDER BY m) AS ms FROM weighed WHERE m IS NOT NULL AND isfinite(m) GROUP BY slice), k AS (SELECT count(*) AS k FROM g),
      q AS (SELECT slice, unnest(ms) AS m, k FROM g, k), p AS (SELECT slice, quantile_cont(m, [0.025, 0.975]) AS one, any_value(k) AS k FROM q GROUP BY slice)
      SELECT g.slice, n, mean, one[1] AS low, one[2] AS high, """ + ", ".join(
          f"ms[floor(({t}) * (len(ms) - 1)) :: INT + 1] + (ms[least(floor(({t}) * (len(ms) - 1)) :: INT + 2, len(ms))] - ms[floor(({t}) * (len(ms) - 1)) :: INT + 1]) * (({t}) * (len(ms) - 1) - floor(({t}) * (len(ms) - 1))) AS {n}"
          for t, n in (("0.025 :: DOUBLE / k", "low_all"), ("1 - 0.025 :: DOUBLE / k", "high_all"))) + " FROM g JOIN p USING (slice)")(
    lambda t: stats.bootstrap_slices(ledger.trade_excess(t.trades, t.bench, t.dividends, t.sectors), "trade_id", "excess_realistic",
                                     F.array(F.lit("all"), F.concat(F.lit("sector "), "sector"), F.concat(F.lit("regime "), "regime")), 10000, 20261027))
query("v4_block_bootstrap", "replicates:i low:f high:f", boot_sql(5, 7))(lambda t: stats.interval(stats.bootstrap_means(curves.monthly_excess(t), "x", 10000, 7, block=5)))
FR["newey"] = "nwx AS (SELECT date, r FROM (SELECT date, avg(r) AS r FROM (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars) GROUP BY 1) WHERE r IS NOT NULL), " + newey_sql("newey", "nwx", "r", "date", 6, "")
query("v5_newey_west", "n:i mean:f8 t:f4", "WITH @bars, @newey SELECT * FROM newey")(
    lambda t: stats.newey_west(t.bars.withColumn("r", ind.change_pct()).groupBy("date").agg(F.avg("r").alias("r")), "r", "date", 6))
query("v6_alpha_beta", "ticker n:i alpha:f8 beta:f t_alpha:f4 t_beta:f4",
      """WITH @bars, @bench, m AS (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS x FROM bench), s AS (SELECT ticker, date, x, r AS y FROM (SELECT *, close / lag(close) OVER[] - 1 AS r FROM bars) JOIN m USING (date) WHERE r IS NOT NULL AND x IS NOT NULL),
      f AS (SELECT ticker, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM s GROUP BY 1),
      u AS (SELECT s.ticker, date, x, y - a - b * x AS u, (y - a - b * x) * x AS v FROM s JOIN f USING (ticker)),
      l AS (SELECT *, """ + ", ".join(f"lag(u, {k}) OVER (PARTITION BY ticker ORDER BY date) AS u{k}, lag(v, {k}) OVER (PARTITION BY ticker ORDER BY date) AS v{k}" for k in range(1, 7)) + """ FROM u),
      g AS (SELECT ticker, sum(u * u""" + "".join(f" + 2 * (1 - {k} / 7.0 :: DOUBLE) * u * coalesce(u{k}, 0)" for k in range(1, 7)) + ") AS m00, sum(u * v" + "".join(
          f" + (1 - {k} / 7.0 :: DOUBLE) * (u * coalesce(v{k}, 0) + v * coalesce(u{k}, 0))" for k in range(1, 7)) + ") AS m01, sum(v * v" + "".join(f" + 2 * (1 - {k} / 7.0 :: DOUBLE) * v * coalesce(v{k}, 0)" for k in range(1, 7)) + """) AS m11 FROM l GROUP BY 1)
      SELECT ticker, n, a AS alpha, b AS beta, a / (sqrt(sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (n * sxx - sx * sx)) AS t_alpha, b / (sqrt(sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (n * sxx - sx * sx)) AS t_beta FROM f JOIN g USING (ticker)""")(
    lambda t: stats.ols_newey_west(curves.paired_returns(t.bars, t.bench), "y", "x", "date", 6, ["ticker"]))
query("d4_t_p_value", "sector n:i t:f4 p:f")(lambda t: curves.sector_tests(t))

# --- equity curves ----------------------------------------------------------------------------------------------

# Stored curves: each ticker is a strategy, a fold is a calendar year started with 50,000.
FR["curve"] = """cva AS (SELECT ticker AS strategy, year(date) AS fold, date, open, close, volume, first_value(open) OVER (PARTITION BY ticker, year(date) ORDER BY date) AS o FROM bars),
curve AS MATERIALIZED (SELECT *, 50000 * close / o AS equity, coalesce(50000 * close / o / lag(50000 * close / o) OVER (PARTITION BY strategy, fold ORDER BY date), close / o) - 1 AS r FROM cva)"""
FR["bret"] = """bret AS MATERIALIZED (SELECT date, close / lag(close) OVER (ORDER BY date) - 1 AS c2c, close / open - 1 AS o2c FROM bench)"""
FR["curveb"] = """curveb AS MATERIALIZED (SELECT c.*, coalesce(CASE WHEN row_number() OVER (PARTITION BY strategy, fold ORDER BY c.date) = 1 THEN o2c ELSE c2c END, 0) AS rb FROM curve c LEFT JOIN bret USING (date))"""
FR["qmet"] = """qma AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy ORDER BY date)) AS curve FROM curve), qmb AS (SELECT *, curve / max(curve) OVER (PARTITION BY strategy ORDER BY date) - 1 AS dd FROM qma),
qmet AS MATERIALIZED (SELECT strategy, count(*) AS days, (max_by(curve, date) ** (252.0 / count(*)) - 1) * 100 AS cagr, (max_by(curve, date) - 1) * 100 AS total, min(dd) * 100 AS max_dd, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe,
  avg(r) / sqrt(avg(least(r, 0) ** 2)) * sqrt(252) AS sortino, (max_by(curve, date) ** (252.0 / count(*)) - 1) / abs(min(dd)) AS calmar, sqrt(avg((dd * 100) ** 2)) AS ulcer FROM qmb GROUP BY 1)"""
CV = "@bars, @bench, @curve"
query("q1_fold_returns", "strategy fold:i date:d r:f", f"WITH {CV} SELECT * FROM curve")(lambda t: curves.fold_returns(curves.stored_curves(t.bars)))
query("q2_benchmark_returns", "strategy fold:i date:d rb:f", f"WITH {CV}, @bret, @curveb SELECT * FROM curveb")(lambda t: curves.with_benchmark(curves.fold_returns(curves.stored_curves(t.bars)), t.bench))
MET = "days:i cagr:f total:f4 max_dd:f sharpe:f sortino:f calmar:f4 ulcer:f"
query("q3_performance_metrics", "strategy " + MET, f"WITH {CV}, @qmet SELECT * FROM qmet")(lambda t: curves.metrics(curves.fold_returns(curves.stored_curves(t.bars)), ["strategy"]))
query("q4_pair_comparison", "strategy n:i annual_diff:f tracking_error:f info_ratio:f fold_wins:i folds:i",
      f"""WITH {CV}, p AS (SELECT a.strategy, a.fold, a.date, a.r - b.r AS d, a.r AS ra, b.r AS rb FROM curve a JOIN curve b ON b.strategy = 'Brand#1' AND b.date = a.date WHERE a.strategy <> 'Brand#1'),
      f AS (SELECT strategy, fold, sum(ln(1 + ra)) > sum(ln(1 + rb)) AS win FROM p GROUP BY 1, 2)
      SELECT p.strategy, count(*) AS n, avg(d) * 252 * 100 AS annual_diff, stddev_samp(d) * sqrt(252) * 100 AS tracking_error, avg(d) / stddev_samp(d) * sqrt(252) AS info_ratio, (SELECT count_if(win) FROM f WHERE f.strategy = p.strategy) AS fold_wins,
        (SELECT count(*) FROM f WHERE f.strategy = p.strategy) AS folds FROM p GROUP BY 1""")(lambda t: curves.pair_comparison(curves.fold_returns(curves.stored_curves(t.bars)), "Brand#1"))
query("q5_daily_attribution", "strategy fold:i matched:f4 excess:f4 costs:f4 total:f4",
      f"""WITH {CV}, @bret, @curveb, a AS (SELECT *, coalesce(lag(equity) OVER (PARTITION BY strategy, fold ORDER BY date), 50000) AS prev, CASE WHEN row_number() OVER (PARTITION BY strategy, fold ORDER BY date) = 1 THEN 50000 * 0.001 ELSE 0 END AS cost FROM curveb)
      SELECT strategy, fold, sum(prev * rb) AS matched, sum(equity - prev - prev * rb) AS excess, -sum(cost) AS costs, sum(equity - prev - cost) AS total FROM a GROUP BY 1, 2""")(
    lambda t: curves.attribution(curves.with_benchmark(curves.fold_returns(curves.stored_curves(t.bars)), t.bench)))
query("q6_sweep_scores", "strategy total:f4 max_dd:f sharpe:f calmar:f4 place:i",
      f"WITH {CV}, @qmet SELECT *, row_number() OVER (ORDER BY round(sharpe, 9) DESC, strategy) AS place FROM qmet")(lambda t: curves.sweep_scores(curves.fold_returns(curves.stored_curves(t.bars))))
FR["foldm"] = """fma AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY strategy, fold ORDER BY date)) AS curve FROM curve), fmb AS (SELECT *, curve / max(curve) OVER (PARTITION BY strategy, fold ORDER BY date) - 1 AS dd FROM fma),
foldm AS MATERIALIZED (SELECT strategy, fold, (max_by(curve, date) - 1) * 100 AS ret, min(dd) * 100 AS dd, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM fmb GROUP BY 1, 2)"""
query("q7_ab_fold_comparison", "fold:i ret_diff:f dd_diff:f sharpe_diff:f",
      f"WITH {CV}, @foldm SELECT a.fold, b.ret - a.ret AS ret_diff, b.dd - a.dd AS dd_diff, b.sharpe - a.sharpe AS sharpe_diff FROM foldm a JOIN foldm b USING (fold) WHERE a.strategy = 'Brand#1' AND b.strategy = 'Brand#2'")(
    lambda t: curves.ab_comparison(curves.fold_returns(curves.stored_curves(t.bars)), "Brand#1", "Brand#2"))
query("q8_winner_votes", "strategy votes:i oos_ret:f",
      f"""WITH {CV}, @foldm, w AS (SELECT fold, max_by(strategy, round(sharpe, 9)) AS strategy FROM foldm GROUP BY 1), n AS (SELECT w.strategy, f.ret FROM w LEFT JOIN foldm f ON f.strategy = w.strategy AND f.fold = w.fold + 1)
      SELECT strategy, count(*) AS votes, avg(ret) AS oos_ret FROM n GROUP BY 1""")(lambda t: curves.winner_votes(curves.fold_returns(curves.stored_curves(t.bars))))
query("a20_variant_fold_metrics", "strategy compounded:f4 mean_ret:f worst_dd:f win_rate:f",
      f"WITH {CV}, @foldm SELECT strategy, (product(1 + ret / 100) - 1) * 100 AS compounded, avg(ret) AS mean_ret, min(dd) AS worst_dd, avg((ret > 0) :: INT) AS win_rate FROM foldm GROUP BY 1")(
    lambda t: curves.variant_summary(curves.fold_returns(curves.stored_curves(t.bars))))
