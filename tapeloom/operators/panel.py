"""Stock-day panel, forecasts and their evaluation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.recursive import averages_with_gaps, wilder
from tapeloom.operators import forecasters, stats
from tapeloom.operators.asof import asof_join
from tapeloom.operators.scans import benchmark_returns
from tapeloom.operators.shaping import align_to_calendar, walk_forward_splits

# Feature, market and label columns of the panel.
FEATURES = ["ret_5", "ret_21", "ret_63", "mom_12_1", "vol_5", "vol_20", "vol_60", "atr_pct", "stop_dist_pct", "dist_52w_high", "dist_52w_low",
            "vol_ratio_20", "vol_ratio_100", "gap_abs_20", "beta_60"]
MARKET = ["mkt_above_200", "mkt_vol_20", "mkt_ret_21"]
LABELS = ["fwd_ret", "fwd_rvol", "y_stop_hit", "y_up10", "y_dn10", "y_beat_mkt"]
TARGETS = ["y_stop_hit", "y_up10", "y_dn10", "y_beat_mkt"]
HORIZON = 20
THRESHOLD = 0.10
BARRIER_BETA = 0.5826


def market_features(bench: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    m = benchmark_returns(bench).withColumnRenamed("close", "bench_close")
    sma = ind.sma("bench_close", 200, w)
    return m.select(
        "date", "bench_close", "bench_r", F.when(sma.isNotNull(), (F.col("bench_close") > sma).cast("double")).alias("mkt_above_200"),
        ind.rolling_std("bench_r", 20, w).alias("mkt_vol_20"), (ind.ratio("bench_close", ind.lag("bench_close", 21, w)) - 1).alias("mkt_ret_21"),
        (ind.ratio(F.lead("bench_close", HORIZON).over(w), "bench_close") - 1).alias("bench_fwd"))


def sessions_to_report(sessions: DataFrame, earnings: DataFrame, tickers: DataFrame, clip: int = 30) -> DataFrame:
    """For each ticker and session, sessions until the next report strictly after it, clipped.

    The window runs over (ticker, session) rows: one report counts once per session.
    """
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = sessions.select("date").distinct().withColumn("s", F.row_number().over(w))
    mapped = asof_join(earnings, cal.select(F.col("date").alias("d"), "s"), None, "report_date", "d", {"s": "report_s"}, direction="forward")
    rows = tickers.select("ticker", "date").join(cal, "date")
    return asof_join(rows, mapped.withColumn("report_s", F.coalesce("report_s", F.lit(10**9))), "ticker", "date", "report_date",
                     {"report_s": "report_s"}, direction="forward", strict=True).select(
        "ticker", "date", F.when(F.col("report_s").isNotNull(), F.least(F.col("report_s") - F.col("s"), F.lit(clip))).alias("days_to_earnings"))


def stop_level(c: Column, atr: Column, swing: Column) -> Column:
    raw = F.least(c - 1.5 * atr, swing * 0.99)
    return F.when(atr.isNotNull() & swing.isNotNull(), F.greatest(raw, c * (1 - 7.0 / 100)))


def features(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Aligned bars with every feature and label, before the liquidity filter."""
    px = align_to_calendar(bars, bench).join(market_features(bench), "date")
    px = px.withColumn("_tr", ind.true_range()).withColumn("lr", F.ln("close") - F.ln(ind.lag("close")))
    px = px.withColumn("_dv", F.col("close") * F.col("volume")).withColumn("_gap", F.abs(ind.ratio("open", ind.lag("close")) - 1))
    px = averages_with_gaps(px, {"atr": (F.col("_tr"), wilder(14))})
    c = F.col("close")
    nz = lambda x: F.nullif(x, F.lit(0.0))
    f60, fwd = ind.rows(-59, 0), ind.rows(1, HORIZON)
    paired = (F.count("lr").over(f60) >= 60) & (F.count("bench_r").over(f60) >= 60)
    px = px.withColumn("stop", F.when(c.isNotNull(), stop_level(c, F.col("atr"), ind.rolling_min("low", 20))))
    return px.select(
        "ticker", "date", "close", "traded", "stop", *MARKET,
        *[(ind.ratio(c, ind.lag("close", n)) - 1).alias(f"ret_{n}") for n in (5, 21, 63)],
        (ind.ratio(ind.lag("close", 21), ind.lag("close", 252)) - 1).alias("mom_12_1"), *[ind.rolling_std("lr", n).alias(f"vol_{n}") for n in (5, 20, 60)],
        ind.ratio("atr", c).alias("atr_pct"), (ind.ratio("stop", c) - 1).alias("stop_dist_pct"), (ind.ratio(c, ind.rolling_max("high", 252)) - 1).alias("dist_52w_high"),
        (ind.ratio(c, ind.rolling_min("low", 252)) - 1).alias("dist_52w_low"), (F.col("volume") / nz(ind.prior_mean("volume", 20))).alias("vol_ratio_20"),
        (F.col("volume") / nz(ind.prior_mean("volume", 100))).alias("vol_ratio_100"), ind.sma("_gap", 20).alias("gap_abs_20"),
        F.when(paired, F.covar_samp("lr", "bench_r").over(f60) / nz(F.var_samp("bench_r").over(f60))).alias("beta_60"), ind.sma("_dv", 20).alias("dollar_vol_20"),
        (ind.ratio(ind.lead("close", HORIZON), c) - 1).alias("_fwd"), ind.full(F.min("close").over(fwd), "close", fwd, HORIZON).alias("_min"),
        ind.full(F.stddev_samp("lr").over(fwd), "lr", fwd, HORIZON).alias("_rvol"), "bench_fwd")


def with_labels(px: DataFrame) -> DataFrame:
    ok = F.col("_fwd").isNotNull() & F.col("_min").isNotNull() & F.col("stop").isNotNull()
    flag = lambda test, extra=F.lit(True): F.when(ok & extra, test.cast("double"))
    return px.select(
        "*", F.when(ok, F.col("_fwd")).alias("fwd_ret"), F.when(ok, F.col("_rvol")).alias("fwd_rvol"), flag(F.col("_min") < F.col("stop")).alias("y_stop_hit"),
        flag(F.col("_fwd") > THRESHOLD).alias("y_up10"), flag(F.col("_fwd") < -THRESHOLD).alias("y_dn10"),
        flag(F.col("_fwd") > F.col("bench_fwd"), F.col("bench_fwd").isNotNull()).alias("y_beat_mkt")).drop("_fwd", "_min", "_rvol", "bench_fwd")


def build_panel(bars: DataFrame, bench: DataFrame, min_price: float = 2.0, min_dollar: float = 1000.0) -> DataFrame:
    """One row per liquid, traded ticker-day with complete features."""
    p = with_labels(features(bars, bench))
    liquid = F.col("traded") & (F.col("close") >= min_price) & (F.col("dollar_vol_20") >= min_dollar)
    return p.where(liquid).dropna(subset=FEATURES)


def panel_summary(panel: DataFrame) -> DataFrame:
    return panel.groupBy(F.year("date").alias("year")).agg(
        F.count("*").alias("rows"), F.countDistinct("date").alias("dates"), *[F.avg(c).alias(c) for c in TARGETS], F.count("y_stop_hit").alias("labelled"))


# --- forecasts --------------------------------------------------------------------------------------------------

def tail_probability(sigma: Column, threshold: float, up: bool, horizon: int = HORIZON) -> Column:
    s = sigma * math.sqrt(horizon)
    if up:
        return 1 - stats.normal_cdf(math.log(1 + threshold) / s)
    return stats.normal_cdf(math.log(1 - threshold) / s)


def barrier_probability(distance: Column, sigma: Column, horizon: int = HORIZON) -> Column:
    """Chance of touching a level below, by reflection with a discrete-time correction."""
    b = distance - BARRIER_BETA * sigma
    p = 2 * stats.normal_cdf(b / (sigma * math.sqrt(horizon)))
    return F.least(F.greatest(F.when(distance >= 0, 1.0).otherwise(p), F.lit(0.0)), F.lit(1.0))


def rule_predictions(panel: DataFrame) -> DataFrame:
    s = F.nullif(F.col("vol_20"), F.lit(0.0))
    return panel.select(
        "*", barrier_probability(F.log1p("stop_dist_pct"), s).alias("rule_y_stop_hit"), tail_probability(s, THRESHOLD, True).alias("rule_y_up10"),
        tail_probability(s, THRESHOLD, False).alias("rule_y_dn10"), F.lit(0.5).alias("rule_y_beat_mkt"), F.col("vol_20").alias("rule_fwd_rvol"))


def with_predictions(panel: DataFrame, years: list[int], embargo: int = HORIZON) -> DataFrame:
    """Test rows of each year with the training base rate and the volatility rule per target, in long form."""
    split = walk_forward_splits(panel, years, embargo)
    all_targets = TARGETS + ["fwd_rvol"]
    base = split.where("part = 'train'").groupBy("test_year").agg(*[F.avg(c).alias(f"base_{c}") for c in all_targets])
    test = rule_predictions(split.where("part = 'test'")).join(F.broadcast(base), "test_year")
    legs = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).alias("y"), F.col(f"base_{c}").alias("p_base"), F.col(f"rule_{c}").alias("p_rule")) for c in all_targets])
    keep = ["test_year", "ticker", "date", "mkt_above_200", "fwd_ret"]
    long = test.select(*keep, F.explode(legs).alias("l")).select(*keep, "l.*").where("y is not null and p_rule is not null")
    loss = lambda p: F.when(F.col("target") == "fwd_rvol", stats.qlike(F.col("y"), F.col(p))).otherwise(stats.brier(F.col("y"), F.col(p)))
    return long.withColumn("loss_base", loss("p_base")).withColumn("loss_rule", loss("p_rule"))


def evaluate(long: DataFrame, lag: int = HORIZON) -> DataFrame:
    """Losses, skill, date-clustered t, AUC and calibration error per year and target."""
    keys = ["test_year", "target"]
    g = long.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("y").alias("rate"), F.avg("loss_base").alias("loss_base"), F.avg("loss_rule").alias("loss_rule"))
    g = g.withColumn("skill", stats.skill(F.col("loss_rule"), F.col("loss_base")))
    t = stats.clustered_difference(long, keys, "loss_rule", "loss_base", lag).select(*keys, F.col("n").alias("n_dates"), F.col("t").alias("t_rule_vs_base"))
    binary = long.where("target <> 'fwd_rvol'")
    a = stats.auc(binary, keys, "y", "p_rule")
    c = stats.calibration_error(stats.calibration(binary, keys, "y", "p_rule"), keys)
    return g.join(t, keys).join(a, keys, "left").join(c, keys, "left")


def regime_breakdown(long: DataFrame) -> DataFrame:
    return long.where("mkt_above_200 is not null").groupBy("target", F.when(F.col("mkt_above_200") == 1, "bull").otherwise("bear").alias("regime")).agg(
        F.count("*").alias("n"), stats.skill(F.avg("loss_rule"), F.avg("loss_base")).alias("skill_vs_base"))


def quintile_spread(panel: DataFrame, score: str, groups: int = 5) -> DataFrame:
    """Mean forward return of the top group minus the bottom group, per date."""
    p = panel.where(F.col(score).isNotNull() & F.col("fwd_ret").isNotNull())
    w = Window.partitionBy("date")
    p = p.withColumn("_r", F.row_number().over(w.orderBy(score, "ticker"))).withColumn("_n", F.count("*").over(w)).withColumn("_k", F.floor(F.col("_n") / groups))
    top, bottom = F.when(F.col("_r") > F.col("_n") - F.col("_k"), F.col("fwd_ret")), F.when(F.col("_r") <= F.col("_k"), F.col("fwd_ret"))
    return p.where(F.col("_n") >= groups).groupBy("date").agg((F.avg(top) - F.avg(bottom)).alias("spread"))


def gate(evaluation: DataFrame, spreads: DataFrame, need: int) -> DataFrame:
    """Years in which each criterion holds, and whether every one holds in at least ``need`` years."""
    e = evaluation.where("target <> 'y_beat_mkt'").groupBy("target").agg(
        F.count("*").alias("years"), F.count_if(F.col("skill") > 0).alias("years_skill"), F.count_if(F.col("auc") >= 0.6).alias("years_auc"),
        F.count_if(F.col("calibration_error") <= 0.2).alias("years_calib"), F.count_if((F.col("skill") > 0) & (F.col("t_rule_vs_base") < -2)).alias("years_significant"))
    vol = F.col("target") == "fwd_rvol"
    passed = (F.col("years") >= need) & (F.col("years_skill") >= need) & (vol | ((F.col("years_auc") >= need) & (F.col("years_calib") >= need)))
    s = spreads.groupBy(F.year("date").alias("y")).agg(F.avg("spread").alias("m")).agg(F.count("*").alias("years"), F.count_if(F.col("m") > 0.01).alias("ok"))
    beat = s.select(F.lit("y_beat_mkt").alias("target"), "years", F.col("ok").alias("years_skill"), F.lit(None).cast("bigint").alias("years_auc"),
                    F.lit(None).cast("bigint").alias("years_calib"), F.lit(None).cast("bigint").alias("years_significant"),
                    ((F.col("years") >= need) & (F.col("ok") >= need)).alias("passed"))
    return e.withColumn("passed", passed).unionByName(beat)


def lookahead_check(bars: DataFrame, bench_of, cut: str) -> DataFrame:
    """Feature rows up to ``cut`` that change when everything after it is removed: none if nothing looks ahead."""
    early = bars.where(F.col("date") <= F.lit(cut).cast("date"))
    cols = ["ticker", "date", *[F.round(c, 9).alias(c) for c in FEATURES + MARKET]]
    full = build_panel(bars, bench_of(bars)).where(F.col("date") <= F.lit(cut).cast("date")).select(*cols)
    cutoff = build_panel(early, bench_of(early)).select(*cols)
    return full.exceptAll(cutoff).unionByName(cutoff.exceptAll(full))


# --- models -----------------------------------------------------------------------------------------------------

def design(split: DataFrame) -> DataFrame:
    """Cross-sectional ranks, training-only z-scores, log volatility and rule logits."""
    ranked = split.select("*", *[ind.centred_rank(c, ["test_year", "part", "date"]).alias(f"rank_{c}") for c in FEATURES])
    z = split.where("part = 'train'").groupBy("test_year").agg(
        *[F.avg(c).alias(f"m_{c}") for c in MARKET], *[F.stddev_samp(c).alias(f"s_{c}") for c in MARKET])
    d = rule_predictions(ranked).join(F.broadcast(z), "test_year")
    logit = lambda p: F.ln(p / (1 - p))
    clip = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-4)), F.lit(1 - 1e-4))
    scale = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
    return d.select(
        "*", *[((F.col(c) - F.col(f"m_{c}")) / scale(c)).alias(f"z_{c}") for c in MARKET], F.ln(F.greatest(F.col("vol_20"), F.lit(1e-4))).alias("log_vol_20"),
        *[logit(clip(f"rule_{c}")).alias(f"logit_{c}") for c in TARGETS[:3]])


def design_columns(target: str) -> list[str]:
    return [f"rank_{c}" for c in FEATURES] + [f"z_{c}" for c in MARKET] + ["log_vol_20"] + ([f"logit_{target}"] if target in TARGETS[:3] else [])


def flagged(rows: DataFrame, cols: list[str]) -> tuple[DataFrame, list[str]]:
    """Flags for the features that early sessions or still stocks lack, next to the features."""
    holes = [c for c in cols if c.startswith(("z_", "logit_"))]
    return rows.select("*", *[F.col(c).isNull().cast("double").alias(f"no_{c}") for c in holes]), [f"no_{c}" for c in holes]


def tested_years(panel: DataFrame, embargo: int = HORIZON) -> list[int]:
    """Years of the panel that have labelled training rows before them."""
    years = [r[0] for r in panel.select(F.year("date")).distinct().orderBy(F.year("date")).collect()]
    trained = walk_forward_splits(panel, years, embargo).where("part = 'train'").groupBy("test_year").agg(*[F.count(c).alias(c) for c in TARGETS + ["fwd_rvol"]])
    return sorted(r["test_year"] for r in trained.collect() if all(r[c] for c in TARGETS + ["fwd_rvol"]))


def walk_forward_models(panel: DataFrame, years: list[int], jobs: list[tuple[str, str]], rounds: int = forecasters.ROUNDS, least_leaf: int = 100 * HORIZON) -> DataFrame:
    """Out-of-sample predictions of each (target, model) over the test years.

    ``logistic`` and ``gbm`` give probabilities; ``ridge`` fits log volatility and corrects the mean of the lognormal.  Missing features are
    0 and flagged.  Training rows of one class give that class.
    """
    if not years:
        return panel.sparkSession.createDataFrame([], "test_year int, ticker string, date date, target string, model string, y double, p_model double")
    targets = sorted({t for t, _ in jobs})
    rows, flags = flagged(design(walk_forward_splits(panel, years, HORIZON)), sorted({c for t in targets for c in design_columns(t)}))
    columns = {t: [*design_columns(t), *(f for f in flags if f[3:] in design_columns(t))] for t in targets}
    return forecasters.walk_forward(rows, columns, years, jobs, 1e-4, rounds, least_leaf)


def compare_models(predictions: DataFrame, long: DataFrame) -> DataFrame:
    """Model losses next to the base rate and the rule, per year, target and model."""
    keys = ["test_year", "ticker", "date", "target"]
    j = predictions.where("y is not null").join(long.drop("y", "mkt_above_200", "fwd_ret"), keys)
    loss = F.when(F.col("target") == "fwd_rvol", stats.qlike(F.col("y"), F.col("p_model"))).otherwise(stats.brier(F.col("y"), F.col("p_model")))
    g = j.withColumn("loss_model", loss).groupBy("test_year", "target", "model").agg(
        F.count("*").alias("n"), F.avg("loss_model").alias("loss_model"), F.avg("loss_base").alias("loss_base"), F.avg("loss_rule").alias("loss_rule"))
    return g.withColumn("skill_vs_base", stats.skill(F.col("loss_model"), F.col("loss_base"))).withColumn(
        "skill_vs_rule", stats.skill(F.col("loss_model"), F.col("loss_rule")))


def model_table(panel: DataFrame, years: list[int], jobs: list[tuple[str, str]]) -> DataFrame:
    return compare_models(walk_forward_models(panel, years, jobs), with_predictions(panel, years))
