"""Closed-vocabulary labels read off indicator columns, and the board built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions.recursive import averages, macd, span
from tapeloom.operators import runs, scans, technicals
from tapeloom.operators.shaping import weekly_bars

FLAT = 0.001  # fixed value: slopes inside this band are flat


def above_below(a: Column, b: Column, names: tuple[str, str, str]) -> Column:
    return F.when(a > b, names[0]).when(a < b, names[1]).otherwise(names[2])


def slope_label(c: str, n: int) -> Column:
    s = ind.norm_slope(c, n)
    return F.when(s > FLAT, "Rising").when(s < -FLAT, "Falling").otherwise("Flat")


def health(price_slope: Column, hist_slope: Column) -> Column:
    flat = (price_slope == "Flat") | (hist_slope == "Flat")
    return F.when(flat, "Unclear").when(price_slope == hist_slope, "Safe").otherwise("Weak")


def impulse(ema_slope: Column, hist_slope: Column) -> Column:
    return (F.when((ema_slope == "Rising") & (hist_slope == "Rising"), "Green")
            .when((ema_slope == "Falling") & (hist_slope == "Falling"), "Red").otherwise("Blue"))


def direction(slope: Column) -> Column:
    return F.when(slope == "Rising", "Up").when(slope == "Falling", "Down").otherwise("Flat")


def alignment(weekly: Column, daily: Column) -> Column:
    return (F.when((weekly == "Up") & (daily == "Down"), "Go long setup")
            .when((weekly == "Down") & (daily == "Up"), "Go short setup").otherwise("Stand aside"))


def value_zone(price: Column, fast: Column, slow: Column) -> Column:
    return (F.when(price > F.greatest(fast, slow), "Above").when(price < F.least(fast, slow), "Below").otherwise("In Zone"))


def zone(c: str, n: int = 120) -> Column:
    """Against the 5% and 95% reference lines of the last n bars."""
    f = ind.rows(-(n - 1), 0)
    line = lambda p: F.round(F.percentile(c, F.lit(p)).over(f), 9)
    value = F.round(c, 9)
    return F.when(value >= line(0.95), "Overbought").when(value <= line(0.05), "Oversold").otherwise("Neutral")


def volume_level(n: int = 10, pct: float = 25.0) -> Column:
    avg = ind.prior_mean("volume", n)
    change = (F.col("volume") - avg) / F.nullif(avg, F.lit(0.0)) * 100
    return F.when(change >= pct, "High").when(change <= -pct, "Low").otherwise("Normal")


def adx_regime(df: DataFrame, wake: float = 4.0) -> DataFrame:
    """ADX against both direction lines; waking up when it rose ``wake`` above the low of its streak."""
    low, high = F.least("plus_di", "minus_di"), F.greatest("plus_di", "minus_di")
    below = F.coalesce(F.col("adx") < low, F.lit(False))
    streak = Window.partitionBy("ticker", "_island", "_below").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_below", below).withColumn("_island", runs.island("_below"))
    out = out.withColumn("_floor", F.min("adx").over(streak))
    regime = (
        F.when(F.col("adx").isNull() | F.col("plus_di").isNull() | F.col("minus_di").isNull(), "Unknown")
        .when(F.col("_below"), F.when(F.col("adx") - F.col("_floor") >= wake, "Waking Up").otherwise("Choppy"))
        .when(F.col("adx") > high, "Overheated").otherwise("Trending"))
    return out.withColumn("adx_regime", regime).drop("_below", "_island", "_floor")


def trend_labels(ind_df: DataFrame) -> DataFrame:
    """Labels that read only daily indicator columns, for every bar."""
    return label_columns(adx_regime(ind_df.withColumn("bar", ind.bar_number())))


def label_columns(df: DataFrame) -> DataFrame:
    """Labels with a bounded look-back; ``df`` has the indicator columns, ``bar`` and ``adx_regime``."""
    c = F.col
    out = df.select(
        "*",
        slope_label("ema22", 10).alias("ma_slope"),
        slope_label("close", 5).alias("price_slope"),
        slope_label("macd_hist", 5).alias("macd_hist_slope"),
        slope_label("adx", 10).alias("adx_trend"),
        slope_label("obv", 10).alias("obv_trend"),
        slope_label("ad", 10).alias("ad_trend"),
        slope_label("ema11", 2).alias("_fast_slope"),
        slope_label("macd_hist", 2).alias("_hist_slope"),
        scans.extreme_reading("macd_hist", 63).alias("macd_hist_extreme"),
        volume_level().alias("volume_vs_avg"),
    )
    return out.select(
        "*",
        above_below(c("close"), c("ema22"), ("Above", "Below", "At")).alias("price_vs_ma"),
        value_zone(c("close"), c("ema11"), c("ema22")).alias("value_zone"),
        above_below(c("macd_line"), c("macd_signal"), ("Bull", "Bear", "Neutral")).alias("macd_cross"),
        health(c("price_slope"), c("macd_hist_slope")).alias("trend_health"),
        above_below(c("plus_di"), c("minus_di"), ("Bull", "Bear", "Neutral")).alias("di_bias"),
        above_below(F.lit(0.0), c("force_short"), ("Negative", "Positive", "Zero")).alias("force_short_zone"),
        above_below(c("force_long"), F.lit(0.0), ("Bull", "Bear", "Neutral")).alias("force_long_bias"),
        impulse(c("_fast_slope"), c("_hist_slope")).alias("impulse_daily"),
        direction(c("ma_slope")).alias("daily_trend"),
    ).drop("_fast_slope", "_hist_slope")


def daily_set(bars: DataFrame) -> DataFrame:
    """Bars with every daily indicator column of the board."""
    return technicals.accumulation(technicals.stochastic(technicals.momentum_set(bars)))


def weekly_labels(bars: DataFrame) -> DataFrame:
    """Weekly trend and impulse at each week's close."""
    w = macd(averages(weekly_bars(bars), {"ema13": (F.col("close"), span(13)), "ema26": (F.col("close"), span(26))}))
    w = w.withColumn("bar", ind.bar_number())
    return w.select("ticker", "date", direction(slope_label("ema26", 10)).alias("weekly_trend"),
                    impulse(slope_label("ema13", 2), slope_label("macd_hist", 2)).alias("impulse_weekly"))


def with_divergences(df: DataFrame, indicators: dict[str, bool], order: int = 3, gap: tuple[int, int] = (20, 40)) -> DataFrame:
    """Price against each indicator at the last two pivots of the bars seen so far.

    ``indicators`` maps a column to whether it must cross zero between the pivots.
    Bullish wins over bearish.  A pivot carries the pivot before it and running
    counts of the bars above and below zero, so the answer is read off growing
    windows without any join.  A pivot is known ``order`` bars late; read the last
    row of a ticker, or a row ``order`` bars after the pivot.
    """
    c, so_far, before = F.col, ind.to_date(), ind.rows(Window.unboundedPreceding, -1)
    crossing = [n for n, x in indicators.items() if x]
    df = runs.with_pivots(df.withColumn("bar", ind.bar_number()), "close", order)
    df = df.select("*", *[F.sum((c(n) > 0).cast("int")).over(so_far).alias(f"_up_{n}") for n in crossing],
                   *[F.sum((c(n) < 0).cast("int")).over(so_far).alias(f"_dn_{n}") for n in crossing])
    kept = ["bar", "close", *indicators, *[f"_{k}_{n}" for n in crossing for k in ("up", "dn")]]
    df = df.select("*", *[F.when(c(f"pivot_{k}"), F.struct(*kept)).alias(f"_{k}") for k in ("low", "high")])
    df = df.select("*", *[F.when(c(f"pivot_{k}"), F.struct(c(f"_{k}").alias("b"), F.last(f"_{k}", True).over(before).alias("a"))).alias(f"_{k}2") for k in ("low", "high")])
    df = df.select("*", *[F.last(f"_{k}2", True).over(so_far).alias(f"_{k}s") for k in ("low", "high")])

    def found(k: str, n: str, cross: bool) -> Column:
        a, b = c(f"_{k}s.a"), c(f"_{k}s.b")
        lower = k == "low"
        hit = (b["bar"] - a["bar"]).between(*gap)
        hit = hit & ((b["close"] < a["close"]) & (b[n] > a[n]) if lower else (b["close"] > a["close"]) & (b[n] < a[n]))
        if cross:
            kind = "_up_" if lower else "_dn_"
            at_b = (b[n] > 0 if lower else b[n] < 0).cast("int")
            hit = hit & (b[kind + n] - at_b - a[kind + n] > 0)
        return F.coalesce(hit, F.lit(False))

    labels = [F.when(found("low", n, x), "Bullish").when(found("high", n, x), "Bearish").otherwise("None").alias(f"{n}_divergence") for n, x in indicators.items()]
    drop = [x for x in df.columns if x.startswith("_")]
    return df.select("*", *labels).drop(*drop, "pivot_low", "pivot_high")


def last_bars(df: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.col("date").desc())
    return df.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n)


BOARD_DIVERGENCES = {"macd_hist": True, "rsi": False, "stoch_k": False, "obv": False, "ad": False,
                     "force_short": False, "force_long": True}


def board(bars: DataFrame) -> DataFrame:
    """One row per ticker at its last bar, with every indicator and label."""
    c = F.col
    daily = adx_regime(with_divergences(daily_set(bars), BOARD_DIVERGENCES))
    # The other labels look back at most 120 bars, so only those go on.
    recent = label_columns(last_bars(daily, 140))
    labelled = recent.select("*", ind.change_pct().alias("_r"), zone("rsi").alias("rsi_zone"), zone("stoch_k").alias("stoch_zone"))
    week = scans.latest(weekly_labels(bars)).drop("date")
    out = labelled.where("back = 1").join(week, "ticker", "left")
    return out.select(
        "ticker", c("date").alias("run_date"), c("close").alias("price"), (c("_r") * 100).alias("pct_chg"),
        c("ema22").alias("ma22"), c("ema50").alias("ma50"), c("ema200").alias("ma200"), "ma_slope", "price_vs_ma", "value_zone",
        "macd_line", "macd_signal", "macd_hist", "macd_cross", "macd_hist_slope", "trend_health", "macd_hist_extreme",
        "macd_hist_divergence", "plus_di", "minus_di", "adx", "di_bias", "adx_trend", "adx_regime", "atr",
        (ind.ratio("atr", "close") * 100).alias("atr_pct"), "rsi", "rsi_zone", "rsi_divergence", "stoch_k", "stoch_d", "stoch_zone",
        "stoch_k_divergence", "volume", "volume_vs_avg", "obv", "obv_trend", "obv_divergence", "ad", "ad_trend", "ad_divergence",
        "force_short", "force_short_zone", "force_short_divergence", "force_long", "force_long_bias", "force_long_divergence",
        "impulse_daily", F.coalesce("impulse_weekly", F.lit("Blue")).alias("impulse_weekly"),
        F.coalesce("weekly_trend", F.lit("Flat")).alias("weekly_trend"), "daily_trend",
        alignment(F.coalesce("weekly_trend", F.lit("Flat")), c("daily_trend")).alias("triple_screen"))


def weekly_indicators(bars: DataFrame) -> DataFrame:
    return macd(averages(weekly_bars(bars), {"ema13": (F.col("close"), span(13)), "ema26": (F.col("close"), span(26))}))


def weekly_with_daily(bars: DataFrame) -> DataFrame:
    """Every week's trend against the daily trend at its last session."""
    from tapeloom.operators.asof import asof_join

    daily = trend_labels(daily_set(bars)).select("ticker", F.col("date").alias("day"), "daily_trend")
    j = asof_join(weekly_labels(bars), daily, "ticker", "date", "day", {"daily_trend": "daily_trend"})
    return j.withColumn("triple_screen", alignment(F.col("weekly_trend"), F.col("daily_trend")))
