"""Indicator families that need recursive averages, as DataFrame transforms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.functions.recursive import averages, span, wilder


def rsi_of(gain: Column, loss: Column) -> Column:
    """100 when there were only gains, NULL when nothing moved."""
    ratio = gain / F.nullif(loss, F.lit(0.0))
    return F.when((loss == 0) & (gain > 0), F.lit(100.0)).otherwise(100 - 100 / (1 + ratio))


def gains(move: Column) -> Column:
    """The upward part of a move; NULL stays NULL."""
    return F.when(move > 0, move).when(move <= 0, F.lit(0.0))


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    move = F.col("close") - ind.lag("close")
    out = averages(
        bars.withColumn("_move", move),
        {"_gain": (gains(F.col("_move")), wilder(n)), "_loss": (gains(-F.col("_move")), wilder(n))},
    )
    return out.withColumn("rsi", rsi_of(F.col("_gain"), F.col("_loss"))).drop("_move", "_gain", "_loss")


def atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return averages(bars.withColumn("_tr", ind.true_range()), {name: (F.col("_tr"), wilder(n))}).drop("_tr")


def force_index(bars: DataFrame) -> DataFrame:
    raw = F.col("volume") * (F.col("close") - ind.lag("close"))
    return averages(
        bars.withColumn("force_raw", raw),
        {"force_short": (F.col("force_raw"), span(2)), "force_long": (F.col("force_raw"), span(13))},
    )


def stochastic(bars: DataFrame, k: int = 5, d: int = 3) -> DataFrame:
    """Slow stochastic: stoch_k is the smoothed fast line, stoch_d smooths it again."""
    low, high = ind.rolling_min("low", k), ind.rolling_max("high", k)
    out = bars.withColumn("_fast", (F.col("close") - low) / F.nullif(high - low, F.lit(0.0)) * 100)
    return out.withColumn("stoch_k", ind.sma("_fast", d)).withColumn("stoch_d", ind.sma("stoch_k", d)).drop("_fast")


def accumulation(bars: DataFrame) -> DataFrame:
    """Running accumulation/distribution (``ad``) and on-balance volume (``obv``)."""
    spread = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    credit = F.coalesce((F.col("close") - F.col("open")) / spread * F.col("volume"), F.lit(0.0))
    move = F.signum(F.col("close") - ind.lag("close")) * F.col("volume")
    return (
        bars.withColumn("_credit", credit).withColumn("_obv", move)
        .withColumn("ad", F.sum("_credit").over(ind.to_date()))
        .withColumn("obv", F.sum("_obv").over(ind.to_date()))
        .drop("_credit", "_obv")
    )


def momentum_set(bars: DataFrame) -> DataFrame:
    """Every recursive column of the board in two passes.

    Adds ema11/21/22/50/200, macd_line/signal/hist, atr, plus_di, minus_di, adx,
    rsi, force_short and force_long.
    """
    c = F.col("close")
    up, down = F.col("high") - ind.lag("high"), ind.lag("low") - F.col("low")
    prepared = bars.select(
        "*",
        (c - ind.lag("close")).alias("_move"),
        ind.true_range().alias("_tr"),
        F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)).alias("_up"),
        F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)).alias("_down"),
    )
    m = F.col("_move")
    first = averages(prepared, {
        **{f"ema{n}": (c, span(n)) for n in (11, 12, 21, 22, 26, 50, 200)},
        "atr": (F.col("_tr"), wilder(14)),
        "_pdm": (F.col("_up"), wilder(14)),
        "_ndm": (F.col("_down"), wilder(14)),
        "_gain": (gains(m), wilder(14)),
        "_loss": (gains(-m), wilder(14)),
        "force_short": (F.col("volume") * m, span(2)),
        "force_long": (F.col("volume") * m, span(13)),
    })
    a = F.nullif(F.col("atr"), F.lit(0.0))
    mid = (
        first.withColumn("macd_line", F.col("ema12") - F.col("ema26"))
        .withColumn("plus_di", 100 * F.col("_pdm") / a)
        .withColumn("minus_di", 100 * F.col("_ndm") / a)
        .withColumn("rsi", rsi_of(F.col("_gain"), F.col("_loss")))
    )
    both = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    dx = 100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both
    return (
        averages(mid, {"macd_signal": (F.col("macd_line"), span(9)), "adx": (dx, wilder(14))})
        .withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
        .drop("_move", "_tr", "_up", "_down", "_pdm", "_ndm", "_gain", "_loss")
    )


def directional(bars: DataFrame, n: int = 14) -> DataFrame:
    """Directional system: plus_di, minus_di and adx."""
    up, down = F.col("high") - ind.lag("high"), ind.lag("low") - F.col("low")
    moves = bars.select(
        "*", ind.true_range().alias("_tr"),
        F.when((up > down) & (up > 0), up).otherwise(F.lit(0.0)).alias("_up"),
        F.when((down > up) & (down > 0), down).otherwise(F.lit(0.0)).alias("_down"))
    out = averages(moves, {"atr": (F.col("_tr"), wilder(n)), "_pdm": (F.col("_up"), wilder(n)),
                           "_ndm": (F.col("_down"), wilder(n))})
    return _adx(out, n).drop("_tr", "_up", "_down", "_pdm", "_ndm")


def _adx(df: DataFrame, n: int) -> DataFrame:
    a = F.nullif(F.col("atr"), F.lit(0.0))
    df = df.withColumn("plus_di", 100 * F.col("_pdm") / a).withColumn("minus_di", 100 * F.col("_ndm") / a)
    both = F.nullif(F.col("plus_di") + F.col("minus_di"), F.lit(0.0))
    return averages(df, {"adx": (100 * F.abs(F.col("plus_di") - F.col("minus_di")) / both, wilder(n))})


def elder_power(bars: DataFrame, n: int = 13) -> DataFrame:
    """Bull and bear power: the bar's extremes against its EMA."""
    return averages(bars, {"ema": (F.col("close"), span(n))}).withColumn(
        "bull_power", F.col("high") - F.col("ema")).withColumn("bear_power", F.col("low") - F.col("ema"))
