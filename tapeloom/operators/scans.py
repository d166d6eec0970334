"""Whole-history scans: each evaluates a rule on every bar of every ticker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind


def volume_spikes(bars: DataFrame, n: int = 20) -> DataFrame:
    """Up-days whose volume exceeds the mean of up to n prior bars, ranked within the day."""
    hits = (
        bars.withColumn("avg_volume", F.avg("volume").over(ind.rows(-n, -1)))
        .withColumn("prior", ind.lag("close"))
        .where((F.col("close") > F.col("prior")) & (F.col("volume") > F.col("avg_volume")) & (F.col("avg_volume") > 0))
        .withColumn("spike_pct", (F.col("volume") - F.col("avg_volume")) / F.col("avg_volume") * 100)
    )
    by_day = Window.partitionBy("date").orderBy(F.round("spike_pct", 6).desc())
    return hits.withColumn("place", F.rank().over(by_day)).drop("prior")


def with_benchmark(bars: DataFrame, bench: DataFrame, **columns: str) -> DataFrame:
    """Bars joined with benchmark columns on common dates.

    The benchmark holds one row per session; Spark chooses the strategy from its size.
    """
    return bars.join(bench.select("date", *[F.col(c).alias(n) for n, c in columns.items()]), "date")


def log_return(c: str = "close", w=None) -> Column:
    return F.ln(c) - F.ln(ind.lag(c, 1, w))


def benchmark_returns(bench: DataFrame) -> DataFrame:
    """Benchmark with its log return; a single series of one row per session."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    return bench.withColumn("bench_r", log_return("close", w))


def rolling_beta(bars: DataFrame, bench: DataFrame, n: int = 60) -> DataFrame:
    joined = with_benchmark(bars, benchmark_returns(bench), bench_r="bench_r").withColumn("r", log_return())
    f = ind.rows(-(n - 1), 0)
    ready = (F.count("r").over(f) >= n) & (F.count("bench_r").over(f) >= n)
    beta = ind.ratio(F.covar_samp("r", "bench_r").over(f), F.var_samp("bench_r").over(f))
    return joined.withColumn(f"beta_{n}", F.when(ready, beta))


def relative_strength(bars: DataFrame, bench: DataFrame) -> DataFrame:
    """Excess return over the benchmark across the last 21 and 63 common bars."""
    j = with_benchmark(bars, bench, bench_close="close")
    excess = lambda n: ind.ratio("close", ind.lag("close", n - 1)) - ind.ratio("bench_close", ind.lag("bench_close", n - 1))
    return j.withColumn("rs_1m", excess(21)).withColumn("rs_3m", excess(63))


def staleness(bars: DataFrame) -> DataFrame:
    """Days between each ticker's last bar and the newest bar of the table."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    newest = last.agg(F.max("last_date")).scalar()
    return last.withColumn("days_stale", F.datediff(newest, "last_date"))


def momentum_extremes(bars: DataFrame, period: int = 10, lookback: int = 20) -> DataFrame:
    out = bars.withColumn("momentum", F.col("close") - ind.lag("close", period))
    return out.withColumn("momentum_high", ind.rolling_max("momentum", lookback)).withColumn(
        "momentum_low", ind.rolling_min("momentum", lookback))


def extreme_reading(c: str, lookback: int) -> Column:
    f = ind.rows(-(lookback - 1), 0)
    return (F.when(F.col(c) >= F.max(c).over(f), "New High").when(F.col(c) <= F.min(c).over(f), "New Low").otherwise("No"))


def price_context(bars: DataFrame, need: int = 60) -> DataFrame:
    """Position of the close within its last calendar year and against its averages."""
    day = F.unix_date("date")
    year = Window.partitionBy("ticker").orderBy(day).rangeBetween(-364, 0)
    out = bars.select(
        "ticker", "date", "close",
        F.max("close").over(year).alias("high_52w"), F.min("close").over(year).alias("low_52w"),
        F.avg("close").over(ind.rows(-19, 0)).alias("s20"), F.avg("close").over(ind.rows(-49, 0)).alias("s50"),
        F.count("*").over(ind.to_date()).alias("n"), ind.lag("close", 20).alias("c20"),
    ).withColumn("s20_5", ind.lag("s20", 5))
    c, hi, lo = F.col("close"), F.col("high_52w"), F.col("low_52w")
    return out.where(F.col("n") >= need).select(
        "ticker", "date", "close", "high_52w", "low_52w",
        (ind.ratio(c, hi) - 1).alias("pct_off_high"), F.when(hi > lo, (c - lo) / (hi - lo)).alias("range_pos"),
        (ind.ratio(c, "c20") - 1).alias("ret_20d"), (c > F.col("s50")).alias("above_sma50"),
        ((c > F.col("s20")) & (F.col("s20") > F.col("s20_5"))).alias("turning_up"),
    )


def latest(bars: DataFrame, keys: list[str] = ["ticker"], order: str = "date") -> DataFrame:
    """The newest row of each key: a map-side-combined aggregation, no sort."""
    rest = [c for c in bars.columns if c not in keys and c != order]
    newest = F.max(F.struct(order, *rest))
    return bars.groupBy(*keys).agg(newest.alias("_row")).select(*keys, "_row.*")
