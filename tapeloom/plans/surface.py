"""The extension surface: column functions, transforms and user screens."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.functions.protocol import run_screens
from tapeloom.functions.recursive import ema
from tapeloom.operators import scans, technicals
from tapeloom.plans.registry import query

query("d1_column_functions", "ticker date:d sma:f tr:f slope:f8",
      """WITH @bars, x AS (SELECT *, row_number() OVER[] AS rn, greatest(high - low, abs(high - lag(close) OVER[]), abs(low - lag(close) OVER[])) AS tr FROM bars)
      SELECT *, CASE WHEN rn >= 10 THEN avg(close) OVER[-9,0] END AS sma, CASE WHEN rn >= 5 THEN regr_slope(close, rn) OVER[-4,0] / (abs(avg(close) OVER[-4,0]) + 1e-9) END AS slope FROM x""")(
    lambda t: t.bars.withColumn("bar", ind.bar_number()).select("ticker", "date", ind.sma("close", 10).alias("sma"), ind.true_range().alias("tr"), ind.norm_slope("close", 5).alias("slope")))
query("d2_recursive_transforms", "ticker date:d ema26:f4 rsi:f4", "WITH @bars, @rec SELECT * FROM ind")(
    lambda t: t.bars.transform(technicals.rsi).transform(lambda df: ema(df, "ema26", "close", 26)))


def up_days(bars):
    """A user screen: closes above the open on more than the usual volume."""
    hot = F.col("volume") > F.avg("volume").over(ind.rows(-5, -1))
    return bars.withColumn("hot", hot).where("hot and close > open").select("ticker", "date", F.lit("up").alias("label"))


query("d3_custom_screens", "screen ticker date:d label",
      """WITH @bars, u AS (SELECT *, volume > avg(volume) OVER[-5,-1] AS hot FROM bars), v AS (SELECT *, lag(close) OVER[] AS p, avg(volume) OVER[-20,-1] AS av FROM bars)
      SELECT 'up' AS screen, ticker, date, 'up' AS label FROM u WHERE hot AND close > open UNION ALL SELECT 'spike', ticker, date, 'spike' FROM v WHERE close > p AND volume > av AND av > 0""")(
    lambda t: run_screens(t.bars, {"up": up_days, "spike": lambda b: scans.volume_spikes(b).withColumn("label", F.lit("spike"))}))
query("d5_window_array_functions", "ticker date:d recent_highs:i highest:f",
      "WITH @bars SELECT ticker, date, count(*) OVER[-19,0] AS recent_highs, max(high) OVER[-19,0] AS highest FROM bars")(
    lambda t: t.bars.select("ticker", "date", F.count("*").over(ind.rows(-19, 0)).alias("recent_highs"), F.max("high").over(ind.rows(-19, 0)).alias("highest")))


def saved_run(t):
    """A screen run written as one CSV partition per run date and read back."""
    from tapeloom.sources import loading
    from tapeloom.sources.workspace import work_folder

    path = work_folder(t.spark, "screen-runs")
    rows = scans.volume_spikes(t.bars).select("ticker", F.trunc("date", "MM").alias("run_date"), "spike_pct")
    loading.write_run(rows, path)
    return t.spark.read.option("header", True).schema("ticker string, spike_pct double, run_date date").csv(path)


query("s16_run_sink", "ticker run_date:d n:i",
      """WITH @bars, v AS (SELECT *, lag(close) OVER[] AS p, avg(volume) OVER[-20,-1] AS av FROM bars) SELECT ticker, date_trunc('month', date) :: DATE AS run_date, count(*) AS n FROM v WHERE close > p AND volume > av AND av > 0 GROUP BY 1, 2""")(
    lambda t: saved_run(t).groupBy("ticker", "run_date").agg(F.count("*").alias("n")))
