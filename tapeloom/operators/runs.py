"""Runs, islands, pivots and swings along one ticker's bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind


def strict_run(c: str, n: int, rising: bool) -> Column:
    """True when the last n values rise (or fall) strictly."""
    value = F.col(c)
    steps = [ind.lag(c, i) < ind.lag(c, i - 1) if i > 1 else ind.lag(c, 1) < value for i in range(1, n)]
    if not rising:
        steps = [ind.lag(c, i) > ind.lag(c, i - 1) if i > 1 else ind.lag(c, 1) > value for i in range(1, n)]
    out = steps[0]
    for s in steps[1:]:
        out = out & s
    return F.coalesce(out, F.lit(False))


def island(flag: str) -> Column:
    """Number of breaks so far: rows of one unbroken true run share it."""
    return F.sum(F.when(F.col(flag), 0).otherwise(1)).over(ind.to_date())


def true_runs(df: DataFrame, flag: str, low: str) -> DataFrame:
    """For rows inside a true run: where it started, its length and its lowest value so far."""
    w = Window.partitionBy("ticker", "_island").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return (
        df.withColumn("_island", island(flag)).where(F.col(flag))
        .withColumn("run_start", F.min("date").over(w))
        .withColumn("run_length", F.count("*").over(w))
        .withColumn("run_low", F.min(low).over(w))
        .drop("_island")
    )


def with_pivots(df: DataFrame, c: str, order: int) -> DataFrame:
    """Strict turning points: beyond every value of the ``order`` bars on both sides."""
    left, right = ind.rows(-order, -1), ind.rows(1, order)
    whole = (F.count(c).over(left) == order) & (F.count(c).over(right) == order)
    low = whole & (F.col(c) < F.min(c).over(left)) & (F.col(c) < F.min(c).over(right))
    high = whole & (F.col(c) > F.max(c).over(left)) & (F.col(c) > F.max(c).over(right))
    return df.withColumn("pivot_low", low).withColumn("pivot_high", high)


def with_swings(df: DataFrame) -> DataFrame:
    """Two-bar swings, ties allowed, only where both sides exist."""
    f = ind.rows(-2, 2)
    whole = F.count("*").over(f) == 5
    return df.withColumn("peak", whole & (F.col("high") >= F.max("high").over(f))).withColumn(
        "trough", whole & (F.col("low") <= F.min("low").over(f)))
