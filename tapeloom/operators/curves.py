"""Performance of stored equity curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import ledger, stats

CAPITAL = 50000.0


def stored_curves(bars: DataFrame) -> DataFrame:
    """Equity curves (strategy, fold, date, equity): each ticker held through each year from its first open."""
    w = Window.partitionBy("ticker", F.year("date")).orderBy("date")
    first = F.first("open").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return bars.select(F.col("ticker").alias("strategy"), F.year("date").alias("fold"), "date", ind.ratio(CAPITAL * F.col("close"), first).alias("equity"))


def fold_returns(curve: DataFrame) -> DataFrame:
    """Daily returns, each fold starting from its own capital."""
    w = Window.partitionBy("strategy", "fold").orderBy("date")
    return curve.withColumn("prev", F.coalesce(F.lag("equity").over(w), F.lit(CAPITAL))).withColumn("r", ind.ratio("equity", "prev") - 1)


def with_benchmark(returns: DataFrame, bench: DataFrame) -> DataFrame:
    """Benchmark return of the same days: open to close on a fold's first day, close to close after."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    b = bench.select("date", (ind.ratio("close", F.lag("close").over(w)) - 1).alias("_c2c"), (ind.ratio("close", "open") - 1).alias("_o2c"))
    first = F.row_number().over(Window.partitionBy("strategy", "fold").orderBy("date")) == 1
    j = returns.join(b, "date", "left").withColumn("first_day", first)
    return j.withColumn("rb", F.coalesce(F.when(F.col("first_day"), F.col("_o2c")).otherwise(F.col("_c2c")), F.lit(0.0))).drop("_c2c", "_o2c")


def log_growth(r: str) -> Column:
    """ln(1 + r); a total loss is minus infinity, where Spark's own function is NULL and the loss would drop out of a sum."""
    return F.when(F.col(r) == -1, F.lit(float("-inf"))).otherwise(F.log1p(r))


def _drawdown(returns: DataFrame, keys: list[str]) -> DataFrame:
    so_far = Window.partitionBy(*keys).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    c = returns.withColumn("curve", F.exp(F.sum(log_growth("r")).over(so_far)))
    return c.withColumn("dd", ind.ratio("curve", F.max("curve").over(so_far)) - 1)


def metrics(returns: DataFrame, keys: list[str], days: float = 252.0) -> DataFrame:
    r = F.col("r")
    g = _drawdown(returns, keys).groupBy(*keys).agg(
        F.count("*").alias("days"), F.max_by("curve", "date").alias("end"), F.min("dd").alias("dd"), F.avg(r).alias("m"), F.stddev_samp(r).alias("sd"),
        F.sqrt(F.avg(F.least(r, F.lit(0.0)) * F.least(r, F.lit(0.0)))).alias("down"), F.sqrt(F.avg((F.col("dd") * 100) * (F.col("dd") * 100))).alias("ulcer"))
    cagr = F.pow(F.col("end"), days / F.col("days")) - 1
    year = F.sqrt(F.lit(days))
    return g.select(*keys, "days", (cagr * 100).alias("cagr"), ((F.col("end") - 1) * 100).alias("total"), (F.col("dd") * 100).alias("max_dd"),
                    (ind.ratio("m", "sd") * year).alias("sharpe"), (ind.ratio("m", "down") * year).alias("sortino"),
                    ind.ratio(cagr, F.abs("dd")).alias("calmar"), "ulcer")


def pair_comparison(returns: DataFrame, against: str) -> DataFrame:
    """Every strategy against one: annualised difference, tracking error, information ratio and fold wins."""
    b = returns.where(F.col("strategy") == against).select("date", F.col("r").alias("r_b"))
    j = returns.where(F.col("strategy") != against).join(b, "date").withColumn("d", F.col("r") - F.col("r_b"))
    wins = j.groupBy("strategy", "fold").agg((F.sum(log_growth("r")) > F.sum(log_growth("r_b"))).alias("win")).groupBy("strategy").agg(
        F.count_if("win").alias("fold_wins"), F.count("*").alias("folds"))
    year = F.sqrt(F.lit(252.0))
    g = j.groupBy("strategy").agg(F.count("*").alias("n"), (F.avg("d") * 252 * 100).alias("annual_diff"), (F.stddev_samp("d") * year * 100).alias("tracking_error"),
                                  (ind.ratio(F.avg("d"), F.stddev_samp("d")) * year).alias("info_ratio"))
    return g.join(wins, "strategy")


def attribution(matched: DataFrame, entry_cost: float = 0.001) -> DataFrame:
    """Profit of each fold split into benchmark-matched, excess and costs."""
    m = F.col("prev") * F.col("rb")
    cost = F.when(F.col("first_day"), F.lit(CAPITAL * entry_cost)).otherwise(0.0)
    gain = F.col("equity") - F.col("prev")
    return matched.groupBy("strategy", "fold").agg(F.sum(m).alias("matched"), F.sum(gain - m).alias("excess"), (-F.sum(cost)).alias("costs"), F.sum(gain - cost).alias("total"))


def sweep_scores(returns: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("sharpe", 9).desc(), "strategy")
    return metrics(returns, ["strategy"]).withColumn("place", F.row_number().over(w))


def fold_metrics(returns: DataFrame) -> DataFrame:
    m = metrics(returns, ["strategy", "fold"])
    return m.select("strategy", "fold", F.col("total").alias("ret"), F.col("max_dd").alias("dd"), "sharpe")


def ab_comparison(returns: DataFrame, a: str, b: str) -> DataFrame:
    """B minus A per fold."""
    m = fold_metrics(returns.where(F.col("strategy").isin(a, b)))
    side = lambda c, s: F.max(F.when(F.col("strategy") == s, F.col(c)))
    g = m.groupBy("fold").agg(*[(side(c, b) - side(c, a)).alias(f"{c}_diff") for c in ("ret", "dd", "sharpe")])
    return g.where("ret_diff is not null")


def winner_votes(returns: DataFrame) -> DataFrame:
    """Strategies by how often they won a fold, with the mean return of the fold that followed.

    A Sharpe ratio that is NaN counts as the highest.  Of equal ones the first strategy by name wins.
    """
    m = fold_metrics(returns)
    best = Window.partitionBy("fold").orderBy(F.round("sharpe", 9).desc_nulls_last(), "strategy")
    won = m.withColumn("_place", F.row_number().over(best)).where("_place = 1").select("fold", F.when(F.col("sharpe").isNotNull(), F.col("strategy")).alias("strategy"))
    later = m.select("strategy", (F.col("fold") - 1).alias("fold"), F.col("ret").alias("next_ret"))
    return won.join(later, ["strategy", "fold"], "left").groupBy("strategy").agg(F.count("*").alias("votes"), F.avg("next_ret").alias("oos_ret"))


def variant_summary(returns: DataFrame) -> DataFrame:
    return fold_metrics(returns).groupBy("strategy").agg(
        ((F.product(1 + F.col("ret") / 100) - 1) * 100).alias("compounded"), F.avg("ret").alias("mean_ret"), F.min("dd").alias("worst_dd"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"))


def paired_returns(bars: DataFrame, bench: DataFrame) -> DataFrame:
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    b = bench.select("date", (ind.ratio("close", F.lag("close").over(w)) - 1).alias("x"))
    return bars.select("ticker", "date", ind.change_pct().alias("y")).join(b, "date")


def monthly_excess(t) -> DataFrame:
    """Mean trade excess per exit month, numbered from zero."""
    x = ledger.trade_excess(t.trades, t.bench, t.dividends, t.sectors)
    g = x.groupBy(F.trunc("exit_date", "MM").alias("m")).agg(F.round(F.avg("excess_realistic"), 6).alias("x"))
    return stats.positions(g, "m")


def sector_tests(t) -> DataFrame:
    """Mean excess of each sector against zero, with a two-sided p-value."""
    x = ledger.trade_excess(t.trades, t.bench, t.dividends, t.sectors)
    n = F.count("*")
    g = x.groupBy("sector").agg(n.alias("n"), ind.ratio(F.avg("excess_realistic"), F.stddev_samp("excess_realistic") / F.sqrt(n)).alias("t"))
    return g.withColumn("p", stats.p_value(F.col("t"), F.col("n") - 1))
