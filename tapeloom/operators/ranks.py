"""Exact ranks and quantiles of groups of any size.

A window over a group puts the whole group in one task.  Here equal values are
first counted together, the distinct values of a group are cut into buckets of
similar size by approximate quantiles, and ranks run inside a bucket on top of the
counts of the buckets before it.  The cut points only spread the work; the result
is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKETS = 64


def running_counts(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] = {}) -> DataFrame:
    """One row per key and distinct value: its count, ``below`` (rows with a smaller value) and the group size ``n``.

    ``sums`` adds sums over the rows of each value.
    """
    v = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("count"), *[F.sum(c).alias(n) for n, c in sums.items()])
    probs = [i / BUCKETS for i in range(1, BUCKETS)]
    one = [F.lit(0).alias("_one")] if not keys else []
    on = keys or ["_one"]
    v = v.select("*", *one)
    cuts = v.groupBy(*on).agg(F.percentile_approx(value, probs, 1000).alias("_cuts"))
    v = v.join(cuts, on).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = v.groupBy(*on, "_b").agg(F.sum("count").alias("_t"))
    w = Window.partitionBy(*on)
    base = totals.select(*on, "_b", F.coalesce(F.sum("_t").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
                         F.sum("_t").over(w).alias("n"))
    inside = Window.partitionBy(*on, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = v.join(base, [*on, "_b"]).withColumn("below", F.col("_base") + F.coalesce(F.sum("count").over(inside), F.lit(0)))
    return out.drop("_b", "_base", "_one")


def quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one column per name."""
    r = running_counts(df, keys, value)
    at = lambda pos: F.min(F.when(F.col("below") + F.col("count") > pos, F.col(value)))
    aggs, outs = [], []
    for name, p in probs.items():
        h = (F.col("n") - 1) * p
        aggs += [at(F.floor(h)).alias(f"_lo_{name}"), at(F.ceil(h)).alias(f"_hi_{name}"), F.max(h - F.floor(h)).alias(f"_f_{name}")]
        outs.append((F.col(f"_lo_{name}") + F.col(f"_f_{name}") * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))).alias(name))
    return r.groupBy(*keys).agg(*aggs).select(*keys, *outs)


def trimmed_mean(df: DataFrame, keys: list[str], value: str, percent: int = 1) -> DataFrame:
    """Mean without the lowest and highest ``n * percent // 100`` values; ties at the cut are split exactly."""
    r = running_counts(df, keys, value)
    k = F.floor(F.col("n") * percent / 100)
    kept = F.greatest(F.lit(0), F.least(F.col("below") + F.col("count"), F.col("n") - k) - F.greatest(F.col("below"), k))
    return r.withColumn("_m", kept).groupBy(*keys).agg((F.sum(F.col("_m") * F.col(value)) / F.sum("_m")).alias("trimmed"))


def mean_without_top(df: DataFrame, keys: list[str], value: str, n: int = 5) -> DataFrame:
    """Mean without the n largest values.  The top n are cut before the shuffle, the rest is a plain sum."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    top = df.select(*keys, value).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).groupBy(*keys).agg(
        F.sum(value).alias("_top"), F.count("*").alias("_k"))
    g = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(value).alias("_c"))
    return g.join(top, keys).where("_c > _k").select(*keys, ((F.col("_sum") - F.col("_top")) / (F.col("_c") - F.col("_k"))).alias("mean_rest"))
