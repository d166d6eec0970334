"""Statistics on small result tables: tests, bootstrap, robust errors, forecast losses."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators.ranks import quantiles, running_counts


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            c = 1.0 + num / c
            d, c = (x_ if abs(x_) > tiny else tiny for x_ in (d, c))
            d = 1.0 / d
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def two_sided_p(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    if t is None or df is None or math.isnan(t) or math.isnan(df) or df <= 0:
        return float("nan")
    a, b, x = df / 2.0, 0.5, df / (df + t * t)
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * _beta_fraction(b, a, 1 - x) / b


def p_value(t: Column, df: Column) -> Column:
    """Two-sided p-value column; meant for aggregated rows."""

    @F.pandas_udf("double")
    def run(ts: pd.Series, dfs: pd.Series) -> pd.Series:
        return pd.Series([two_sided_p(a, b) for a, b in zip(ts, dfs)], dtype=float).replace({np.nan: None})

    return run(t.cast("double"), df.cast("double"))


# Coefficients of the Abramowitz-Stegun 7.1.26 error function.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution by a closed-form polynomial (absolute error below 1e-7)."""
    z = F.abs(x) / math.sqrt(2.0)
    t = 1 / (1 + ERF_P * z)
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + a) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def hash_draw(replicate: Column, position: Column, n: Column, seed: int) -> Column:
    """A uniform index in [0, n) from integer arithmetic, the same in any engine."""
    h = (replicate * 1000003 + position * 7919 + seed) % 2147483647
    h = (h * 48271) % 2147483647
    h = (h * 69621 + 12345) % 2147483647
    h = (h * 48271) % 2147483647
    return h % n


def bootstrap_means(values: DataFrame, value: str, replicates: int, seed: int, block: int = 1) -> DataFrame:
    """Mean of each replicate of a circular block bootstrap (block 1 is the ordinary one).

    ``values`` is (pos, value) with positions 0..n-1: an aggregated table that is
    first reduced to its positions, then joined to the draws by position.
    """
    n = values.agg(F.count("*").alias("n"))
    spark = values.sparkSession
    draws = spark.range(replicates).withColumnRenamed("id", "b").withColumn("n", n.scalar()).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    start = hash_draw(F.col("b"), F.floor(F.col("i") / block), F.col("n"), seed)
    draws = draws.withColumn("pos", (start + F.col("i") % block) % F.col("n"))
    return draws.join(values.select(F.col("pos").cast("bigint").alias("pos"), value), "pos").groupBy("b").agg(F.avg(value).alias("mean"))


def poisson_weights(ids: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """Weight of each row (rows down) in each replicate: a Poisson draw of mean 1 from a hash of both, the same in any engine."""
    low = np.uint64(0xFFFFFFFF)
    z = (ids.astype(np.uint64)[:, None] * np.uint64(40503) + np.arange(replicates, dtype=np.uint64)[None, :] * np.uint64(2654435761) + np.uint64(seed)) & low
    for shift, factor in ((16, 2246822507), (13, 3266489909)):
        z = ((z ^ (z >> np.uint64(shift))) * np.uint64(factor)) & low
    z ^= z >> np.uint64(16)
    return np.searchsorted(np.array(POISSON_STEPS, np.uint64), z.ravel(), side="right").reshape(z.shape).astype(float)


#: Where the weight rises by one on the scale of a 32-bit hash.
POISSON_STEPS = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(9)]


def bootstrap_slices(rows: DataFrame, id_col: str, value: str, slices: Column, replicates: int, seed: int, level: float = 0.95) -> DataFrame:
    """``slice, n, mean, low, high, low_all, high_all``: bootstrap intervals of the mean of every slice, and those corrected for their number.

    ``slices`` lists the labels of a row.  Each row weighs in each replicate by a draw from its own hash, so a task adds up one sketch of
    ``replicates`` sums a slice and only sketches travel; no row meets another one.
    """
    names = ["slice", "n", "total", "sums", "weights"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for b in batches:
            ids, x = b.column(0).to_numpy(), b.column(1).to_numpy()
            labels = b.column(2).to_pylist()
            for at in range(0, len(ids), 128):
                w = poisson_weights(ids[at : at + 128], replicates, seed)
                known = {s: k for k, s in enumerate(sorted({s for row in labels[at : at + 128] for s in row}))}
                which = np.zeros((len(known), len(w)))
                for i, row in enumerate(labels[at : at + 128]):
                    which[[known[s] for s in row], i] = 1
                mine = x[at : at + 128]
                for s, n, total, sums, weights in zip(known, which.sum(axis=1), which @ mine, (which * mine) @ w, which @ w):
                    was = held.get(s)
                    held[s] = [n, total, sums, weights] if was is None else [p + q for p, q in zip(was, (n, total, sums, weights))]
        cols = list(zip(*((s, int(v[0]), float(v[1]), v[2].tolist(), v[3].tolist()) for s, v in held.items()))) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())))], names)

    def joined(key, frame: pd.DataFrame) -> pd.DataFrame:
        """The sketches of one slice, one a task, as its sorted replicate means."""
        sums, weights = (np.sum(np.stack(frame[c].to_list()), axis=0) for c in ("sums", "weights"))
        n = int(frame["n"].sum())
        means = np.sort(sums[weights > 0] / weights[weights > 0])
        return pd.DataFrame({"slice": [key[0]], "n": [n], "mean": [frame["total"].sum() / n], "means": [means]})

    part = rows.where(F.col(value).isNotNull()).select(F.col(id_col).cast("long"), F.col(value).cast("double"), slices).mapInArrow(sketch, "slice string, n long, total double, sums array<double>, weights array<double>")
    g = part.groupBy("slice").applyInPandas(joined, "slice string, n long, mean double, means array<double>")
    g = g.withColumn("k", F.count("*").over(Window.partitionBy(F.lit(0))))

    def at(share: Column) -> Column:
        spot = share * (F.size("means") - 1)
        lo = F.floor(spot).cast("int")
        a, b = F.element_at("means", lo + 1), F.element_at("means", F.least(lo + 2, F.size("means")))
        return a + (b - a) * (spot - lo)

    tail = F.lit((1 - level) / 2)
    return g.select("slice", "n", "mean", at(tail).alias("low"), at(1 - tail).alias("high"), at(tail / F.col("k")).alias("low_all"), at(1 - tail / F.col("k")).alias("high_all"))


def interval(means: DataFrame, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    return means.agg(F.count("*").alias("replicates"), F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))


def positions(df: DataFrame, order: str, keys: list[str] = []) -> DataFrame:
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(order)
    return df.withColumn("pos", F.row_number().over(w) - 1)


def newey_west(series: DataFrame, value: str, order: str, lag: int, keys: list[str] = []) -> DataFrame:
    """Bartlett-weighted t of the mean of an ordered series; one row per session and key."""
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part)
    o = w.orderBy(order)
    s = series.where(F.col(value).isNotNull())
    e = s.select(*keys, order, value, (F.col(value) - F.avg(value).over(w)).alias("_e"))
    e = e.select("*", *[F.lag("_e", k).over(o).alias(f"_l{k}") for k in range(1, lag + 1)])
    g = e.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.sum(F.col("_e") * F.col("_e")).alias("_s0"),
                             *[F.sum(F.col("_e") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lag + 1)])
    n = F.col("n")
    var = F.col("_s0") / n
    for k in range(1, lag + 1):
        var = var + F.when(n > k, 2 * (1 - k / (lag + 1)) * F.coalesce(F.col(f"_s{k}"), F.lit(0.0)) / n).otherwise(0.0)
    return g.select(*keys, "n", "mean", F.when(var > 0, F.col("mean") / F.sqrt(var / n)).alias("t"))


def ols_newey_west(series: DataFrame, y: str, x: str, order: str, lag: int, keys: list[str] = []) -> DataFrame:
    """Alpha and beta of y on x with Newey-West errors, from moments of the residual series."""
    part = keys or [F.lit(0)]
    w = Window.partitionBy(*part)
    s = series.select(*keys, order, F.col(y).alias("_y"), F.col(x).alias("_x")).where("_y is not null and _x is not null")
    s = s.select("*", F.regr_slope("_y", "_x").over(w).alias("_b"), F.regr_intercept("_y", "_x").over(w).alias("_a"))
    s = s.withColumn("_u", F.col("_y") - F.col("_a") - F.col("_b") * F.col("_x")).withColumn("_v", F.col("_u") * F.col("_x"))
    o = w.orderBy(order)
    s = s.select("*", *[F.lag(c, k).over(o).alias(f"{c}{k}") for c in ("_u", "_v") for k in range(1, lag + 1)])
    weight = lambda k: 1 - k / (lag + 1)
    s00, s01, s11 = F.col("_u") * F.col("_u"), F.col("_u") * F.col("_v"), F.col("_v") * F.col("_v")
    for k in range(1, lag + 1):
        u, v = F.coalesce(f"_u{k}", F.lit(0.0)), F.coalesce(f"_v{k}", F.lit(0.0))
        s00 = s00 + 2 * weight(k) * F.col("_u") * u
        s01 = s01 + weight(k) * (F.col("_u") * v + F.col("_v") * u)
        s11 = s11 + 2 * weight(k) * F.col("_v") * v
    g = s.groupBy(*keys).agg(F.count("*").alias("n"), F.first("_a").alias("alpha"), F.first("_b").alias("beta"), F.sum("_x").alias("sx"),
                             F.sum(F.col("_x") * F.col("_x")).alias("sxx"), F.sum(s00).alias("m00"), F.sum(s01).alias("m01"), F.sum(s11).alias("m11"))
    n, sx, sxx, m00, m01, m11 = (F.col(c) for c in ("n", "sx", "sxx", "m00", "m01", "m11"))
    det = n * sxx - sx * sx
    var_a = (sxx * sxx * m00 - 2 * sxx * sx * m01 + sx * sx * m11) / (det * det)
    var_b = (sx * sx * m00 - 2 * n * sx * m01 + n * n * m11) / (det * det)
    return g.select(*keys, "n", "alpha", "beta", (F.col("alpha") / F.sqrt(var_a)).alias("t_alpha"), (F.col("beta") / F.sqrt(var_b)).alias("t_beta"))


# --- forecast losses --------------------------------------------------------------------------------------------

def brier(y: Column, p: Column) -> Column:
    return (p - y) * (p - y)


def log_loss(y: Column, p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return -(y * F.ln(q) + (1 - y) * F.ln(1 - q))


def qlike(real: Column, forecast: Column, floor: float = 1e-8) -> Column:
    x = F.pow(F.greatest(real, F.lit(floor)) / F.greatest(forecast, F.lit(floor)), F.lit(2.0))
    return x - F.ln(x) - 1


def auc(df: DataFrame, keys: list[str], y: str, p: str) -> DataFrame:
    """Area under the ROC curve by average ranks; forecasts equal to ten places are tied."""
    v = running_counts(df.withColumn(p, F.round(p, 10)), keys, p, {"c1": F.col(y).cast("double")})
    rank = F.col("below") + (F.col("count") + 1) / 2
    g = v.withColumn("_r", rank).groupBy(*keys).agg(F.sum(F.col("_r") * F.col("c1")).alias("r1"), F.sum("c1").alias("n1"), F.sum("count").alias("n"))
    n1, n0 = F.col("n1"), F.col("n") - F.col("n1")
    return g.select(*keys, F.when((n1 > 0) & (n0 > 0), (F.col("r1") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def calibration(df: DataFrame, keys: list[str], y: str, p: str, bins: int = 10) -> DataFrame:
    """Mean forecast and outcome per quantile bin of the forecast; equal edges merge."""
    names = [f"q{i}" for i in range(bins + 1)]
    edges = quantiles(df, keys, p, {n: i / bins for i, n in enumerate(names)}).select(*keys, F.array_distinct(F.array(*names)).alias("edges"))
    j = df.join(edges, keys)
    # Bins are right-closed; the first one also takes its left edge.
    above = F.size(F.filter("edges", lambda e: e < F.col(p)))
    return j.withColumn("bin", F.greatest(above - 1, F.lit(0))).groupBy(*keys, "bin").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("mean_y"))


def calibration_error(table: DataFrame, keys: list[str]) -> DataFrame:
    n, p, y = F.col("n"), F.col("mean_p"), F.col("mean_y")
    return table.groupBy(*keys).agg((F.sum(n * F.abs(y - p)) / F.nullif(F.sum(n * p), F.lit(0.0))).alias("calibration_error"))


def skill(loss: Column, reference: Column) -> Column:
    return F.when(reference > 0, 1 - loss / reference)


def clustered_difference(df: DataFrame, keys: list[str], a: str, b: str, lag: int) -> DataFrame:
    """Loss difference averaged per date, then tested as a time series."""
    per_date = df.groupBy(*keys, "date").agg(F.avg(F.col(a) - F.col(b)).alias("d"))
    return newey_west(per_date, "d", "date", lag, keys)
