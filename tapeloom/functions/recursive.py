"""Recursive averages without a sequential loop.

``y[t] = (1-a) y[t-1] + a x[t]`` with ``y[0] = x[0]`` is a weighted prefix sum,
``y[t] = q**t * sum(w[i] x[i] q**-i)`` with ``q = 1-a``.  The sum is taken inside
blocks of bars, so that ``q**-i`` never overflows; a block is long enough that
everything older than the previous block weighs less than 1e-19 of it, so one
carry from the previous block is exact in double precision.  Blocks are ordinary
window partitions: no Python worker and no sequential pass over a ticker.

Leading NULLs are skipped; the series starts at its first value.  A NULL inside a
series repeats the last average.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Largest exponent used inside a block, and the decay after which a carry is nil.
MAX_EXPONENT = 600.0
NIL_EXPONENT = 45.0
# An average this close to its input is the input: a constant series stays exactly constant.
SETTLED = 1e-13


def span(n: int) -> float:
    return 2.0 / (n + 1)


def wilder(n: int) -> float:
    return 1.0 / n


def _block_groups(alphas: list[float]) -> dict[float, int]:
    """Block length per alpha; neighbouring alphas share one where it stays exact."""
    lengths: dict[float, int] = {}
    current = None
    for a in sorted(set(alphas), reverse=True):
        decay = -math.log1p(-a)
        if current is None or current * decay < NIL_EXPONENT:
            current = int(MAX_EXPONENT / decay)
        lengths[a] = current
    return lengths


def averages(
    df: DataFrame, specs: dict[str, tuple[Column, float]], keys: list[str] = ["ticker"], order: str = "date"
) -> DataFrame:
    """Add one recursive average per ``name: (input column, alpha)``."""
    lengths = _block_groups([a for _, a in specs.values()])
    bar = Window.partitionBy(*keys).orderBy(order)
    so_far = bar.rowsBetween(Window.unboundedPreceding, 0)
    before = bar.rowsBetween(Window.unboundedPreceding, -1)
    keep = df.columns
    out = df.select("*", *[x.alias(f"_x_{n}") for n, (x, _) in specs.items()])
    out = out.select(
        "*", *[(F.count(f"_x_{n}").over(so_far) - 1).alias(f"_p_{n}") for n in specs], F.row_number().over(bar).alias("_rn")
    )
    # The block id follows the bar number, so specs that start on different bars share blocks.
    for size in set(lengths.values()):
        out = out.withColumn(f"_b_{size}", F.floor((F.col("_rn") - 1) / size))
    local, final = [], []
    for n, (_, a) in specs.items():
        q, size = 1.0 - a, lengths[a]
        j = ((F.col("_rn") - 1) % size).cast("double")
        w = Window.partitionBy(*keys, f"_b_{size}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        seeded = F.when(F.col(f"_p_{n}") == 0, F.col(f"_x_{n}")).otherwise(F.col(f"_x_{n}") * a)
        total = F.sum(seeded * F.pow(F.lit(q), -j)).over(w)
        local.append((F.pow(F.lit(q), j) * F.coalesce(total, F.lit(0.0))).alias(f"_l_{n}"))
        carry = F.last(F.when(j == size - 1, F.col(f"_l_{n}")), ignorenulls=True).over(before)
        y = F.col(f"_l_{n}") + F.pow(F.lit(q), j + 1) * F.coalesce(carry, F.lit(0.0))
        x = F.col(f"_x_{n}")
        settled = F.when(F.abs(y - x) <= F.abs(x) * SETTLED, x).otherwise(y)
        final.append(F.when(F.col(f"_p_{n}") >= 0, settled).alias(n))
    return out.select("*", *local).select(*keep, *final)


def ema(df: DataFrame, name: str, value: Column | str, n: int) -> DataFrame:
    return averages(df, {name: (F.col(value) if isinstance(value, str) else value, span(n))})


def macd(df: DataFrame, close: str = "close", prefix: str = "macd") -> DataFrame:
    """MACD(12, 26, 9): adds <prefix>_line, <prefix>_signal and <prefix>_hist."""
    line, signal = f"{prefix}_line", f"{prefix}_signal"
    out = averages(df, {"_fast": (F.col(close), span(12)), "_slow": (F.col(close), span(26))})
    out = out.withColumn(line, F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    out = averages(out, {signal: (F.col(line), span(9))})
    return out.withColumn(f"{prefix}_hist", F.col(line) - F.col(signal))


def averages_with_gaps(
    df: DataFrame, specs: dict[str, tuple[Column, float]], keys: list[str] = ["ticker"], order: str = "date"
) -> DataFrame:
    """Recursive averages over series with NULLs inside: the old weight keeps decaying through a gap.

    After a gap of g rows, ``y = (q**g y' + a x) / (q**g + a)``: the same blocked
    prefix sum with a factor that varies by row, held as a running log.
    """
    lengths = _block_groups([a for _, a in specs.values()])
    bar = Window.partitionBy(*keys).orderBy(order)
    before = bar.rowsBetween(Window.unboundedPreceding, -1)
    keep = df.columns
    out = df.select("*", F.row_number().over(bar).alias("_rn"), *[x.alias(f"_x_{n}") for n, (x, _) in specs.items()])
    out = out.select("*", *[F.last(F.when(F.col(f"_x_{n}").isNotNull(), F.col("_rn")), True).over(before).alias(f"_v_{n}") for n in specs])
    for size in set(lengths.values()):
        out = out.withColumn(f"_b_{size}", F.floor((F.col("_rn") - 1) / size))
    block = lambda n: Window.partitionBy(*keys, f"_b_{lengths[specs[n][1]]}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    logs = []
    for n, (_, a) in specs.items():
        gap = F.col("_rn") - F.col(f"_v_{n}")
        seen, first = F.col(f"_x_{n}").isNotNull(), F.col(f"_v_{n}").isNull()
        total = F.pow(F.lit(1.0 - a), gap) + a
        step = F.when(seen & ~first, gap * math.log1p(-a) - F.ln(total)).otherwise(0.0)
        share = F.when(seen, F.when(first, F.col(f"_x_{n}")).otherwise(F.col(f"_x_{n}") * a / total))
        logs += [F.sum(step).over(block(n)).alias(f"_c_{n}"), share.alias(f"_s_{n}")]
    out = out.select("*", *logs)
    out = out.select("*", *[(F.exp(f"_c_{n}") * F.coalesce(F.sum(F.col(f"_s_{n}") * F.exp(-F.col(f"_c_{n}"))).over(block(n)), F.lit(0.0))).alias(f"_l_{n}")
                            for n in specs])
    final = []
    for n, (_, a) in specs.items():
        size = lengths[a]
        carry = F.last(F.when((F.col("_rn") - 1) % size == size - 1, F.col(f"_l_{n}")), True).over(before)
        y = F.col(f"_l_{n}") + F.exp(f"_c_{n}") * F.coalesce(carry, F.lit(0.0))
        final.append(F.when(F.col(f"_x_{n}").isNotNull() | F.col(f"_v_{n}").isNotNull(), y).alias(n))
    return out.select(*keep, *final)
