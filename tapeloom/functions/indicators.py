"""Indicator columns over ordered bars.

Each function returns a ``Column`` over ``Window.partitionBy("ticker").orderBy("date")``,
so indicators of one query share one shuffle and one sort.  A partition holds one
row per session of a ticker and is bounded by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

def by_bar() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("date")


def rows(start: int, end: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or by_bar()).rowsBetween(start, end)


def to_date(w: WindowSpec | None = None) -> WindowSpec:
    """All rows up to and including the current one."""
    return (w or by_bar()).rowsBetween(Window.unboundedPreceding, 0)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """``a / b`` in IEEE doubles: infinite over zero, NaN for 0 / 0, where Spark's own division fails.

    A price that has fallen under half of its last decimal is stored as 0, and any price may be a divisor.
    """
    a, b = col(a).cast("double"), col(b).cast("double")
    return F.when(b != 0, a / b).otherwise(a * F.when(b == 0, F.lit(float("inf"))))


def whole(c: Column) -> Column:
    """The floor as a double.  ``F.floor`` gives a long and cuts off at 2**63; from 2**53 on every double is whole."""
    return F.when(F.abs(c) < 2.0**53, F.floor(c).cast("double")).otherwise(c)


def lag(c, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(col(c), n).over(w or by_bar())


def lead(c, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lead(col(c), n).over(w or by_bar())


def full(value: Column, c, frame: WindowSpec, n: int) -> Column:
    """``value`` once the frame holds ``n`` non-null inputs, else NULL."""
    return F.when(F.count(col(c)).over(frame) >= n, value)


def sma(c, n: int, w: WindowSpec | None = None) -> Column:
    f = rows(-(n - 1), 0, w)
    return full(F.avg(col(c)).over(f), c, f, n)


def prior_mean(c, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    """Mean of the n bars before the current one."""
    f = rows(-n, -1, w)
    return full(F.avg(col(c)).over(f), c, f, need or n)


def prior_max(c, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    f = rows(-n, -1, w)
    return full(F.max(col(c)).over(f), c, f, need or n)


def prior_min(c, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    f = rows(-n, -1, w)
    return full(F.min(col(c)).over(f), c, f, need or n)


def rolling_max(c, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    f = rows(-(n - 1), 0, w)
    return full(F.max(col(c)).over(f), c, f, need or n)


def rolling_min(c, n: int, need: int | None = None, w: WindowSpec | None = None) -> Column:
    f = rows(-(n - 1), 0, w)
    return full(F.min(col(c)).over(f), c, f, need or n)


def rolling_std(c, n: int, w: WindowSpec | None = None) -> Column:
    f = rows(-(n - 1), 0, w)
    return full(F.stddev_samp(col(c)).over(f), c, f, n)


def bar_number(w: WindowSpec | None = None) -> Column:
    return F.row_number().over(w or by_bar())


def true_range(w: WindowSpec | None = None) -> Column:
    """Largest of high-low and the two gaps from the prior close; high-low on the first bar."""
    prior = lag("close", 1, w)
    h, l = F.col("high"), F.col("low")
    return F.greatest(h - l, F.abs(h - prior), F.abs(l - prior))


def change_pct(c="close", n: int = 1, w: WindowSpec | None = None) -> Column:
    return ratio(c, lag(c, n, w)) - 1


def norm_slope(c, n: int, position: str = "bar", w: WindowSpec | None = None, signed: bool = False) -> Column:
    """Least-squares slope over n bars divided by the mean level, NULL when short.

    ``signed`` divides by the signed mean, otherwise by its absolute value.
    """
    f = rows(-(n - 1), 0, w)
    mean = F.avg(col(c)).over(f)
    level = mean if signed else F.abs(mean)
    at = F.col(position) if position == "bar" else col(position)
    slope = F.regr_slope(col(c), at.cast("double")).over(f)
    return full(slope / (level + F.lit(1e-9)), c, f, n)


def centred_rank(c, keys: list[str]) -> Column:
    """Percentile rank within ``keys``, ties averaged, centred on zero."""
    w = Window.partitionBy(*keys)
    ties = F.count("*").over(w.partitionBy(*keys, c))
    return (F.rank().over(w.orderBy(c)) + (ties - 1) / 2) / F.count("*").over(w) - 0.5


def percentile_of_score(c, keys: list[str]) -> Column:
    """Percentile of each value in its own group, counting ties half below and half above."""
    w = Window.partitionBy(*keys)
    below = F.rank().over(w.orderBy(c)) - 1
    ties = F.count("*").over(w.partitionBy(*keys, c))
    return (2 * below + ties + 1) * 50.0 / F.count("*").over(w)
