"""As-of joins at session grain.

A naive as-of window over (key, time) puts all left rows of one key in one task.
Here the left side is first reduced to its distinct (key, time) pairs, which is
a map-side-combined aggregation bounded by keys x sessions; the window runs over
that small set, and the result goes back to the left rows through an equi-join on
(key, time), which spreads a hot key over its times.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def asof_map(
    points: DataFrame,
    right: DataFrame,
    key: str | None,
    on: str,
    right_on: str,
    columns: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
) -> DataFrame:
    """For each distinct (key, on) of ``points``, the nearest right row's columns.

    ``strict`` excludes a right row at the same time.  ``columns`` maps right
    column names to output names.  Right rows are unique per (key, right_on).
    """
    keys = [key] if key else []
    payload = F.struct(*[F.col(c).alias(o) for c, o in columns.items()])
    kind = right.select(payload.alias("p")).schema[0].dataType
    left = points.select(*keys, F.col(on).alias("_t")).where(F.col("_t").isNotNull()).distinct()
    both = left.select(*keys, "_t", F.lit(None).cast(kind).alias("_p"), F.lit(1).alias("_left")).unionByName(
        right.select(*keys, F.col(right_on).alias("_t"), payload.alias("_p"), F.lit(0).alias("_left"))
    )
    time = F.col("_t").asc() if direction == "backward" else F.col("_t").desc()
    side_order = F.col("_left").desc() if strict else F.col("_left").asc()
    w = Window.partitionBy(*keys).orderBy(time, side_order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_hit", F.last("_p", ignorenulls=True).over(w)).where("_left = 1")
    return found.select(*keys, F.col("_t").alias(on), *[F.col(f"_hit.{o}").alias(o) for o in columns.values()])


def asof_join(
    left: DataFrame,
    right: DataFrame,
    key: str | None,
    on: str,
    right_on: str,
    columns: dict[str, str],
    direction: str = "backward",
    strict: bool = False,
    points: DataFrame | None = None,
) -> DataFrame:
    """Left join of ``left`` with the nearest right row on its key (see ``asof_map``).

    ``points`` names a cheaper table that holds every (key, on) of ``left``.  A chain
    of as-of joins passes the table it started from: otherwise each step would read
    the steps before it twice, and the plan would double with every join.
    """
    lookup = asof_map(left if points is None else points, right, key, on, right_on, columns, direction, strict)
    return left.join(lookup, ([key] if key else []) + [on], "left")
