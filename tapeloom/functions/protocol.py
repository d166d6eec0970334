"""How a user adds a screen: any function from bars to (ticker, date, label) rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Screen = Callable[[DataFrame], DataFrame]


def run_screens(bars: DataFrame, screens: dict[str, Screen]) -> DataFrame:
    """Rows of every screen, tagged with its name; a screen that returns other columns is refused."""
    out = None
    for name, screen in screens.items():
        rows = bars.transform(screen)
        missing = {"ticker", "date", "label"} - set(rows.columns)
        if missing:
            raise ValueError(f"screen {name} lacks {sorted(missing)}")
        part = rows.select(F.lit(name).alias("screen"), "ticker", "date", F.col("label").cast("string").alias("label"))
        out = part if out is None else out.unionByName(part)
    return out
