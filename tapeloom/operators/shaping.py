"""Time-series shaping: resampling, calendar alignment, folds and splits."""

from __future__ import annotations

import datetime
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind


def week_ending(date: Column) -> Column:
    """The Friday that closes the week (Saturday to Friday) of a date."""
    return F.next_day(F.date_sub(date, 1), "FRI")


def weekly_bars(bars: DataFrame, min_sessions: int = 4) -> DataFrame:
    """Weekly OHLCV ending on Friday; a last week with too few sessions is dropped."""
    weeks = bars.groupBy("ticker", week_ending(F.col("date")).alias("week")).agg(
        F.min_by("open", "date").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "date").alias("close"), F.sum("volume").alias("volume"), F.count("*").alias("sessions"))
    last = F.max("week").over(Window.partitionBy("ticker"))
    return (weeks.withColumn("_last", last).where((F.col("sessions") >= min_sessions) | (F.col("week") < F.col("_last")))
            .drop("_last").withColumnRenamed("week", "date"))


def align_to_calendar(bars: DataFrame, sessions: DataFrame, max_fill: int = 5) -> DataFrame:
    """One row per ticker and session of the calendar.

    Missing sessions become flat bars at the last close for up to ``max_fill``
    sessions and are NULL beyond; volume is zero on filled bars.  The calendar is
    attached by session number: each bar is expanded to the sessions up to the
    next bar, so no tickers-by-sessions product is formed.
    """
    numbered = sessions.select("date").distinct().withColumn(
        "session", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")))
    w = Window.partitionBy("ticker").orderBy("session")
    held = (
        bars.join(numbered, "date")
        .withColumn("_next", F.lead("session").over(w))
        .withColumn("_first", F.row_number().over(w) == 1)
        .withColumn("_last", F.coalesce(F.col("_next") - 1, numbered.agg(F.max("session")).scalar()))
        .withColumn("_own", F.col("session"))
        .withColumn("_from", F.when(F.col("_first"), F.lit(1)).otherwise(F.col("session")))
        .withColumn("session", F.explode(F.sequence("_from", "_last")))
        .drop("date", "_next", "_first", "_last", "_from")
        .join(numbered, "session")
    )
    traded = F.col("session") == F.col("_own")
    gap = F.col("session") - F.col("_own")
    alive = (gap >= 0) & (gap <= max_fill)
    price = lambda c: F.when(traded, F.col(c)).when(alive, F.col("close"))
    return held.select(
        "ticker", "date", "session", price("open").alias("open"), price("high").alias("high"), price("low").alias("low"),
        F.when(alive, F.col("close")).alias("close"), F.when(traded, F.col("volume")).when(alive, 0.0).alias("volume"),
        traded.alias("traded"))


def drop_duplicates_keep_last(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the one with the highest version."""
    rest = [c for c in df.columns if c not in keys and c != version]
    return df.groupBy(*keys).agg(F.max(F.struct(version, *rest)).alias("_row")).select(*keys, "_row.*")


def month_ends(dates: DataFrame) -> DataFrame:
    """Last session of each month."""
    return dates.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("date").alias("date"))


def wide_close(bars: DataFrame, tickers: list[str]) -> DataFrame:
    """Dates by tickers matrix of closes for a named list of tickers."""
    return bars.groupBy("date").pivot("ticker", tickers).agg(F.first("close"))


def session_neighbours(days: DataFrame, holidays: list[str]) -> DataFrame:
    """For every calendar day: whether it trades, and the sessions before, on-or-before and after it."""
    is_session = ~F.dayofweek("day").isin(1, 7) & ~F.col("day").cast("string").isin(*holidays)
    w = Window.partitionBy(F.lit(0)).orderBy("day")
    s = F.when(F.col("is_session"), F.col("day"))
    return (days.withColumn("is_session", is_session)
            .withColumn("previous", F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
            .withColumn("on_or_before", F.last(s, True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
            .withColumn("next", F.last(s, True).over(Window.partitionBy(F.lit(0)).orderBy(F.col("day").desc()).rowsBetween(Window.unboundedPreceding, -1))))


def calendar_days(dates: DataFrame) -> DataFrame:
    """Every calendar day from the first to the last date of a table."""
    return dates.agg(F.min("date").alias("a"), F.max("date").alias("b")).select(
        F.explode(F.sequence("a", "b")).alias("day"))


def intraday_checkpoints(hourly: DataFrame, daily: DataFrame, hours: list[int]) -> DataFrame:
    """Cumulative volume and price at each hour cut-off, rescaled to the daily close."""
    w = Window.partitionBy("ticker", "day")
    cut = lambda h: F.col("hour") <= h
    day = hourly.groupBy("ticker", "day").agg(
        F.max_by("close", "hour").alias("last_hourly"),
        *[F.sum(F.when(cut(h), F.col("volume"))).alias(f"volume_{h}") for h in hours],
        *[F.max_by(F.when(cut(h), F.col("close")), F.when(cut(h), F.col("hour"))).alias(f"price_{h}") for h in hours])
    j = day.join(daily.select("ticker", F.col("date").alias("day"), "close"), ["ticker", "day"])
    scale = ind.ratio("close", "last_hourly")
    legs = F.array(*[F.struct(F.lit(h).alias("checkpoint"), F.col(f"volume_{h}").alias("cum_volume"),
                              (F.col(f"price_{h}") * scale).alias("price")) for h in hours])
    return j.select("ticker", "day", "close", F.explode(legs).alias("leg")).select("ticker", "day", "close", "leg.*").where(
        "cum_volume is not null")


def equal_folds(df: DataFrame, n: int, bounds: DataFrame | None = None) -> DataFrame:
    """Adds ``fold``: n equal spans of time over the table, the last one closed on the right."""
    span = (bounds if bounds is not None else df).agg(F.struct(F.min("date").alias("a"), F.max("date").alias("b"))).scalar()
    out = df.withColumn("_s", span)
    share = F.datediff("date", "_s.a") * n / F.nullif(F.datediff("_s.b", "_s.a"), F.lit(0))
    return out.withColumn("fold", F.least(F.floor(F.coalesce(share, F.lit(0.0))), F.lit(n - 1)).cast("int")).drop("_s")


def sliding_windows(dates: DataFrame, in_sample: int, out_sample: int, step: int) -> DataFrame:
    """In-sample/out-of-sample windows in months that fit inside the dates."""
    span = dates.agg(F.trunc(F.min("date"), "MM").alias("a"), F.max("date").alias("b"))
    n = F.floor(F.months_between("b", "a") / step).cast("int")
    w = span.select("b", "a", F.explode(F.sequence(F.lit(0), n)).alias("number"))
    start = F.add_months("a", F.col("number") * step)
    return w.select("number", start.alias("is_start"), F.add_months(start, in_sample).alias("is_end"),
                    F.add_months(start, in_sample + out_sample).alias("oos_end"), "b").where("oos_end <= b").drop("b")


def walk_forward_cuts(dates: DataFrame, years: list[int], embargo: int) -> DataFrame:
    """Per test year: the last training session, ``embargo`` sessions before the year starts."""
    s = dates.select("date").distinct().withColumn("pos", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")) - 1)
    first = s.where(F.year("date").isin(years)).groupBy(F.year("date").alias("year")).agg(F.min("pos").alias("first_pos"))
    cut = s.select(F.col("pos").alias("cut_pos"), F.col("date").alias("train_end"))
    return first.withColumn("cut_pos", F.col("first_pos") - embargo - 1).join(cut, "cut_pos").select("year", "train_end")


def walk_forward_splits(panel: DataFrame, years: list[int], embargo: int) -> DataFrame:
    """Rows of the panel labelled ``train`` or ``test`` for every test year they serve."""
    cuts = walk_forward_cuts(panel, years, embargo)
    # At most one row per requested year, so the range condition is tested against a handful of rows.
    cuts = cuts.withColumnRenamed("year", "test_year")
    test = F.year("date") == F.col("test_year")
    j = panel.join(F.broadcast(cuts), test | (F.col("date") <= F.col("train_end")))
    return j.withColumn("part", F.when(test, "test").otherwise("train"))


def year_folds(bars: DataFrame, min_sessions: int, last_n: int) -> DataFrame:
    """The last n years of each ticker that have enough sessions."""
    years = bars.groupBy("ticker", F.year("date").alias("year")).agg(F.count("*").alias("sessions"),
                                                                     F.min("date").alias("start"), F.max("date").alias("end"))
    w = Window.partitionBy("ticker").orderBy(F.col("year").desc())
    return years.where(F.col("sessions") >= min_sessions).withColumn("r", F.row_number().over(w)).where(F.col("r") <= last_n).drop("r")


def window_rows(bars: DataFrame, windows: DataFrame) -> DataFrame:
    """Out-of-sample bar count per window: bars are counted per session before the range join."""
    per_day = bars.groupBy("date").agg(F.count("*").alias("n"))
    return (per_day.join(F.broadcast(windows), (F.col("date") >= F.col("is_end")) & (F.col("date") < F.col("oos_end")))
            .groupBy("number", "is_start", "is_end", "oos_end").agg(F.sum("n").alias("rows")))


def newest_blocks(bars: DataFrame) -> DataFrame:
    """Monthly report blocks, newest first, ordered by the date parsed from their label."""
    blocks = bars.groupBy(F.date_format("date", "yyyyMM").alias("label")).agg(F.count("*").alias("rows"))
    dated = blocks.withColumn("run_date", F.to_date(F.concat("label", F.lit("01")), "yyyyMMdd"))
    return dated.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("run_date").desc())))


def exchange_holidays(years: Iterable[int]) -> list[str]:
    """Days without a session by rule: fixed days move to the next weekday, the others are counted weekdays or follow Easter."""

    def counted(year: int, month: int, nth: int) -> datetime.date:
        first = datetime.date(year, month, 1)
        return first + datetime.timedelta((7 - first.weekday()) % 7 + 7 * (nth - 1))

    def good_friday(year: int) -> datetime.date:
        century, golden = year // 100, year % 19
        epact = (century - century // 4 - (8 * century + 13) // 25 + 19 * golden + 15) % 30
        epact -= epact // 28 * (1 - 29 // (epact + 1) * ((21 - golden) // 11))
        moon = datetime.date(year, 3, 21) + datetime.timedelta(epact)
        return moon + datetime.timedelta(7 - (moon.weekday() + 1) % 7 - 2)

    out: set[datetime.date] = set()
    for y in years:
        victoria = datetime.date(y, 5, 24)
        days = [good_friday(y), victoria - datetime.timedelta(victoria.weekday()), counted(y, 8, 1), counted(y, 9, 1), counted(y, 10, 2)]
        days += [counted(y, 2, 3)] if y >= 2008 else []
        for fixed in (datetime.date(y, 1, 1), datetime.date(y, 7, 1), datetime.date(y, 12, 25), datetime.date(y, 12, 26)):
            while fixed.weekday() > 4 or fixed in days:
                fixed += datetime.timedelta(1)
            days.append(fixed)
        out.update(days)
    return sorted(d.isoformat() for d in out)
