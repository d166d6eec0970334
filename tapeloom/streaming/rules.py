"""The collectors' polling rules as streams.

Aggregating rules keep their state in the engine's own aggregation state, which
combines rows before the shuffle, or, where files may come in any order, count each
batch by itself and add the counts up on reading; only the signal state machine
needs Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.sources import bridge


def first_seen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Releases of a batch that no batch before it has seen, each once; nothing is ever forgotten."""
    once = batch.groupBy("guid").agg(F.min(F.struct("ts", "ticker")).alias("r")).select("guid", "r.ticker")
    return once.join(seen.select("guid"), "guid", "left_anti")


def repeated(releases: DataFrame) -> DataFrame:
    """Every release polled twice."""
    return releases.withColumn("poll", F.explode(F.array(F.lit(1), F.lit(2))))


def lane_of(releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Releases of a batch for the two lanes: high ones go at once, the rest into the bundle of their hour."""
    high = F.col("materiality") == "high"
    now = releases.where(high).select("guid", "ticker", "ts")
    bundled = releases.where(~F.coalesce(high, F.lit(False))).select("guid", "ticker", "ts", F.date_trunc("hour", "ts").alias("slot"))
    return now, bundled


def bundles(bundled: DataFrame) -> DataFrame:
    """One bundle per hour from what the batches put in: its releases in order, each once."""
    once = bundled.groupBy("guid").agg(F.min(F.struct("slot", "ts", "ticker")).alias("r")).select("guid", "r.*")
    return once.groupBy("slot").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.array_sort(F.collect_list("guid")).alias("guids"))


def with_arrival(releases: DataFrame) -> DataFrame:
    """Releases with the time they were collected, up to nine days after publication."""
    return releases.withColumn("arrived", F.col("ts") + F.make_dt_interval((F.col("guid") % 10).cast("int")))


def is_stale(days: int = 7) -> Column:
    return F.col("arrived") - F.col("ts") > F.expr(f"INTERVAL {days} DAYS")


def inbox_events(releases: DataFrame) -> DataFrame:
    """What moves the inbox: high releases and the reviews of them, as rows of one kind each."""
    review = F.when(F.col("guid") % 7 != 0, F.struct(F.lit("review").alias("kind"), (F.col("ts") + F.make_dt_interval((F.col("guid") % 12).cast("int"))).alias("at")))
    both = F.array(F.struct(F.lit("release").alias("kind"), F.col("ts").alias("at")), review)
    return releases.where("materiality = 'high'").select("user_id", "ticker", "guid", "category", F.explode(F.filter(both, lambda e: e.isNotNull())).alias("e")).select(
        "user_id", "ticker", "guid", "category", "e.kind", "e.at")


def inbox(events: DataFrame) -> DataFrame:
    """Items per user and ticker: releases collapse into the open one, the latest wins, and a review closes what is open.

    Events are put in order by their own time, so neither files in no order nor a batch that is run again change an item.
    """
    w = Window.partitionBy("user_id", "ticker").orderBy("at", "kind", "guid")
    is_review = (F.col("kind") == "review").cast("int")
    once = events.dropDuplicates(["user_id", "ticker", "kind", "guid"])
    placed = once.withColumn("reviews", F.coalesce(F.sum(is_review).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn(
        "closed", F.min(F.when(F.col("kind") == "review", F.col("at"))).over(w.rowsBetween(1, Window.unboundedFollowing)))
    newest = F.max(F.struct("at", "guid", "category"))
    return placed.where("kind = 'release'").groupBy("user_id", "ticker", "reviews").agg(newest.alias("r"), F.count("*").alias("collapsed"), F.max("closed").alias("closed")).select(
        "user_id", "ticker", "r.guid", "r.category", "collapsed", "closed", F.when(F.col("closed").isNull(), "open").otherwise("reviewed").alias("status"))


def reviews_of(releases: DataFrame) -> DataFrame:
    """When each item was reviewed: up to eleven days after publication, never for every seventh."""
    return releases.where("guid % 7 <> 0").select(F.col("guid").alias("r_guid"), (F.col("ts") + F.make_dt_interval((F.col("guid") % 12).cast("int"))).alias("reviewed"))


def expiry_events(releases: DataFrame) -> DataFrame:
    """Items and reviews of a batch as rows ``guid, ts, reviewed``."""
    items = releases.select("guid", "ts", F.lit(None).cast("timestamp").alias("reviewed"))
    return items.unionByName(reviews_of(releases).select(F.col("r_guid").alias("guid"), F.lit(None).cast("timestamp").alias("ts"), "reviewed"))


def expired(events: DataFrame, days: int = 7, delay: str = "1 HOUR") -> DataFrame:
    """Items with no review within ``days`` whose deadline the newest item has passed by ``delay``; a review may come before or after its item."""
    per_item = events.groupBy("guid").agg(F.min("ts").alias("ts"), F.min("reviewed").alias("reviewed"))
    newest = events.agg(F.max("ts")).scalar()
    deadline = F.col("ts") + F.expr(f"INTERVAL {days} DAYS")
    missed = F.col("reviewed").isNull() | (F.col("reviewed") > deadline)
    return per_item.where(F.col("ts").isNotNull() & missed & (deadline < newest - F.expr(f"INTERVAL {delay}"))).select("guid", "ts")


def watched_prices(ticks: DataFrame, items: DataFrame) -> DataFrame:
    """Prices of watched tickers from the day they were flagged: a stream joined to a table."""
    w = items.where("status = 'watching'").select(F.col("user_id"), "ticker", "flagged", F.col("guid").alias("item"))
    return ticks.join(w, ["user_id", "ticker"]).where(F.to_date("ts") >= F.col("flagged")).select("item", "guid", "ts", "value")


def session_volume(batch: DataFrame) -> DataFrame:
    """Volume of a batch by session."""
    return batch.groupBy("ticker", F.to_date("ts").alias("date")).agg(F.count("*").cast("double").alias("volume"))


def all_volume(parts: DataFrame) -> DataFrame:
    """Volume so far of each session."""
    return parts.groupBy("ticker", "date").agg(F.sum("volume").alias("volume"))


def first_triggers(ticks: DataFrame, intents: DataFrame) -> DataFrame:
    """First tick of the day that reaches its ticker's trigger; one intent per ticker and day."""
    t = ticks.withColumn("day", F.to_date("ts")).join(intents, ["ticker", "day"]).where("value >= trigger")
    return t.groupBy("ticker", "day").agg(F.min(F.struct("ts", "guid", "value")).alias("f")).select("ticker", "day", "f.guid", "f.value")


def daily_triggers(releases: DataFrame) -> DataFrame:
    """Pending intents: three times the mean value of the session before."""
    d = releases.groupBy("ticker", F.to_date("ts").alias("d")).agg(F.round(F.avg("value") * 3, 2).alias("trigger"))
    return d.select("ticker", F.date_add("d", 1).alias("day"), "trigger")


def merged_bursts(spans: DataFrame) -> DataFrame:
    """``user_id, ticker, start, end, n`` of spans that overlap made one."""
    w = Window.partitionBy("user_id", "ticker").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = spans.withColumn("apart", F.when(F.col("start") < before, 0).otherwise(1)).withColumn("k", F.sum("apart").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("user_id", "ticker", "k").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n")).drop("k")


def bursts(batch: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Bursts of releases of a batch per user and ticker, separated by a gap."""
    return merged_bursts(batch.select("user_id", "ticker", F.col("ts").alias("start"), (F.col("ts") + F.expr(f"INTERVAL {gap}")).alias("end"), F.lit(1).cast("long").alias("n")))


def closed_bursts(parts: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Bursts over all batches, in whatever order their releases came, that ended ``delay`` before the newest release."""
    newest = parts.agg(F.max("end")).scalar() - F.expr(f"INTERVAL {gap}")
    return merged_bursts(parts).where(F.col("end") <= newest - F.expr(f"INTERVAL {delay}"))


def pick_flag_day(scanned: DataFrame, sent: DataFrame, backfill: int = 5) -> DataFrame:
    """Newest scanned day not yet sent, looking back at most ``backfill`` days from the newest scan."""
    newest = scanned.agg(F.max("day")).scalar()
    todo = scanned.where(F.col("day") >= F.date_sub(newest, backfill)).join(sent, "day", "left_anti")
    return todo.agg(F.max("day").alias("day"))


def settle(batch: DataFrame, outcomes: DataFrame, before: DataFrame, grace: int, as_of: str) -> DataFrame:
    """``guid, ts, status`` of new releases and of those still pending: complete, no_data after the grace period, else pending.

    ``before(guid, ts, status, batch)`` holds what earlier batches wrote; the newest status of a release counts, and a final one stays.
    """
    known = before.groupBy("guid").agg(F.max_by(F.struct("ts", "status"), "batch").alias("k")).select("guid", "k.*")
    todo = batch.select("guid", "ts").join(known.select("guid"), "guid", "left_anti").unionByName(known.where("status = 'pending'").select("guid", "ts")).dropDuplicates(["guid"])
    j = todo.join(outcomes.select("guid", "complete"), "guid", "left")
    old = F.datediff(F.lit(as_of).cast("date"), F.to_date("ts")) > grace
    return j.select("guid", "ts", F.when(F.coalesce("complete", F.lit(False)), "complete").when(old, "no_data").otherwise("pending").alias("status"))


STATE = "state string, days int, first_seen date"
OUT = "ticker string, pattern string, date date, state string, days_in_state int, first_seen date, changed boolean"


def advance(key: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State machine of one (ticker, pattern): days in state and first sighting, one row per session."""
    rows = pd.concat(list(chunks)).sort_values("date")
    current, days, first = state.get if state.exists else (None, 0, None)
    out = []
    for day, new in zip(rows["date"], rows["state"]):
        changed = new != current
        days = 1 if changed else days + 1
        current, first = new, first or day
        out.append((key[0], key[1], day, current, days, first, changed))
    state.update((current, days, first))
    yield pd.DataFrame(out, columns=["ticker", "pattern", "date", "state", "days_in_state", "first_seen", "changed"])


def signal_states(signals: DataFrame) -> DataFrame:
    """Streaming twin of the batch state history; sessions of a key arrive in order."""
    return signals.groupBy("ticker", "pattern").applyInPandasWithState(advance, OUT, STATE, "append", "NoTimeout")


def release_stream(events: DataFrame) -> DataFrame:
    """Releases of an event stream; event time needs an instant, so wall-clock times take the session's zone."""
    return bridge.releases(events.withColumn("ts", F.col("ts").cast("timestamp")))
