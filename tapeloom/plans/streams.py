"""Streaming queries: each runs over the event file that is available now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import indicators as ind
from tapeloom.operators import notes, patterns, studies
from tapeloom.plans.patterns import BEST
from tapeloom.plans.registry import query
from tapeloom.plans.studies import O as OUTCOMES
from tapeloom.sources.tables import Tables
from tapeloom.sources.workspace import work_folder
from tapeloom.streaming import rules
from tapeloom.streaming.runtime import earlier, folder_stream, run_append, run_batches, run_latest, run_parts, table_stream, write_version


def stream(t: Tables) -> DataFrame:
    return rules.release_stream(table_stream(t.spark, t.directory, "events"))


def exactly_once(releases: DataFrame, folder: str | None = None) -> DataFrame:
    """Releases as they were first polled; the table of the seen ones is what earlier batches wrote."""
    spark = releases.sparkSession

    def each(df: DataFrame, i: int, out: str) -> None:
        write_version(rules.first_seen(df, earlier(spark, out, i, "guid bigint, ticker string")), i, out)

    return spark.read.parquet(f"{run_batches(releases, 'r1', each, folder=folder)}/rows").select("guid", "ticker")


query("r1_exactly_once_items", "guid:i ticker", "WITH @releases SELECT guid, ticker FROM releases")(lambda t: exactly_once(rules.repeated(stream(t))))
def routed(releases: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The tables of the two lanes; a batch that is run again replaces what it put into either."""
    def each(df: DataFrame, i: int, out: str) -> None:
        df = df.persist()
        for rows, lane in zip(rules.lane_of(df), ("now", "hourly")):
            write_version(rows, i, out, lane)
        df.unpersist()

    out = run_batches(releases, "r2", each, folder=folder)
    return tuple(releases.sparkSession.read.parquet(f"{out}/{lane}").drop("batch") for lane in ("now", "hourly"))


def both_lanes(t: Tables) -> DataFrame:
    now, hourly = routed(stream(t))
    one = now.select(F.lit("now").alias("lane"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("slot"), F.lit(1).alias("n"), F.col("guid").alias("newest"), "guid")
    rest = rules.bundles(hourly).select(F.lit("hourly").alias("lane"), F.date_format("slot", "yyyy-MM-dd HH:mm:ss").alias("slot"), "n", F.element_at("guids", -1).alias("newest"), F.explode("guids").alias("guid"))
    return one.unionByName(rest)


query("r2_two_lanes", "lane slot n:i newest:i guid:i",
      """WITH @releases SELECT 'now' AS lane, strftime(ts, '%Y-%m-%d %H:%M:%S') AS slot, 1 AS n, guid AS newest, guid FROM releases WHERE materiality = 'high'
      UNION ALL SELECT 'hourly', strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S'), count(*) OVER w, max(guid) OVER w, guid FROM releases WHERE materiality IS DISTINCT FROM 'high' WINDOW w AS (PARTITION BY date_trunc('hour', ts))""")(both_lanes)


def late_split(t: Tables) -> DataFrame:
    """Fresh and stale releases as two outputs of one pass."""
    def each(df: DataFrame, i: int, folder: str) -> None:
        df = df.persist()
        write_version(df.where(~rules.is_stale()).select("guid"), i, folder, "fresh")
        write_version(df.where(rules.is_stale()).select("guid"), i, folder, "stale")
        df.unpersist()

    out = run_batches(rules.with_arrival(stream(t)), "r3", each)
    read = lambda part: t.spark.read.parquet(f"{out}/{part}").select("guid", F.lit(part).alias("output"))
    return read("fresh").unionByName(read("stale"))


query("r3_late_drop", "guid:i output", "WITH @releases SELECT guid, CASE WHEN guid % 10 > 7 THEN 'stale' ELSE 'fresh' END AS output FROM releases")(late_split)
query("r4_inbox_collapse", "user_id:i ticker guid:i category collapsed:i status closed",
      """WITH @releases, h AS (SELECT * FROM releases WHERE materiality = 'high'),
      e AS (SELECT user_id, ticker, guid, category, 'release' AS kind, ts AS tm FROM h UNION ALL SELECT user_id, ticker, guid, category, 'review', ts + to_days((guid % 12) :: INT) FROM h WHERE guid % 7 <> 0),
      p AS (SELECT *, coalesce(count_if(kind = 'review') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reviews,
        min(CASE WHEN kind = 'review' THEN tm END) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS closed FROM e WINDOW w AS (PARTITION BY user_id, ticker ORDER BY tm, kind, guid))
      SELECT user_id, ticker, max_by(guid, (tm, guid)) AS guid, max_by(category, (tm, guid)) AS category, count(*) AS collapsed, CASE WHEN max(closed) IS NULL THEN 'open' ELSE 'reviewed' END AS status,
        strftime(max(closed), '%Y-%m-%d %H:%M:%S.%f') AS closed FROM p WHERE kind = 'release' GROUP BY user_id, ticker, reviews""")(
    lambda t: run_parts(stream(t), "r4", rules.inbox_events, rules.inbox).withColumn("closed", F.date_format("closed", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
query("r5_state_expiry", "guid:i",
      """WITH @releases SELECT guid FROM releases WHERE (guid % 7 = 0 OR guid % 12 > 7) AND ts + INTERVAL 7 DAY < (SELECT max(ts) FROM releases) - INTERVAL 1 HOUR""")(
    lambda t: run_parts(stream(t), "r5", rules.expiry_events, rules.expired))
query("r6_watched_prices", "item:i guid:i value:f",
      "WITH @releases, @hourly, @day_bars, @watch SELECT w.guid AS item, r.guid, r.value FROM releases r JOIN watch w ON w.user_id = r.user_id AND w.ticker = r.ticker AND status = 'watching' AND r.ts :: DATE >= flagged")(
    lambda t: run_append(rules.watched_prices(stream(t), notes.watch_items(t.releases)), "r6"))


def state_machine(t: Tables) -> DataFrame:
    """Best patterns replayed in three slices of sessions; the stream stops after each and goes on from its checkpoint."""
    best = patterns.best_pattern(patterns.all_patterns(t.bars)).select("ticker", "pattern", "date", "state").persist()
    slices, out = work_folder(t.spark, "r7-input"), work_folder(t.spark, "r7")
    cuts = ["1900-01-01", "1997-01-01", "1999-01-01", "2100-01-01"]
    for a, b in zip(cuts, cuts[1:]):
        part = best.where((F.col("date") >= F.lit(a).cast("date")) & (F.col("date") < F.lit(b).cast("date")))
        part.write.mode("append").parquet(slices)
        rows = run_append(rules.signal_states(folder_stream(t.spark, slices, best.schema, 100_000)), "r7", out)
    best.unpersist()
    return rows


query("r7_signal_state_machine", "ticker pattern date:d state days_in_state:i first_seen:d changed:b", f"WITH {BEST}, @states SELECT * FROM states")(state_machine)


def settled(t: Tables) -> DataFrame:
    """Outcome statuses: pending releases are looked at again in every batch until they are settled."""
    outcomes = studies.outcomes(t).select("guid", "complete")
    return statuses(stream(t).select("guid", "ts"), outcomes)


def statuses(releases: DataFrame, outcomes: DataFrame, folder: str | None = None, as_of: str = "2024-01-31") -> DataFrame:
    spark = releases.sparkSession

    def each(df: DataFrame, i: int, out: str) -> None:
        write_version(rules.settle(df, outcomes, earlier(spark, out, i, "guid bigint, ts timestamp, status string"), 14, as_of), i, out)

    rows = spark.read.parquet(f"{run_batches(releases, 'r8', each, folder=folder)}/rows")
    return rows.groupBy("guid").agg(F.max_by("status", "batch").alias("status"))


query("r8_outcome_status", "guid:i status",
      f"WITH {OUTCOMES} SELECT r.guid, CASE WHEN coalesce(o.complete, false) THEN 'complete' WHEN DATE '2024-01-31' - r.ts :: DATE > 14 THEN 'no_data' ELSE 'pending' END AS status FROM releases r LEFT JOIN outcomes o USING (guid)")(settled)
query("r9_session_volume", "ticker date:d volume:f avg_volume:f hot:b",
      "WITH @hourly, @day_bars, a AS (SELECT ticker, date, avg(volume) OVER[-20,-1] AS avg_volume, count(*) OVER[-20,-1] AS n, volume FROM day_bars) SELECT ticker, date, volume, avg_volume, volume > avg_volume AS hot FROM a WHERE n > 0")(
    lambda t: run_parts(stream(t), "r9", rules.session_volume, rules.all_volume).join(
        t.day_bars.select("ticker", "date", F.avg("volume").over(ind.rows(-20, -1)).alias("avg_volume")).where("avg_volume is not null"), ["ticker", "date"]).withColumn("hot", F.col("volume") > F.col("avg_volume")))
query("r10_first_triggers", "ticker day:d guid:i value:f",
      """WITH @releases, i AS (SELECT ticker, ts :: DATE + 1 AS day, round(avg(value) * 3, 2) AS trigger FROM releases GROUP BY ticker, ts :: DATE)
      SELECT r.ticker, i.day, min_by(guid, (ts, guid)) AS guid, min_by(value, (ts, guid)) AS value FROM releases r JOIN i ON i.ticker = r.ticker AND i.day = r.ts :: DATE AND value >= trigger GROUP BY 1, 2""")(
    lambda t: run_latest(rules.first_triggers(stream(t), rules.daily_triggers(t.releases)), "r10", ["ticker", "day"]))


def flag_day(t: Tables) -> DataFrame:
    """The day to send after each batch, never one already sent: the days sent before the start, and those of earlier batches."""
    day = F.col("ts").cast("date").alias("day")
    before = t.releases.where(F.dayofmonth("ts") % 3 == 0).select(day).distinct()

    def each(df: DataFrame, i: int, out: str) -> None:
        scanned = df.where("materiality = 'high'").select(day).distinct()
        sent = before.union(earlier(t.spark, out, i, "day date").where("day is not null").select("day")).distinct()
        write_version(rules.pick_flag_day(scanned, sent), i, out)

    return t.spark.read.parquet(f"{run_batches(stream(t), 'r11', each)}/rows").select("day")


query("r11_flag_day", "day:d",
      """WITH @releases, s AS (SELECT DISTINCT ts :: DATE AS day FROM releases WHERE materiality = 'high') SELECT max(day) AS day FROM s WHERE day(day) % 3 <> 0 AND day >= (SELECT max(day) FROM s) - 5""")(flag_day)
query("r12_release_bursts", "user_id:i ticker start n:i",
      """WITH @releases, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM releases WINDOW w AS (PARTITION BY user_id, ticker ORDER BY ts, guid)),
      h AS (SELECT *, sum(brk) OVER (PARTITION BY user_id, ticker ORDER BY ts, guid) AS k FROM g), b AS (SELECT user_id, ticker, k, min(ts) AS s, max(ts) + INTERVAL 30 MINUTE AS e, count(*) AS n FROM h GROUP BY 1, 2, 3)
      SELECT user_id, ticker, strftime(s, '%Y-%m-%d %H:%M:%S.%f') AS start, n FROM b WHERE e <= (SELECT max(ts) FROM releases) - INTERVAL 1 HOUR""")(
    lambda t: run_parts(stream(t), "r12", rules.bursts, rules.closed_bursts).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
