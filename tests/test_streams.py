"""Streams over a table that is a folder of part files in no order, stopped and started again."""

from __future__ import annotations

import time
from datetime import datetime
from functools import partial

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.plans import catalogue, streams
from tapeloom.streaming import rules
from tapeloom.streaming.runtime import table_stream

SMALL = "/root/testdata/sf0.001"


def parts(spark, folder, which):
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    for k in which:
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return rules.release_stream(table_stream(spark, str(folder), "events", files_per_batch=1))


def test_releases_once_over_parts_and_restarts(spark, tmp_path):
    out = str(tmp_path / "out")
    assert streams.exactly_once(rules.repeated(parts(spark, tmp_path, [2, 0])), out).count() == spark.read.parquet(f"{SMALL}/events.parquet").where("event_id % 3 <> 1").count()
    again = streams.exactly_once(rules.repeated(parts(spark, tmp_path, [1, 2])), out)
    assert again.count() == again.select("guid").distinct().count() == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_pending_outcomes_come_back(spark, tmp_path):
    out = str(tmp_path / "out")
    none = spark.createDataFrame([], "guid bigint, complete boolean")
    first = parts(spark, tmp_path, [1, 0]).select("guid", "ts")
    status = {r["guid"]: r["status"] for r in streams.statuses(first, none, out, "2024-01-02").collect()}
    assert set(status.values()) == {"pending"}
    done = spark.createDataFrame([(min(status), True)], "guid bigint, complete boolean")
    second = {r["guid"]: r["status"] for r in streams.statuses(parts(spark, tmp_path, [2]).select("guid", "ts"), done, out, "2030-01-01").collect()}
    assert second[min(status)] == "complete" and len(second) == spark.read.parquet(f"{SMALL}/events.parquet").count()
    assert set(second.values()) == {"complete", "no_data"}


@pytest.mark.parametrize("name", ["r2_two_lanes", "r4_inbox_collapse", "r5_state_expiry", "r9_session_volume", "r12_release_bursts"])
def test_no_row_is_late_over_parts_in_no_order(spark, tmp_path, monkeypatch, name):
    """Three parts by time, the newest first, one a batch: the same rows as from one file."""
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("third", F.ntile(3).over(Window.orderBy("ts")))
    for third in (3, 1, 2):
        events.where(F.col("third") == third).drop("third").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
        time.sleep(1.1)  # a file stream takes the oldest file first
    run = catalogue()[name].run
    once = run(spark, SMALL).collect()
    monkeypatch.setattr(streams, "table_stream", partial(table_stream, files_per_batch=1))
    assert once and sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(map(tuple, once))


def test_bursts_meet_across_batches(spark):
    at = lambda text: datetime.fromisoformat(f"2024-01-01 {text}")
    rows = [(1, "A", at("10:00")), (1, "A", at("10:40")), (1, "A", at("10:20")), (1, "A", at("11:10")), (2, "A", at("15:00"))]
    batches = [rules.bursts(spark.createDataFrame(part, "user_id long, ticker string, ts timestamp")) for part in (rows[:2], rows[2:])]
    got = rules.closed_bursts(batches[0].unionByName(batches[1])).orderBy("start").select(F.date_format("start", "HH:mm"), "n").collect()
    assert [tuple(r) for r in got] == [("10:00", 3), ("11:10", 1)]


def test_each_release_in_one_lane_after_a_restart_and_a_retry(spark, tmp_path):
    """The tables of both lanes hold every release once, also when the last batch is run again."""
    from tapeloom.streaming.runtime import write_version

    out = str(tmp_path / "out")
    streams.routed(parts(spark, tmp_path, [1]), out)
    now, hourly = streams.routed(parts(spark, tmp_path, [0, 2]), out)
    assert now.count() > 0 < hourly.count()
    rows = {k: spark.read.parquet(f"{out}/{k}") for k in ("now", "hourly")}
    for lane, df in rows.items():
        last = df.agg(F.max("batch")).first()[0]
        again = df.where(F.col("batch") == last).drop("batch").toPandas()
        write_version(spark.createDataFrame(again, df.drop("batch").schema), last, out, lane)
    ids = [r["guid"] for k in rows for r in spark.read.parquet(f"{out}/{k}").select("guid").collect()]
    assert len(ids) == len(set(ids)) == spark.read.parquet(f"{SMALL}/events.parquet").count()


def test_inbox_items_open_collapse_and_close(spark):
    at = lambda day: datetime(2024, 1, day)
    events = [(1, "release", at(1)), (2, "release", at(2)), (1, "review", at(3)), (3, "release", at(4)), (2, "review", at(5)), (3, "review", at(6)), (4, "release", at(7))]
    rows = [(1, "A", g, f"c{g}", k, t) for g, k, t in events]
    df = spark.createDataFrame(rows[::-1] + rows[:2], "user_id long, ticker string, guid long, category string, kind string, at timestamp")
    got = sorted((r["guid"], r["collapsed"], r["status"], r["closed"]) for r in rules.inbox(df).collect())
    assert got == [(2, 2, "reviewed", at(3)), (3, 1, "reviewed", at(5)), (4, 1, "open", None)]
