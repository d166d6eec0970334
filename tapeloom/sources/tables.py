"""Table access for one data directory.

``Tables`` exposes the stored Parquet tables and the market tables derived from
them (``bridge``).  Every attribute is a lazy DataFrame, so a query reads only
the columns it uses.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tapeloom.sources import bridge

STORED = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


class Tables:
    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.directory, f"{name}.parquet"))

    def __getattr__(self, name: str) -> DataFrame:
        if name in STORED:
            return self.read(name)
        raise AttributeError(name)

    @cached_property
    def bars(self) -> DataFrame:
        """The daily bars: one row per ticker and session, the input of nearly every study.

        They stand for a stored bar table, so they are built from the fills once per
        session and kept; the size is tickers times sessions, not fills.
        """
        return bridge.daily_bars(self.lineitem, self.part).persist()

    @cached_property
    def bench(self) -> DataFrame:
        return bridge.benchmark_bars(self.bars)

    @cached_property
    def hourly(self) -> DataFrame:
        return bridge.hourly_bars(self.events)

    @cached_property
    def day_bars(self) -> DataFrame:
        return bridge.session_bars(self.hourly)

    @cached_property
    def trades(self) -> DataFrame:
        return bridge.trades(self.orders, self.lineitem, self.part, self.bars)

    @cached_property
    def releases(self) -> DataFrame:
        return bridge.releases(self.events)

    @cached_property
    def sectors(self) -> DataFrame:
        return bridge.sectors(self.part)

    @cached_property
    def reports(self) -> DataFrame:
        return bridge.reports(self.documents)

    @cached_property
    def tags(self) -> DataFrame:
        return bridge.report_tags(self.documents, self.labels)

    @cached_property
    def positions(self) -> DataFrame:
        return bridge.positions(self.trades)

    @cached_property
    def dividends(self) -> DataFrame:
        return bridge.dividends(self.bars)

    @cached_property
    def transactions(self) -> DataFrame:
        return bridge.transactions(self.trades)

    @cached_property
    def intents(self) -> DataFrame:
        return bridge.intents(self.trades)

    @cached_property
    def earnings(self) -> DataFrame:
        return bridge.earnings(self.bars)

    @cached_property
    def subjects(self) -> DataFrame:
        return bridge.subjects(self.reports)

    @cached_property
    def symbol_map(self) -> DataFrame:
        return bridge.symbol_map(self.reports)
