"""Query registry: each operator with its output contract and its SQL twin.

The output contract is written once, as ``"ticker date:d close:f n:i"``.  It
casts and rounds the Spark result and the SQL result the same way, so that the
two can be compared value by value.  Kinds: (none) string, ``i`` bigint, ``d``
date, ``b`` boolean as 0/1, ``fN`` double rounded to N places (``f`` is 6).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.plans import oracle
from tapeloom.sources.tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    out: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def fields(self) -> list[tuple[str, str]]:
        return [tuple((item + ":s").split(":")[:2]) for item in self.out.split()]

    def run(self, spark: SparkSession, directory: str) -> DataFrame:
        return self.build(Tables(spark, directory)).select(*[_spark_cast(c, k) for c, k in self.fields()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_cast(c, k) for c, k in self.fields())
        return f"SELECT {cols} FROM (\n{oracle.expand(self.sql)}\n) AS result"


def _digits(kind: str) -> int:
    return int(kind[1:] or 6)


def _rounded(c: Column, digits: int) -> Column:
    """As the SQL engine rounds: to whole units, which are then divided.  Rounding the decimal form gives the next double for some high values."""
    units = F.round(c * 10.0**digits)
    return F.when(F.abs(units) < F.lit(float("inf")), units / 10.0**digits).otherwise(c)


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind[0] == "f":
        return (_rounded(c.cast("double"), _digits(kind)) + F.lit(0.0)).alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "b":
        return c.cast("int").cast("bigint").alias(name)
    return c.cast("string").alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind[0] == "f":
        return f'round(CAST("{name}" AS DOUBLE), {_digits(kind)}) + 0.0 AS "{name}"'
    if kind == "i":
        return f'CAST("{name}" AS BIGINT) AS "{name}"'
    if kind == "b":
        return f'CAST(CAST("{name}" AS INTEGER) AS BIGINT) AS "{name}"'
    return f'CAST("{name}" AS VARCHAR) AS "{name}"'


REGISTRY: dict[str, Query] = {}


def query(name: str, out: str, sql: str | None = None):
    """Register ``build(tables) -> DataFrame`` under ``name``."""

    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} is registered twice")
        REGISTRY[name] = Query(name, out, build, sql)
        return build

    return add
