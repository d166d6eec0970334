"""Recursive averages against pandas."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tapeloom.functions import recursive as rec
from tapeloom.operators import technicals
from bar_frames import bar_frame


def series_frame(spark, values):
    rows = pd.DataFrame({"ticker": "A", "date": range(len(values)), "x": values})
    return spark.createDataFrame(rows, "ticker string, date int, x double").withColumn("x", F.when(~F.isnan("x"), F.col("x")))


@pytest.mark.parametrize("span", [2, 13, 200])
def test_long_series_crosses_blocks(spark, span):
    rng = np.random.default_rng(span)
    values = rng.normal(100, 20, 3000)
    df = series_frame(spark, values)
    got = rec.averages(df, {"y": (F.col("x"), rec.span(span)), "z": (F.col("x"), rec.wilder(14))}).orderBy("date").toPandas()
    want = pd.Series(values).ewm(span=span, adjust=False).mean()
    assert np.allclose(got["y"], want, rtol=1e-11)
    assert np.allclose(got["z"], pd.Series(values).ewm(alpha=1 / 14, adjust=False).mean(), rtol=1e-11)


def test_leading_nulls_seed_later(spark):
    values = [np.nan, np.nan, 5.0, 7.0, 9.0]
    got = rec.averages(series_frame(spark, values), {"y": (F.col("x"), rec.span(3))}).orderBy("date").toPandas()["y"]
    assert np.allclose(got, pd.Series(values).ewm(span=3, adjust=False).mean(), equal_nan=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.floats(0.5, 1000)), min_size=3, max_size=60), st.integers(2, 30))
def test_gaps_decay_like_pandas(spark, values, span):
    clean = [np.nan if v is None else v for v in values]
    got = rec.averages_with_gaps(series_frame(spark, clean), {"y": (F.col("x"), rec.span(span))}).orderBy("date").toPandas()["y"]
    assert np.allclose(got.astype(float), pd.Series(clean).ewm(span=span, adjust=False).mean(), rtol=1e-9, equal_nan=True)


def test_constant_series_stays_constant(spark):
    df = series_frame(spark, [37.1] * 700)
    got = rec.averages(df, {"y": (F.col("x"), rec.span(2))}).select("y").distinct().collect()
    assert [r.y for r in got] == [37.1]


def test_rsi_limits(spark):
    up = technicals.rsi(bar_frame(spark, [10.0 + i for i in range(30)])).orderBy("date").toPandas()["rsi"]
    assert up.iloc[-1] == 100
    flat = technicals.rsi(bar_frame(spark, [10.0] * 30)).orderBy("date").toPandas()["rsi"]
    assert flat.isna().all()


def test_shared_blocks_keep_carry_exact():
    lengths = rec._block_groups([rec.span(n) for n in (2, 13, 50, 200)])
    import math
    for alpha, size in lengths.items():
        decay = -math.log1p(-alpha)
        assert size * decay >= rec.NIL_EXPONENT
        assert size * decay <= rec.MAX_EXPONENT + decay
