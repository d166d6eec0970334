"""Buy decisions at the fill price, and the bootstrap over rows."""

from __future__ import annotations

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ledger, stats

RUN = date(2024, 1, 1)


def decisions(spark, rows, gap_pct=5.0, held=()):
    """Reasons and shares by intent from ``intent, ticker, planned, stop, price`` in order of priority."""
    queue = spark.createDataFrame([(RUN, i, t, date(2024, 1, 4), p, s, k, x) for k, (i, t, p, s, x) in enumerate(rows)],
                                  "run date, intent_id long, ticker string, signal_date date, planned double, stop_price double, priority long, price double")
    owned = spark.createDataFrame([(RUN, t) for t in held], "run date, ticker string")
    sectors = spark.createDataFrame([], "ticker string, sector string")
    out = ledger.select_buys(queue, owned, sectors, F.lit(RUN), slots=8, per_sector=8, funds=10_000.0, risk_pct=1.0, gap_pct=gap_pct)
    return {r["intent_id"]: (r["reason"], r["shares"]) for r in out.collect()}


def test_fill_checks(spark):
    rows = [(1, "A", 100.0, 95.0, 100.0), (2, "B", 100.0, 95.0, None), (3, "C", 100.0, 95.0, 105.1), (4, "D", 100.0, 101.0, 102.0), (5, "E", 100.0, 95.0, 95.0),
            (6, "F", 5000.0, 4000.0, 5001.0), (7, "A", 100.0, 95.0, 100.0), (8, "G", 100.0, 95.0, 104.0)]
    got = decisions(spark, rows)
    assert got == {1: (None, 12), 2: ("no_price_data", None), 3: ("gap_up", None), 4: ("invalid_stop_data", None), 5: ("price_below_stop", None),
                   6: ("allocation_too_small", None), 7: ("duplicate_pending", None), 8: (None, 11)}
    assert decisions(spark, rows, gap_pct=None)[3] == (None, 9)  # sized on the risk of the fill, 10.1 a share
    full = [chr(ord("a") + k) for k in range(8)]
    assert set(decisions(spark, rows[:3], held=full).values()) == {("portfolio_full", None)}


def test_bootstrap_intervals(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(2.0, 3.0, 900)
    rows = spark.createDataFrame([(i, float(v), i % 3) for i, v in enumerate(x)], "id long, x double, g int").repartition(4)
    got = {r["slice"]: r for r in stats.bootstrap_slices(rows, "id", "x", F.array(F.lit("all"), F.concat(F.lit("g"), F.col("g").cast("string"))), 2000, 7).collect()}
    assert set(got) == {"all", "g0", "g1", "g2"} and got["all"]["n"] == 900
    for name, some in [("all", x), *((f"g{k}", x[k::3]) for k in range(3))]:
        r, wide = got[name], 1.96 * some.std() / np.sqrt(len(some))
        assert r["mean"] == pytest.approx(some.mean())
        assert r["low"] == pytest.approx(some.mean() - wide, abs=0.25 * wide) and r["high"] == pytest.approx(some.mean() + wide, abs=0.25 * wide)
        assert r["low_all"] < r["low"] < r["high"] < r["high_all"]


def test_weights_are_poisson_and_independent():
    w = stats.poisson_weights(np.arange(2000), 500, 3)
    assert w.mean() == pytest.approx(1, abs=0.01) and w.var() == pytest.approx(1, abs=0.03)
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01 and abs(np.corrcoef(w[:, :-1].ravel(), w[:, 1:].ravel())[0, 1]) < 0.01
