"""Positions on the tree of bar blocks against their bars, day by day."""

from __future__ import annotations

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import held, ledger

DAY = date(2020, 1, 1)


@pytest.mark.parametrize("levels", [3, 14])
def test_nodes_make_up_a_range(spark, monkeypatch, levels):
    monkeypatch.setattr(held, "LEVELS", levels)
    draw = random.Random(levels)
    ranges = [(a, a + draw.randint(-1, 90)) for a in range(60)] + [(0, 0), (5, 4), (0, 4095), (1, 4097)]
    df = spark.createDataFrame(ranges, "a long, b long").select("a", "b", held.nodes_of(F.col("a"), F.col("b")).alias("x"))
    for a, b, x in df.collect():
        covered = sorted(k for n in x for k in range(n["node"] << n["level"], (n["node"] + 1) << n["level"]))
        assert covered == list(range(a, b + 1)), (a, b)
        assert all(n["start"] == n["node"] << n["level"] for n in x)
        if levels == 14:
            assert len(x) <= 2 * max(b - a + 1, 1).bit_length()


@pytest.mark.parametrize("levels", [4, 14])
def test_state_since_entry_against_every_bar(spark, monkeypatch, levels):
    """Long holds, holds of a day, none at all, sessions without bars, and gains reached exactly."""
    monkeypatch.setattr(held, "LEVELS", levels)
    draw = random.Random(levels)
    rows = []
    for t in ("A", "B"):
        close = 100.0
        for k in range(400):
            if draw.random() < 0.1:
                continue
            close = round(max(5.0, close * (1 + draw.gauss(0, 0.03))), 2)
            rows.append((t, DAY + timedelta(k), close, close + draw.random(), close - draw.random(), close, 1000.0))
    bars = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    held_rows = []
    for i in range(120):
        a = draw.randint(-20, 390)
        b = draw.choice((a, a + draw.randint(0, 10), 420))
        entry = draw.choice([r[5] for r in rows]) / draw.choice((1.0, 1.08))
        held_rows.append((i, draw.choice("AB"), DAY + timedelta(a), DAY + timedelta(b), entry))
    positions = spark.createDataFrame(held_rows, "position_id long, ticker string, entry_date date, as_of date, entry_price double")
    atr = {}
    for t in ("A", "B"):
        last = before = None
        for r in (r for r in rows if r[0] == t):
            tr = max(r[3] - r[4], *(abs(x - before) for x in r[3:5] if before is not None), 0) if before is not None else r[3] - r[4]
            last = tr if last is None else last + (tr - last) / 14
            atr[r[0], r[1]], before = last, r[5]
    want = []
    for i, t, a, b, entry in held_rows:
        mine = [r for r in rows if r[0] == t and a <= r[1] <= b]
        if not mine:
            continue
        hh = peak = armed = None
        for r in mine:
            hh, peak = max(hh or r[3], r[3]), max(peak or r[5], r[5])
            if (peak / entry - 1) * 100 >= 8:
                level = hh - 2.5 * atr[t, r[1]]
                armed = level if armed is None else max(armed, level)
        want.append((i, len(mine), hh, peak, mine[-1][5], None if armed is None else round(armed, 9)))
    got = ledger.since_entry(positions, bars).select("position_id", "tdays", "hh", "peak", "z.close", F.round("armed", 9)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(w[5] is None for w in want) and sum(w[5] is not None for w in want) > 20
