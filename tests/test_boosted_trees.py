"""Walk-forward models: every row of every year that can be tested gets a prediction from each pair."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import forecasters, panel
from tapeloom.plans.panel import MODEL_JOBS


@pytest.fixture(scope="module")
def rows(spark):
    """Three years of ten tickers, with sessions without market features, still stocks and a stock whose later volatility is 0."""
    draw = random.Random(3)
    out = []
    for year in (2010, 2011, 2012):
        for k in range(60):
            for n in range(10):
                still = n == 0 and k % 2 == 0
                vol = 0.0 if still else draw.uniform(0.01, 0.05)
                market = [None] * 3 if k % 5 == 0 else [float(draw.random() < 0.5), draw.uniform(0.01, 0.02), draw.gauss(0, 0.05)]
                features = [vol if c == "vol_20" else -draw.uniform(0.01, 0.07) if c == "stop_dist_pct" else draw.gauss(0, 1) for c in panel.FEATURES]
                labels = [draw.gauss(0, 0.1), 0.0 if still else draw.uniform(0.01, 0.05), *(float(draw.random() < 0.4) for _ in panel.TARGETS)]
                out.append((f"T{n}", date(year, 1, 4) + timedelta(k), *features, *market, *labels))
    schema = "ticker string, date date, " + ", ".join(f"{c} double" for c in [*panel.FEATURES, *panel.MARKET, *panel.LABELS])
    return spark.createDataFrame(out, schema)


def test_every_row_of_a_test_year_has_a_prediction(rows):
    years = panel.tested_years(rows)
    assert years == [2011, 2012]
    got = panel.walk_forward_models(rows, years, [("y_up10", "logistic"), ("fwd_rvol", "ridge")])
    by = {tuple(r)[:2]: tuple(r)[2:] for r in got.groupBy("test_year", "target").agg(F.count("*"), F.count("p_model"), F.count_if(F.isnan("p_model"))).collect()}
    assert by == {(y, t): (600, 600, 0) for y in years for t in ("y_up10", "fwd_rvol")}


def test_trees_and_one_class(rows):
    got = panel.walk_forward_models(rows.withColumn("y_dn10", F.lit(1.0)), [2012], [("y_up10", "gbm"), ("y_dn10", "logistic")], rounds=2, least_leaf=20)
    assert got.where("target = 'y_up10' AND p_model > 0 AND p_model < 1").count() == 600
    assert got.where("target = 'y_dn10' AND p_model = 1").count() == 600


@pytest.fixture(scope="module")
def signals(spark):
    """Rows of two years with a label that follows two features by a rule, a noisy one, and a continuous one."""
    draw = np.random.default_rng(8)
    n = 4000
    a, b, c = draw.normal(size=(3, n))
    table = pd.DataFrame({
        "test_year": np.repeat([2001, 2002], n // 2), "part": np.where(np.arange(n) % 4 == 0, "test", "train"), "ticker": "T", "date": date(2001, 1, 1), "a": a, "b": b, "c": c,
        "rule": ((a > 0.3) ^ (b > 0)).astype(float), "noise": (draw.random(n) < 0.3).astype(float), "size": np.exp(0.4 * a - 0.2 * c + draw.normal(size=n) / 10)})
    return spark.createDataFrame(table), table


def fitted(signals, fits, **settings):
    columns = {t: ["a", "b", "c"] for t, _ in fits}
    return forecasters.walk_forward(signals[0], columns, [2001, 2002], fits, 1e-4, **settings).toPandas()


def test_linear_models_solve_their_equations(signals):
    """The gradient of the penalised loss is 0 at the weights that the predictions show."""
    _, t = signals
    got = fitted(signals, [("rule", "logistic"), ("size", "ridge")])
    for year in (2001, 2002):
        train, test = (t[(t.test_year == year) & (t.part == p)] for p in ("train", "test"))
        x, z = (np.c_[np.ones(len(d)), d[["a", "b", "c"]]] for d in (train, test))
        p = got[(got.test_year == year) & (got.target == "rule")].p_model.to_numpy()
        w = np.zeros(4)
        for _ in range(30):
            q = 1 / (1 + np.exp(-x @ w))
            w -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag([0, 1, 1, 1]), x.T @ (q - train.rule) + np.r_[0, w[1:]])
        assert np.allclose(np.sort(p), np.sort(1 / (1 + np.exp(-z @ w))), atol=1e-6)
        y = np.log(train["size"])
        w = np.linalg.solve(x.T @ x + np.diag([0, 1, 1, 1]), x.T @ y)
        want = np.exp(z @ w + np.var(y - x @ w) / 2)
        assert np.allclose(np.sort(got[(got.test_year == year) & (got.target == "size")].p_model), np.sort(want))


def test_trees_learn_a_rule_that_no_line_separates(signals):
    got = fitted(signals, [("rule", "gbm"), ("rule", "logistic"), ("noise", "gbm")], rounds=25, least_leaf=50)
    loss = {k: ((d.y - d.p_model) ** 2).mean() for k, d in got.groupby(["target", "model"])}
    assert loss["rule", "gbm"] < 0.11 < 0.2 < loss["rule", "logistic"]
    assert loss["noise", "gbm"] < 1.15 * 0.21


def test_margins_survive_a_refresh(signals, monkeypatch):
    once = fitted(signals, [("rule", "gbm")], rounds=5, least_leaf=50)
    monkeypatch.setattr(forecasters, "REFRESH", 2)
    again = fitted(signals, [("rule", "gbm")], rounds=5, least_leaf=50)
    assert np.allclose(np.sort(once.p_model), np.sort(again.p_model))


def test_a_leaf_holds_enough_rows():
    draw = np.random.default_rng(2)
    hist = np.abs(draw.normal(size=(3, 4, forecasters.BINS, 3))) * [1, 1, 10]
    feature, cut = forecasters.best_splits(hist, np.array([1, 2]), 60)
    for node in range(3):
        assert feature[node] in (1, 2)
        rows = hist[node, feature[node], :, 2]
        assert min(rows[: cut[node] + 1].sum(), rows[cut[node] + 1 :].sum()) >= 60
    assert (forecasters.best_splits(hist, np.array([0]), 10**6)[1] == forecasters.BINS).all()


def test_all_pairs_and_no_rows(rows):
    assert len(set(MODEL_JOBS)) == 9 and {t for t, _ in MODEL_JOBS} == {*panel.TARGETS, "fwd_rvol"}
    none = rows.limit(0)
    assert panel.tested_years(none) == [] and panel.walk_forward_models(none, [], MODEL_JOBS).count() == 0
