"""Hand-traced and brute-force checks of single operators."""

import datetime as dt
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.functions import text
from tapeloom.functions.protocol import run_screens
from tapeloom.operators import documents, notes, panel, patterns, ranks, runs, scans, shaping, stats, studies
from tapeloom.operators.asof import asof_join
from tapeloom.sources import bridge, loading
from bar_frames import bar_frame


def test_pivots_hand_traced(spark):
    df = bar_frame(spark, [5.0, 3, 5, 2, 5, 4, 5, 1, 5])
    got = runs.with_pivots(df, "close", 1).orderBy("date").toPandas()
    assert list(np.flatnonzero(got["pivot_low"])) == [1, 3, 5, 7]
    assert list(np.flatnonzero(got["pivot_high"])) == [2, 4, 6]
    flat = runs.with_pivots(bar_frame(spark, [5.0] * 9), "close", 1).where("pivot_low or pivot_high")
    assert flat.count() == 0


def test_volume_spike_of_150_percent(spark):
    df = bar_frame(spark, [10.0] * 20 + [10.1], volumes=[100000.0] * 20 + [250000.0])
    rows = scans.volume_spikes(df).collect()
    assert len(rows) == 1 and abs(rows[0].spike_pct - 150) < 1e-9


def test_asof_directions(spark):
    left = spark.createDataFrame([("A", dt.date(2020, 1, d)) for d in (1, 3, 5, 9)], "k string, d date")
    right = spark.createDataFrame([("A", dt.date(2020, 1, 3), 3), ("A", dt.date(2020, 1, 6), 6)], "k string, t date, v int")
    look = lambda **kw: [r.v for r in asof_join(left, right, "k", "d", "t", {"v": "v"}, **kw).orderBy("d").collect()]
    assert look() == [None, 3, 3, 6]
    assert look(strict=True) == [None, None, 3, 6]
    assert look(direction="forward") == [3, 3, 6, None]
    assert look(direction="forward", strict=True) == [3, 6, 6, None]


def test_hot_ticker_bars_do_not_depend_on_blocks(spark, tables, monkeypatch):
    want = bridge.daily_bars(tables.lineitem, tables.part)
    monkeypatch.setattr(bridge, "BLOCK_ORDERS", 7)
    one = tables.part.withColumn("p_brand", F.lit("HOT"))
    small = bridge.daily_bars(tables.lineitem, one)
    monkeypatch.setattr(bridge, "BLOCK_ORDERS", 1 << 40)
    whole = bridge.daily_bars(tables.lineitem, one)
    assert small.exceptAll(whole).count() == 0 and whole.count() == small.count() < want.count()


def test_ranks_of_a_group_with_one_hot_value(spark):
    rng = np.random.default_rng(1)
    values = np.r_[np.full(500, 0.25), rng.normal(size=1500)]
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "x": values}))
    q = ranks.quantiles(df, ["g"], "x", {"q05": 0.05, "q50": 0.5, "q99": 0.99}).collect()[0]
    assert np.allclose([q.q05, q.q50, q.q99], np.quantile(values, [0.05, 0.5, 0.99]))
    ordered = np.sort(values)
    assert abs(ranks.trimmed_mean(df, ["g"], "x").collect()[0].trimmed - ordered[20:-20].mean()) < 1e-12
    assert abs(ranks.mean_without_top(df, ["g"], "x").collect()[0].mean_rest - ordered[:-5].mean()) < 1e-12


def test_auc_and_calibration_against_brute_force(spark):
    rng = np.random.default_rng(2)
    p = rng.integers(0, 20, 300) / 20
    y = (rng.random(300) < p).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "y": y, "p": p}))
    pairs = [(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]]
    assert abs(stats.auc(df, ["g"], "y", "p").collect()[0].auc - statistics.fmean(pairs)) < 1e-12
    got = stats.calibration(df, ["g"], "y", "p").orderBy("bin").toPandas()
    bins = pd.qcut(p, 10, labels=False, duplicates="drop")
    want = pd.DataFrame({"b": bins, "p": p, "y": y}).groupby("b").agg(n=("y", "size"), mp=("p", "mean"), my=("y", "mean"))
    assert list(got["n"]) == list(want["n"]) and np.allclose(got["mean_y"], want["my"])


def test_t_distribution_known_values():
    for t, df, p in ((2.228139, 10, 0.05), (12.706205, 1, 0.05), (1.959964, 1e7, 0.05), (0.0, 5, 1.0)):
        assert abs(stats.two_sided_p(t, df) - p) < 1e-6


def test_normal_cdf_close_to_exact(spark):
    import math
    xs = [-4.0, -1.5, -0.1, 0.0, 0.7, 2.5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r.p for r in df.select(stats.normal_cdf(F.col("x")).alias("p")).collect()]
    assert np.allclose(got, [0.5 * (1 + math.erf(x / math.sqrt(2))) for x in xs], atol=2e-7)


def test_cool_down_counts_from_the_last_kept(spark):
    ev = spark.createDataFrame([("A", b) for b in (1, 50, 61, 100, 121, 122)], "ticker string, bar int")
    assert sorted(r.bar for r in studies.cool_down(ev, 60, ["ticker"]).collect()) == [1, 61, 121]


def brute_trail(o, h, l, c, i, trail, n, cost):
    if i + 1 >= len(c):
        return None
    entry, peak = o[i + 1], c[i + 1]
    for j in range(i + 1, min(len(c), i + 1 + n)):
        peak = max(peak, c[j])
        if c[j] <= peak * (1 - trail) or c[j] < l[i]:
            return c[j] / entry - 1 - cost
    return c[i + n] / entry - 1 - cost if i + n < len(c) else None


def test_trailing_exit_against_brute_force(spark):
    rng = np.random.default_rng(3)
    closes = list(np.round(50 * np.exp(np.cumsum(rng.normal(0, 0.05, 120))), 2))
    df = bar_frame(spark, closes)
    pdf = df.toPandas()
    points = df.withColumn("bar", F.row_number().over(shaping.Window.partitionBy("ticker").orderBy("date"))).select("ticker", "bar", F.col("low").alias("stop0"))
    got = {r.bar: r.trail for r in studies.trail_returns(points, df, 0.2, 30, 0.01).collect()}
    for i in range(len(closes) - 1):
        want = brute_trail(*(pdf[k].tolist() for k in ("open", "high", "low", "close")), i, 0.2, 30, 0.01)
        assert (got.get(i + 1) is None) == (want is None)
        if want is not None:
            assert abs(got[i + 1] - want) < 1e-12


def brute_vcp(pdf, t, window, shrink):
    h, l = pdf["high"].tolist()[t - window + 1:t + 1], pdf["low"].tolist()[t - window + 1:t + 1]
    peaks = [i for i in range(2, len(h) - 2) if h[i] >= max(h[i - 2:i + 3])]
    troughs = [i for i in range(2, len(l) - 2) if l[i] <= min(l[i - 2:i + 3])]
    drops = []
    for p in peaks:
        after = [x for x in troughs if x > p]
        if after:
            drops.append((h[p] - l[after[0]]) / h[p] * 100)
    return len(drops) >= 2 and all(b < a * shrink for a, b in zip(drops, drops[1:]))


def test_contractions_against_brute_force(spark):
    rng = np.random.default_rng(5)
    closes = list(np.round(60 + np.cumsum(rng.normal(0.05, 0.4, 260)), 2))
    df = bar_frame(spark, closes, spread=0.2)
    pdf = df.toPandas()
    got = {r.date for r in patterns.vcp(df, shrink=1.6, max_vol=100.0).collect()}
    ma = pdf["close"].rolling(150).mean()
    want = {pdf["date"][t] for t in range(149, 260) if pdf["close"][t] >= ma[t] and brute_vcp(pdf, t, 60, 1.6)}
    assert got == want and want


def test_features_do_not_look_ahead(tables):
    changed = panel.lookahead_check(tables.bars, bridge.benchmark_bars, "1999-12-31")
    assert changed.count() == 0


def test_page_text_rules():
    html = "<html><script>x</script><article><p>One &amp; two<p>three<table><tr><td>a</td><td> b </td></tr></table><style>s</style></article><p>out"
    assert documents.page_text(html) == "One & two\nthree\na | b"
    assert documents.page_text("<p>no article</p>") is None
    marked = "<article><p>teaser</article><div itemprop='articleBody'><div>One</div><p>two<table><tr><th>x<p>y<td></td><td>z</tr></table></div><p>after"
    assert documents.page_text(marked) == "One\ntwo\nx y | z"
    assert documents.page_text('<article>a<article id="release">b<br/>c</article>d</article>') == "b\nc"
    assert documents.page_text("<article>1 < 2 &lt; 3<!-- <p>no --><script>if (a<b) {}</script></article>") == "1 < 2 < 3"


def test_whole_page_text_is_kept(spark, tables):
    got = documents.article_text(tables.pages).join(tables.pages, "page_id").limit(40).toPandas()
    for _, r in got.iterrows():
        assert r["body"] == documents.page_text(r["html"])


def test_listed_pairs_and_titles(spark):
    df = spark.createDataFrame([("LTH AW CN BROS US CAVA US ...", "Company - Head - line")], "a string, b string")
    c, h = text.split_title(F.col("b"))
    r = df.select(text.listed_pairs(F.col("a")).alias("p"), c.alias("c"), h.alias("h")).collect()[0]
    assert [(x.symbol, x.exchange) for x in r.p] == [("LTH", ""), ("AW", "CN"), ("BROS", "US"), ("CAVA", "US")]
    assert (r.c, r.h) == ("Company", "Head - line")


def test_company_names(spark):
    rows = [("Royal Gold Inc", "Royal Gold Corporation", True), ("Royal Gold Inc", "Royal Bank", False), ("Apex Mining Canada", "Apex Mining", False),
            ("Apex", "Apex Resources Group", True)]
    df = spark.createDataFrame(rows, "name_a string, name_b string, want boolean")
    direct = df.select(text.names_match(text.name_tokens(F.col("name_a")), text.name_tokens(F.col("name_b"))).alias("m"), "want").collect()
    assert all(r.m == r.want for r in direct)
    joined = {(r.name_a, r.name_b) for r in notes.company_matches(df, df).collect()}
    assert {(a, b) for a, b, w in rows if w} <= joined and not joined & {(a, b) for a, b, w in rows if not w}


def test_entry_rules(spark):
    rows = [("2024-01-05 09:29:00", "2024-01-05"), ("2024-01-05 09:30:00", "2024-01-06"), ("2024-01-05 16:00:00", "2024-01-06")]
    df = spark.createDataFrame(rows, "t string, want string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    assert all(str(r.d) == r.want for r in df.withColumn("d", studies.entry_day("ts")).collect())


def test_upserts(spark):
    old = spark.createDataFrame([("A", dt.date(2020, 1, d), 1.0) for d in (1, 2, 3)] + [("B", dt.date(2020, 1, 2), 1.0)], "ticker string, date date, close double")
    new = spark.createDataFrame([("A", dt.date(2020, 1, 2), 9.0)], "ticker string, date date, close double")
    got = {(r.ticker, r.date.day): r.close for r in loading.upsert_ranges(old, new).collect()}
    assert got == {("A", 1): 1.0, ("A", 2): 9.0, ("A", 3): 1.0, ("B", 2): 1.0}
    again = loading.upsert_ranges(loading.upsert_ranges(old, new), new)
    assert again.count() == 4


def test_screens_must_return_labels(spark):
    bars = bar_frame(spark, [1.0, 2.0])
    try:
        run_screens(bars, {"bad": lambda b: b.select("ticker")})
    except ValueError as e:
        assert "bad" in str(e)
    else:
        raise AssertionError("a screen without labels was accepted")


def test_dated_screener_files(spark, tmp_path):
    (tmp_path / "run_2024-01-05.csv").write_text("Ticker,score\n aa ,1\nbb,2\n")
    (tmp_path / "run_20240105_b.csv").write_text("Ticker,score\nAA,3\n,4\n")
    rows = loading.screener_rows(loading.read_screener_dir(spark, str(tmp_path)))
    assert sorted((str(r.date), r.ticker) for r in rows.collect()) == [("2024-01-05", "AA"), ("2024-01-05", "BB")]


def test_screener_files_with_their_own_headers(spark, tmp_path):
    (tmp_path / "screen_2024-01-02.csv").write_text("Ticker,score\naa,1\n\"bb\",2\n")
    (tmp_path / "screen_2024-01-03.csv").write_text("score,name,symbol\n5,\"Co, Inc\",cc\n6,x,\n")
    (tmp_path / "screen_20240104.json").write_text('[{"TICKER": "dd", "score": 1}, {"ticker": "ee"}, {"score": 2}]')
    rows = loading.screener_rows(loading.read_screener_dir(spark, str(tmp_path)))
    assert sorted((str(r["date"]), r["ticker"]) for r in rows.collect()) == [
        ("2024-01-02", "AA"), ("2024-01-02", "BB"), ("2024-01-03", "CC"), ("2024-01-04", "DD"), ("2024-01-04", "EE")]


def test_nested_option_snapshots(spark):
    from tapeloom.operators import demand

    nested = spark.sql("SELECT 'A' AS ticker, DATE '2024-01-02' AS date, 1L AS snapshot, array(named_struct('type', 'call', 'volume', 3.0D, 'open_interest', 2.0D), named_struct('type', 'put', 'volume', 1.0D, 'open_interest', 4.0D)) AS legs")
    legs = demand.unnested(nested)
    assert demand.nested_snapshots(legs.withColumn("snapshot", F.lit(1))).first()["legs"] == nested.first()["legs"]
    assert tuple(demand.option_totals(legs).first())[2:] == (3.0, 2.0, 1.0, 4.0)


def test_elder_grid_has_all_span_pairs(tables):
    from tapeloom.plans import catalogue

    rows = catalogue()["p58_elder_ray_grid"].run(tables.spark, tables.directory).collect()
    bars = {}
    for r in rows:
        bars[r["daily_span"], r["weekly_span"]] = bars.get((r["daily_span"], r["weekly_span"]), 0) + r["n"]
    assert set(bars) >= {(d, w) for d in (8, 13, 21) for w in (8, 13, 21)}
    assert set(bars.values()) == {tables.bars.count()}
