"""Event studies: events, exits, baselines and fold tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import patterns, ranks, shaping
from tapeloom.operators.asof import asof_join


def close_returns(bars: DataFrame, holds: list[int], cost: float) -> DataFrame:
    """Close to k-th later close, net of a round-trip cost."""
    return bars.select("*", *[(ind.ratio(ind.lead("close", k), "close") - 1 - cost).alias(f"fwd_{k}") for k in holds])


def open_returns(bars: DataFrame, holds: list[int], cost: float) -> DataFrame:
    """Next open to k-th later close, net of a round-trip cost."""
    return bars.select("*", *[(ind.ratio(ind.lead("close", k), ind.lead("open", 1)) - 1 - cost).alias(f"hold_{k}") for k in holds])


def cool_down(events: DataFrame, days: int, keys: list[str]) -> DataFrame:
    """Keep an event only when it is at least ``days`` bars after the last kept one of its key.

    The rule is sequential, so it is a fold over the sorted bar numbers of one key;
    a key has at most one event per session and keeps at most one per ``days`` bars.
    """
    start = F.struct(F.lit(-(10**9)).cast("int").alias("last"), F.array().cast("array<int>").alias("kept"))
    step = lambda acc, x: F.when(x - acc["last"] >= days, F.struct(x.alias("last"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    kept = events.groupBy(*keys).agg(F.array_sort(F.collect_set(F.col("bar").cast("int"))).alias("b")).select(
        *keys, F.explode(F.aggregate("b", start, step)["kept"]).alias("bar"))
    return events.join(kept, [*keys, "bar"], "left_semi")


def ahead(points: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    """Every bar 1..n after each point (ticker, bar): an equi-join on (ticker, bar)."""
    numbered = bars.select("ticker", ind.bar_number().alias("b"), "open", "high", "low", "close")
    steps = points.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("b", F.col("bar") + F.col("j"))
    return steps.join(numbered, ["ticker", "b"])


def trail_returns(points: DataFrame, bars: DataFrame, trail: float = 0.20, n: int = 120, cost: float = 0.01) -> DataFrame:
    """Exit of each point by a trailing stop or a close under its signal low; NULL while still open.

    ``points`` carry (ticker, bar, stop0); entry is the next open.
    """
    keys = ["ticker", "bar", "stop0"]
    w = Window.partitionBy(*keys).orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    j = ahead(points.select(*keys).distinct(), bars, n).withColumn("peak", F.max("close").over(w))
    out = (F.col("close") <= F.col("peak") * (1 - trail)) | (F.col("close") < F.col("stop0"))
    g = j.groupBy(*keys).agg(F.min(F.when(out, F.struct("j", "close"))).alias("x"), F.max(F.when(F.col("j") == n, F.col("close"))).alias("end"),
                             F.max(F.when(F.col("j") == 1, F.col("open"))).alias("entry"))
    return g.select("ticker", "bar", (ind.ratio(F.coalesce("x.close", "end"), "entry") - 1 - cost).alias("trail"))


def target_grid(points: DataFrame, bars: DataFrame, targets: list[int], holds: list[int], cost: float = 0.01) -> DataFrame:
    """Return of each point for every (target, stop mode, holding time); the stop wins ties, gaps fill at the open.

    First touches are aggregated once per point; the grid is applied to that one row.
    """
    keys = ["ticker", "bar", "stop0"]
    j = ahead(points.select(*keys).distinct(), bars, max(holds))
    entry = F.first(F.when(F.col("j") == 1, F.col("open")), True).over(Window.partitionBy(*keys).orderBy("j").rowsBetween(
        Window.unboundedPreceding, 0))
    j = j.withColumn("entry", entry)
    first = lambda test: F.min(F.when(test, F.struct("j", "open")))
    g = j.groupBy(*keys, "entry").agg(
        first(F.col("low") < F.col("stop0")).alias("s"), *[first(F.col("high") >= F.col("entry") * (1 + p / 100)).alias(f"t{p}") for p in targets],
        *[F.max(F.when(F.col("j") == h, F.col("close"))).alias(f"c{h}") for h in holds])

    def cell(p: int, stop: bool, h: int) -> Column:
        jt = F.when(F.col(f"t{p}.j") <= h, F.col(f"t{p}.j"))
        js = F.when(F.col("s.j") <= h, F.col("s.j")) if stop else F.lit(None).cast("int")
        px = (F.when(js.isNotNull() & (jt.isNull() | (js <= jt)), F.least(F.col("s.open"), F.col("stop0")))
              .when(jt.isNotNull(), F.greatest(F.col(f"t{p}.open"), F.col("entry") * (1 + p / 100))).otherwise(F.col(f"c{h}")))
        ret = F.when(F.col(f"c{h}").isNotNull(), ind.ratio(px, "entry") - 1 - cost)
        return F.struct(F.lit(p).alias("target"), F.lit("signal_low" if stop else "none").alias("stop_mode"), F.lit(h).alias("hold"), ret.alias("ret"))

    cells = F.array(*[cell(p, s, h) for p in targets for s in (False, True) for h in holds])
    return g.select("ticker", "bar", F.explode(cells).alias("c")).select("ticker", "bar", "c.*").where("ret is not null")


def persistence_tags(bars: DataFrame, min_dollar: float = 1000.0, day0: float = 3.0, hot: float = 2.0, days: list[int] = [1, 2, 4]) -> DataFrame:
    """Breakout days with heavy volume, tagged by whether volume and price held up over the next days."""
    m = patterns.breakout_masks(bars, min_dollar=min_dollar)
    cols = []
    for d in days:
        is_hot = F.min("volume").over(ind.rows(1, d)) >= hot * F.col("base_vol")
        held = ind.lead("close", d) >= F.col("close")
        tag = (F.when(is_hot & held, "confirmed").when(is_hot, "hot_not_held").when(held, "held_not_hot").otherwise("faded"))
        cols.append(F.when(ind.lead("close", d).isNotNull(), F.concat(F.lit(f"D{d}_"), tag)).alias(f"tag_{d}"))
    return m.select("*", *cols).where(F.col("breakout_only") & (F.col("volx") >= day0))


def earnings_events(bars: DataFrame, earnings: DataFrame, react: float = 5.0, volx_min: float = 2.0) -> DataFrame:
    """Reaction to each report: two-session move, volume multiple and overlapping tags."""
    b = bars.select("ticker", "date", "close", "volume", ind.bar_number().alias("bar"), ind.prior_mean("volume", 100, 80).alias("base"),
                    ind.lag("close").alias("c_1"), ind.lead("close").alias("c1"), ind.lead("volume").alias("v1"), ind.lead("date").alias("next_date"))
    right = b.withColumnRenamed("date", "d")
    cols = {c: c for c in ("d", "bar", "base", "c_1", "c1", "volume", "v1", "next_date")}
    e = asof_join(earnings, right.select("ticker", F.col("d").alias("at"), *cols), "ticker", "report_date", "at", cols, direction="forward")
    e = e.where("c_1 is not null and c1 is not null and base > 0").select(
        "ticker", "report_date", F.col("next_date").alias("date"), ((ind.ratio("c1", "c_1") - 1) * 100).alias("reaction"),
        (F.greatest("volume", "v1") / F.col("base")).alias("volx"))
    r = F.col("reaction")
    tags = F.filter(F.array(F.lit("earn_all"), F.when(r >= react, F.lit("react_up")), F.when(r <= -react, F.lit("react_down")),
                            F.when((r >= react) & (F.col("volx") >= volx_min), F.lit("up_vol"))), lambda x: x.isNotNull())
    return e.withColumn("tag", F.explode(tags))


def with_folds(rows: DataFrame, bars: DataFrame, n: int) -> DataFrame:
    return shaping.equal_folds(rows, n, bounds=bars)


def unpivot_returns(df: DataFrame, keys: list[str], exits: list[str]) -> DataFrame:
    legs = F.array(*[F.struct(F.lit(e).alias("exit"), F.col(e).alias("ret")) for e in exits])
    return df.select(*keys, F.explode(legs).alias("x")).select(*keys, "x.*").where("ret is not null")


def fold_table(events: DataFrame, baseline: DataFrame, keys: list[str], min_n: int = 1) -> DataFrame:
    """Candidate mean minus baseline mean per fold.  Both sides are (fold, exit, ret); events add ``keys``."""
    e = events.groupBy(*keys, "exit", "fold").agg(F.count("*").alias("n"), F.avg("ret").alias("candidate"))
    b = baseline.groupBy("exit", "fold").agg(F.avg("ret").alias("baseline"))
    return e.where(F.col("n") >= min_n).join(b, ["exit", "fold"]).withColumn("diff", F.col("candidate") - F.col("baseline"))


def t_statistic(c: str) -> Column:
    """One-sample t of the mean of a column against zero."""
    return F.avg(c) / (F.nullif(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count(c)))


def fold_summary(folds: DataFrame, keys: list[str]) -> DataFrame:
    return folds.groupBy(*keys, "exit").agg(
        F.sum("n").alias("events"), F.count("*").alias("folds"), F.sum((F.col("diff") > 0).cast("int")).alias("wins"),
        F.avg("diff").alias("mean_diff"), t_statistic("diff").alias("t"))


def breakout_study(bars: DataFrame, holds: list[int] = [5, 20, 60], n_folds: int = 16) -> tuple[DataFrame, DataFrame]:
    """Breakout variants after cool-down against all eligible days: (events, baseline) with folds."""
    m = open_returns(patterns.breakout_masks(bars), holds, 0.01)
    v = patterns.variant_rows(m)
    kept = v.where("variant = 'current_rule'").unionByName(cool_down(v.where("variant <> 'current_rule'"), 60, ["ticker", "variant"]))
    exits = [f"hold_{k}" for k in holds]
    events = with_folds(unpivot_returns(kept, ["ticker", "date", "variant"], exits), bars, n_folds)
    base = with_folds(unpivot_returns(m.where("eligible"), ["ticker", "date"], exits), bars, n_folds)
    return events, base


def baseline_sample(bars: DataFrame, step: int = 1) -> DataFrame:
    """Every ``step``-th eligible day of a ticker, with its trailing-stop return."""
    m = patterns.breakout_masks(bars).where("eligible")
    w = Window.partitionBy("ticker").orderBy("date")
    pick = m.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") % step == 0)
    points = pick.select("ticker", "date", "bar", F.col("low").alias("stop0"))
    return points.join(trail_returns(points, bars), ["ticker", "bar"])


def entry_timings(bars: DataFrame, configs: DataFrame, holds: list[int]) -> DataFrame:
    """Tail events for every setting and entry timing, with forward returns.

    Settings are rows of a small table, so the bars are scanned once for all of them.
    """
    c = patterns.tail_candidates(bars, 10, 20).where("bar >= 21")
    fwd = bars.select("ticker", "date", *[ind.lead("close", k).alias(f"c{k}") for k in holds])
    hits = c.join(F.broadcast(configs), patterns.tail_rule(*[F.col(x) for x in ("break_atr", "close_back", "wick_share", "wick_atr", "max_body", "volume_mult")]))
    mid = (F.col("high") + F.col("low")) / 2
    entry = lambda name, test, d, p: F.when(test, F.struct(F.lit(name).alias("timing"), F.col(d).alias("date"), F.col(p).alias("price")))
    legs = F.filter(F.array(
        entry("same_day", F.lit(True), "date", "close"), entry("confirmed_high", F.col("next_close") > F.col("high"), "next_date", "next_close"),
        entry("confirmed_mid", F.col("next_close") > mid, "next_date", "next_close")), lambda x: x.isNotNull())
    e = hits.select("config", "ticker", F.explode(legs).alias("e")).select("config", "ticker", "e.*").join(fwd, ["ticker", "date"])
    return unpivot_returns(e.select("*", *[(ind.ratio(f"c{k}", "price") - 1).alias(f"fwd_{k}") for k in holds]),
                           ["config", "timing", "ticker", "date"], [f"fwd_{k}" for k in holds])


# --- intraday ---------------------------------------------------------------------------------------------------

def checkpoint_returns(reads: DataFrame, daily: DataFrame, n: int = 20, cost: float = 0.0005) -> DataFrame:
    """Checkpoint reads against the day's own volume baseline, with exits the same day and one or two days later."""
    d = daily.select("ticker", F.col("date").alias("day"), ind.prior_mean("volume", n).alias("avg_volume"), ind.lag("close").alias("prior_close"),
                     F.col("close").alias("x0"), ind.lead("close", 1).alias("x1"), ind.lead("close", 2).alias("x2"))
    j = reads.drop("close").join(d, ["ticker", "day"]).where("avg_volume > 0 and prior_close is not null")
    j = j.withColumn("is_event", (F.col("cum_volume") > F.col("avg_volume")) & (F.col("price") > F.col("prior_close")))
    j = j.withColumn("spike_pct", (F.col("cum_volume") / F.col("avg_volume") - 1) * 100)
    ret = lambda x: ind.ratio(x, "price") - 1 - cost
    names = {"same_session_close": "x0", "next_day_close": "x1", "2day_close": "x2"}
    legs = F.array(*[F.struct(F.lit(n_).alias("exit"), ret(x).alias("ret")) for n_, x in names.items()])
    keys = ["ticker", "day", "checkpoint", "spike_pct", "is_event"]
    out = j.select(*keys, F.explode(legs).alias("l")).select(*keys, "l.*").where("ret is not null")
    return out.where(~((F.col("checkpoint") == CLOSE) & (F.col("exit") == "same_session_close")))


# Checkpoint hours; the last one is the close.
CHECKPOINTS = [9, 10, 12, 14, 23]
CLOSE = 23


def spike_events(bars: DataFrame, earnings: DataFrame, react: float = 5.0, volx: float = 3.0, cool: int = 20) -> DataFrame:
    """Heavy up-days after a cool-down, split by whether they fall on a report's reaction days."""
    b = bars.select("ticker", "date", ind.bar_number().alias("bar"), (F.col("volume") / ind.prior_mean("volume", 100, 80)).alias("volx"),
                    ind.change_pct().alias("r"), ind.lead("date").alias("next_date"))
    kept = cool_down(b.where((F.col("r") >= react / 100) & (F.col("volx") >= volx)), cool, ["ticker"])
    days = asof_join(earnings, b.select("ticker", F.col("date").alias("at"), F.col("date").alias("d0"), F.col("next_date").alias("d1")),
                     "ticker", "report_date", "at", {"d0": "d0", "d1": "d1"}, direction="forward")
    days = days.select("ticker", F.explode(F.array("d0", "d1")).alias("date")).where("date is not null").distinct().withColumn("_on", F.lit(1))
    return kept.join(days, ["ticker", "date"], "left").withColumn(
        "tag", F.when(F.col("_on").isNotNull(), "spike_on_earnings").otherwise("spike_no_earnings")).drop("_on")


def magnitude_bucket(c: str = "spike_pct") -> Column:
    x = F.col(c)
    return (F.when((x >= 0) & (x < 50), "0-50%").when((x >= 50) & (x < 100), "50-100%").when((x >= 100) & (x < 200), "100-200%").when(x >= 200, ">200%"))


def welch_t(df: DataFrame, keys: list[str], test: Column, value: str) -> DataFrame:
    """Welch's t of the rows that meet ``test`` against the rest, from counts, means and variances."""
    a, b = F.when(test, F.col(value)), F.when(~test, F.col(value))
    g = df.groupBy(*keys).agg(F.count(a).alias("n_a"), F.count(b).alias("n_b"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"),
                              F.var_samp(a).alias("va"), F.var_samp(b).alias("vb"))
    se = F.sqrt(F.col("va") / F.col("n_a") + F.col("vb") / F.col("n_b"))
    return g.withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.nullif(se, F.lit(0.0))).drop("va", "vb")


# --- momentum rotation ------------------------------------------------------------------------------------------

def rotation_picks(bars: DataFrame, bench: DataFrame, cells: list[tuple[int, int, int, bool]], min_price: float, min_dollar: float) -> DataFrame:
    """Top-N tickers by momentum per month and cell, with their ``place`` and the number ``i`` of the month among the cell's months with picks."""
    return _ranked(*_universe(bars, bench, cells, min_price, min_dollar), cells)


def _universe(bars: DataFrame, bench: DataFrame, cells: list[tuple[int, int, int, bool]], min_price: float, min_dollar: float) -> tuple[DataFrame, DataFrame]:
    """The stocks that can be bought each month, with what they then earn, and all prices by session.

    Signal on the last session of a month, bought on the next session and sold on the session after the next month's last one.  Months
    start once every look-back is inside the calendar, so all cells see the same months.
    """
    cal = bench.select("date", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("date")).alias("s"))
    w = Window.partitionBy(F.lit(0)).orderBy("a")
    ends = cal.groupBy(F.trunc("date", "MM").alias("month")).agg(F.max("s").alias("a"))
    legs = ends.select("month", "a", (F.col("a") + 1).alias("buy"), (F.lead("a").over(w) + 1).alias("sell")).where(
        F.col("sell").isNotNull() & (F.col("a") > max(lb for lb, *_ in cells) + 1))
    px = bars.join(cal, "date").withColumn("_dv", F.col("close") * F.col("volume")).select(
        "ticker", "s", "close", F.avg("_dv").over(ind.rows(-99, 0)).alias("dv"), F.count("*").over(ind.rows(-99, 0)).alias("n_dv"),
        F.when(F.count("*").over(ind.rows(-199, 0)) >= 180, F.avg("close").over(ind.rows(-199, 0))).alias("ma200"))
    at = lambda s, name: px.select("ticker", F.col("s").alias(s), F.col("close").alias(name))
    base = px.withColumnRenamed("s", "a").join(F.broadcast(legs), "a").where((F.col("n_dv") >= 80) & (F.col("dv") >= min_dollar) & (F.col("close") >= min_price))
    base = base.join(at("buy", "p0"), ["ticker", "buy"]).join(at("sell", "p1"), ["ticker", "sell"])
    return base.withColumn("fwd", F.least(ind.ratio("p1", "p0") - 1, F.lit(5.0))), px.select("ticker", "s", "close")


def _ranked(base: DataFrame, px: DataFrame, cells: list[tuple[int, int, int, bool]]) -> DataFrame:
    """All look-backs of a row come from one join; cells (look-back, skip, N, trend filter) are read off that row."""
    looks = sorted({k for lb, sk, *_ in cells for k in (lb, sk)} - {0})
    asked = base.select("ticker", "a", F.explode(F.array(*map(F.lit, looks))).alias("k")).withColumn("s", F.col("a") - F.col("k"))
    past = asked.join(px.withColumnRenamed("close", "then"), ["ticker", "s"]).groupBy("ticker", "a").agg(
        *[F.max(F.when(F.col("k") == k, F.col("then"))).alias(f"c_{k}") for k in looks])
    close = lambda k: F.col("close") if k == 0 else F.col(f"c_{k}")
    legs = F.array(*[F.struct(F.lit(i).alias("cell"), F.lit(n).alias("top_n"), F.when(
        F.lit(not trend) | (F.col("close") > F.col("ma200")), ind.ratio(close(sk), close(lb)) - 1).alias("mom")) for i, (lb, sk, n, trend) in enumerate(cells)])
    scored = base.join(past, ["ticker", "a"], "left").select("month", "a", "ticker", "fwd", F.explode(legs).alias("x")).select("month", "a", "ticker", "fwd", "x.*").where("mom is not null")
    top = Window.partitionBy("month", "cell").orderBy(F.col("mom").desc(), "ticker")
    picks = scored.withColumn("place", F.row_number().over(top)).where(F.col("place") <= F.col("top_n"))
    return picks.withColumn("i", F.dense_rank().over(Window.partitionBy("cell").orderBy("a")))


def rotation_changes(picks: DataFrame) -> DataFrame:
    """How many picks of each cell and month were held before, are new, and were given up since the cell's last month with picks."""
    now = picks.groupBy("month", "cell", "i").agg(F.collect_set("ticker").alias("now"))
    was = now.select("cell", (F.col("i") + 1).alias("i"), F.col("now").alias("was"))
    kept = F.size(F.array_intersect("now", F.coalesce("was", F.array().cast("array<string>"))))
    return now.join(was, ["cell", "i"], "left").select("month", "cell", kept.alias("kept"), (F.size("now") - kept).alias("bought"), (F.coalesce(F.size("was"), F.lit(0)) - kept).alias("sold"))


def rotation(bars: DataFrame, bench: DataFrame, cells: list[tuple[int, int, int, bool]], min_price: float, min_dollar: float,
             cost: float = 0.01) -> DataFrame:
    """Monthly return of each cell net of turnover, with equal-weight and universe size; a month without a pick earns and costs nothing."""
    base, px = _universe(bars, bench, cells, min_price, min_dollar)
    picks = _ranked(base, px, cells)
    held = picks.select("cell", "ticker", (F.col("i") + 1).alias("i"), F.lit(1).alias("kept"))
    g = picks.join(held, ["cell", "ticker", "i"], "left").groupBy("month", "cell", "top_n").agg(
        F.avg("fwd").alias("gross"), (F.sum(F.when(F.col("kept").isNull(), 1).otherwise(0)) / F.max("top_n")).alias("turnover"))
    months = base.groupBy("month", F.col("a").alias("i")).agg(F.avg("fwd").alias("equal_weight"), F.count("*").alias("universe"))
    every = months.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(len(cells) - 1))))
    ret = F.coalesce(F.col("gross") - F.col("turnover") * cost, F.lit(0.0))
    return every.join(g, ["month", "cell"], "left").select("month", "i", "cell", ret.alias("ret"), F.coalesce("turnover", F.lit(0.0)).alias("turnover"), "equal_weight", "universe")


def walk_forward_choice(rot: DataFrame, min_train: int = 12) -> DataFrame:
    """Each month, the cell with the best mean past excess, and what it then earned."""
    w = Window.partitionBy("cell").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    past = rot.select("*", F.avg(F.col("ret") - F.col("equal_weight")).over(w).alias("past"), F.count("*").over(w).alias("n"))
    return past.where(F.col("n") >= min_train).groupBy("month").agg(
        F.max_by(F.struct("cell", "ret", "equal_weight"), F.struct(F.round("past", 10), -F.col("cell"))).alias("x")).select("month", "x.*")


# --- release and note outcomes ----------------------------------------------------------------------------------

def entry_day(ts: str, open_minutes: int = 570) -> Column:
    """First day that can trade on a release: the same day before the open, else the next."""
    minutes = F.hour(ts) * 60 + F.minute(ts)
    return F.when(minutes < open_minutes, F.to_date(ts)).otherwise(F.date_add(F.to_date(ts), 1))


def known_day(ts: str, close_hour: int = 16) -> Column:
    """Last day whose close was finished when a release came out."""
    return F.when(F.hour(ts) >= close_hour, F.to_date(ts)).otherwise(F.date_sub(F.to_date(ts), 1))


def release_outcomes(releases: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int]) -> DataFrame:
    """Entry, prior closes and returns against the benchmark over benchmark sessions.

    Everything after the entry depends only on (ticker, entry date), so outcomes
    are computed once per such pair and joined to the releases.
    """
    b = bars.select("ticker", F.col("date").alias("d"), "open", "close", F.lag("close").over(Window.partitionBy("ticker").orderBy("date")).alias("prior_close"))
    base = releases.withColumn("_want", entry_day("ts")).withColumn("_known", known_day("ts"))
    r = base
    r = asof_join(r, b.withColumn("at", F.col("d")), "ticker", "_want", "d", {"at": "entry_date", "open": "entry_open", "prior_close": "prior_close"}, direction="forward")
    r = asof_join(r, b, "ticker", "_known", "d", {"close": "pre_close"}, points=base).where("entry_date is not null")
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    cal = bench.select("date", "open", "close", F.row_number().over(w).alias("s"), *[F.lead("date", h - 1).over(w).alias(f"x{h}") for h in horizons],
                       *[F.lead("close", h - 1).over(w).alias(f"c{h}") for h in horizons])
    # Entries depend on the wanted day alone, so the pairs come from the bars, not from the releases.
    days = bars.select("ticker", F.col("date").alias("entry_date"), F.col("open").alias("entry_open"))
    pairs = days
    cols = {"open": "b_open", **{f"x{h}": f"x{h}" for h in horizons}, **{f"c{h}": f"c{h}" for h in horizons}}
    pairs = asof_join(pairs, cal.withColumnRenamed("date", "bd"), None, "entry_date", "bd", cols, direction="forward").where("b_open is not null")
    start = pairs
    for h in horizons:
        pairs = asof_join(pairs, b, "ticker", f"x{h}", "d", {"close": f"p{h}"}, points=start)
    pairs = pairs.select("ticker", "entry_date", *[F.when(F.col(f"x{h}").isNotNull(), ind.ratio(f"p{h}", "entry_open") - 1).alias(f"ret_{h}d") for h in horizons],
                         *[(ind.ratio(f"c{h}", "b_open") - 1).alias(f"bench_ret_{h}d") for h in horizons])
    out = r.join(pairs, ["ticker", "entry_date"])
    return out.withColumn("complete", F.col(f"ret_{horizons[-1]}d").isNotNull()).drop("_want", "_known")


def note_outcomes(subjects: DataFrame, bars: DataFrame, bench: DataFrame, horizons: list[int]) -> DataFrame:
    """Entry at the first close a note could act on; returns over the stock's own bars, benchmark by date."""
    want = F.when(F.col("hour") < 16, F.col("published")).otherwise(F.date_add("published", 1))
    b = bars.select("ticker", F.col("date").alias("d"), F.col("date").alias("entry_date"), F.col("close").alias("entry_close"),
                    *[ind.lead("close", h).alias(f"c{h}") for h in horizons], *[ind.lead("date", h).alias(f"x{h}") for h in horizons])
    cols = {c: c for c in b.columns if c not in ("ticker", "d")}
    n = asof_join(subjects.withColumn("ticker", F.col("symbol")).withColumn("_want", want), b, "ticker", "_want", "d", cols, direction="forward")
    n = n.where("entry_date is not null")
    bench_px = bench.select(F.col("date").alias("bd"), "close")
    start = bars.select(F.col("date").alias("entry_date"), *[ind.lead("date", h).alias(f"x{h}") for h in horizons])
    n = asof_join(n, bench_px, None, "entry_date", "bd", {"close": "b0"}, points=start)
    for h in horizons:
        n = asof_join(n, bench_px, None, f"x{h}", "bd", {"close": f"b{h}"}, points=start)
    return n.select("report_id", "symbol", "published", "entry_date", "entry_close", *[(ind.ratio(f"c{h}", "entry_close") - 1).alias(f"ret_{h}") for h in horizons],
                    *[(ind.ratio(f"b{h}", "b0") - 1).alias(f"bench_{h}") for h in horizons])


def dedupe_outcomes(rows: DataFrame, keys: list[str], info: Column, version: str) -> DataFrame:
    """One row per key: the one with more attached information, then the earliest."""
    best = rows.groupBy(*keys).agg(F.min(F.struct(-info, F.col(version))).alias("_b")).select(*keys, F.col(f"_b.{version}").alias(version))
    return rows.join(best, [*keys, version], "left_semi")


def excess_by_horizon(rows: DataFrame, keys: list[str], horizons: list[int]) -> DataFrame:
    legs = F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"ret_{h}d") - F.col(f"bench_ret_{h}d")).alias("x")) for h in horizons])
    return rows.select(*keys, F.explode(legs).alias("l")).select(*keys, "l.*").where("x is not null")


def pooled_beat(long: DataFrame) -> DataFrame:
    return long.groupBy("horizon").agg(F.avg((F.col("x") > 0).cast("double")).alias("pool_beat"), F.count("*").alias("n"))


def horizon_summary(long: DataFrame, group: str) -> DataFrame:
    """Count, mean, 1%-trimmed mean, median, beat rate and its z against the pooled rate, per group and horizon."""
    pool = pooled_beat(long).select("horizon", "pool_beat")
    n, beat, p = F.col("n"), F.col("beat"), F.col("pool_beat")
    g = long.groupBy(group, "horizon").agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.avg((F.col("x") > 0).cast("double")).alias("beat"))
    t = ranks.trimmed_mean(long, [group, "horizon"], "x").join(ranks.quantiles(long, [group, "horizon"], "x", {"median": 0.5}), [group, "horizon"])
    z = F.when((p > 0) & (p < 1), (beat - p) / F.sqrt(p * (1 - p) / n))
    return g.join(t, [group, "horizon"]).join(pool, "horizon").withColumn("z", z)


def track_record(notes: DataFrame, horizons: list[int], dip: float = 0.10) -> DataFrame:
    """Excess return of overlapping note groups; a note may belong to several."""
    bull = F.col("tone") == "bullish"
    beaten = F.coalesce(F.col("off_high") <= -dip, F.lit(False))
    rules = {
        "bullish, beaten down, turning up": bull & beaten & F.coalesce(F.col("turning_up"), F.lit(False)),
        "bullish, beaten down": bull & beaten,
        "bullish, not beaten down": bull & ~beaten & F.col("off_high").isNotNull(),
        "all bullish": bull,
        "neutral": F.col("tone") == "neutral",
        "bearish": F.col("tone") == "bearish",
    }
    member = F.explode(F.filter(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]), lambda x: x.isNotNull()))
    legs = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), (F.col(f"ret_{h}") - F.col(f"bench_{h}")).alias("x")) for h in horizons]))
    long = notes.withColumn("label", member).select("label", legs.alias("l")).select("label", "l.*").where("x is not null")
    return long.groupBy("label", "horizon").agg(F.count("*").alias("n"), F.avg("x").alias("avg_excess"), F.avg((F.col("x") > 0).cast("double")).alias("hit_rate")).join(
        ranks.quantiles(long, ["label", "horizon"], "x", {"median_excess": 0.5}), ["label", "horizon"])


def same_day_diagnostic(returns: DataFrame, daily: DataFrame, n: int = 20) -> DataFrame:
    """Noon-to-close return on days confirmed as spikes at their close.

    A look-ahead diagnostic only: the split uses the day's own close, so the
    difference it shows could not have been traded.
    """
    confirmed = (F.col("volume") > ind.prior_mean("volume", n)) & (F.col("close") > ind.lag("close"))
    d = daily.select("ticker", F.col("date").alias("day"), F.coalesce(confirmed, F.lit(False)).alias("confirmed"))
    noon = returns.where("checkpoint = 12 and exit = 'same_session_close'").drop("is_event").join(d, ["ticker", "day"])
    return noon.groupBy(F.col("confirmed").alias("is_event")).agg(F.count("*").alias("n"), F.avg(F.col("ret") + 0.0005).alias("mean_ret"))


def variant_mean_without_top(bars: DataFrame, n: int = 5) -> DataFrame:
    events, _ = breakout_study(bars)
    e = events.where("exit = 'hold_20'")
    return e.groupBy("variant").agg(F.count("*").alias("n")).join(ranks.mean_without_top(e, ["variant"], "ret", n), "variant")


def outcomes(t) -> DataFrame:
    """Release outcomes of a data directory, against the mean of its session bars."""
    from tapeloom.sources.bridge import benchmark_bars

    return release_outcomes(t.releases, t.day_bars, benchmark_bars(t.day_bars), [1, 5, 20, 60])


def deduped_outcomes(t) -> DataFrame:
    info = (F.col("materiality") == "high").cast("int") + (F.col("category") == "financing").cast("int")
    return dedupe_outcomes(outcomes(t), ["ticker", "entry_date"], info, "guid")


def scored_notes(notes: DataFrame, tags: DataFrame, bars: DataFrame) -> DataFrame:
    """Tagged note outcomes with the price context of their entry day."""
    from tapeloom.operators.scans import price_context

    ctx = price_context(bars).select(F.col("ticker").alias("symbol"), F.col("date").alias("entry_date"), F.col("pct_off_high").alias("off_high"), "turning_up")
    return notes.join(tags, "report_id").join(ctx, ["symbol", "entry_date"], "left")
