"""Loading, checking and merging tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.operators.asof import asof_join


def load_bars(bars: DataFrame, tickers: list[str] | None, start: str, end: str) -> DataFrame:
    """Bars of some tickers in a date range; both filters reach the scan of a stored table."""
    out = bars.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return out.where(F.col("ticker").isin(tickers)) if tickers else out


def as_known(bars: DataFrame, as_of_dates: DataFrame) -> DataFrame:
    """What was known on each as-of date: bar count and last close per ticker."""
    w = Window.partitionBy("ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    until = F.lead("date").over(Window.partitionBy("ticker").orderBy("date"))
    seen = bars.select("ticker", "date", F.col("close").alias("last_close"), F.count("*").over(w).alias("bars"), until.alias("_next"))
    last = F.greatest("date", F.coalesce(F.date_sub("_next", 1), as_of_dates.agg(F.max("date")).scalar()))
    # Every bar stands for the days up to the next one; only the as-of days are kept.
    days = seen.withColumn("as_of", F.explode(F.sequence("date", last)))
    return days.join(as_of_dates.select(F.col("date").alias("as_of")).distinct(), "as_of", "left_semi")


def quality_slice(bars: DataFrame, days: int, need: int) -> DataFrame:
    """Bars of the last ``days + 60`` calendar days, for tickers with more than ``need`` of them and a positive last close."""
    recent = bars.where(F.col("date") >= F.date_sub(bars.agg(F.max("date")).scalar(), days + 60))
    good = recent.groupBy("ticker").agg(F.count("*").alias("n"), F.max_by("close", "date").alias("last")).where((F.col("n") > need) & (F.col("last") > 0))
    return recent.join(good.select("ticker"), "ticker", "left_semi")


PRICE_COLUMNS = ["open", "high", "low", "close", "volume"]


def contract_check(raw: DataFrame) -> DataFrame:
    """Every row with the reasons it breaks the bar contract; an empty list passes."""
    missing = [c for c in ["ticker", "date", *PRICE_COLUMNS] if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    typed = raw.select("ticker", "date", *[F.col(c).try_cast("double").alias(c) for c in PRICE_COLUMNS])
    h, l = F.col("high"), F.col("low")
    rules = [*[(F.col(c).isNull(), f"missing_{c}") for c in PRICE_COLUMNS], (h < l, "high_below_low"), (F.col("volume") < 0, "negative_volume"),
             ((F.col("close") > h) | (F.col("close") < l), "close_outside_range")]
    return typed.withColumn("reasons", F.filter(F.array(*[F.when(t, F.lit(n)) for t, n in rules]), lambda x: x.isNotNull()))


def load_reasons(requested: DataFrame, found: DataFrame) -> DataFrame:
    """Requested tickers with why they cannot be used; NULL when they can."""
    g = found.groupBy("ticker").agg(F.count("*").alias("rows"), F.count("close").alias("closes"), F.count(F.coalesce("open", "high", "low")).alias("prices"))
    j = requested.join(g, "ticker", "left")
    reason = F.when(F.col("rows").isNull(), "no_data").when(F.col("prices") == 0, "missing_ohlcv").when(F.col("closes") == 0, "all_nan_close")
    return j.select("ticker", "rows", reason.alias("reason"))


def upsert_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Replace, per ticker, the old rows between the first and last new date."""
    spans = new.groupBy("ticker").agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    kept = old.join(spans, "ticker", "left").where("_a is null or date < _a or date > _b").drop("_a", "_b")
    return kept.unionByName(new)


def fetch_plan(cached: DataFrame, requests: DataFrame, tolerance: int = 5, overlap: int = 5) -> DataFrame:
    """Windows still to fetch per ticker: all of it, an earlier start, or the tail with an overlap.

    ``requests`` is (ticker, start, end, newest) where newest is the last bar a
    complete table must hold and ``fresh`` tells whether that bar is today's.
    """
    have = cached.groupBy("ticker").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    j = requests.join(have, "ticker", "left")
    early = F.datediff("lo", "start") > tolerance
    tail = (F.col("hi") < F.col("newest")) | F.col("fresh")
    from_ = F.when(F.col("lo").isNull() | early, F.col("start")).otherwise(F.greatest("start", F.date_sub("hi", overlap)))
    return j.where(F.col("lo").isNull() | early | tail).select("ticker", from_.alias("fetch_from"), F.date_add("end", 1).alias("fetch_before"))


def fetch_groups(plan: DataFrame) -> DataFrame:
    """Tickers that share a fetch window."""
    return plan.groupBy("fetch_from", "fetch_before").agg(F.count("*").alias("tickers"), F.min("ticker").alias("first_ticker"))


TICKER_SPELLINGS = ["Ticker", "symbol", "ticker", "TICKER", "Symbol"]  # fixed values, in order of preference


def screener_rows(files: DataFrame) -> DataFrame:
    """Rows of dated files with ``path`` and the ticker under any known spelling: distinct (date, ticker)."""
    names = [c for c in TICKER_SPELLINGS if c in files.columns]
    parts = [F.regexp_extract("path", r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})", i) for i in (1, 2, 3)]
    day = F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd")).cast("date")
    t = F.upper(F.trim(F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in names])))
    rows = files.select(day.alias("date"), t.alias("ticker"))
    return rows.where("date is not null and ticker is not null and ticker <> 'NAN'").dropDuplicates(["date", "ticker"])


def read_screener_dir(spark, pattern: str) -> DataFrame:
    """``path, ticker`` of dated snapshot files, CSV with a header of their own or JSON lists of records, ready for ``screener_rows``.

    Headers differ from file to file, so each file is read by its own one; a snapshot is one day's screen and fits in a row.
    """
    whole = spark.read.text(pattern, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("path"), "value")
    cells = lambda line: F.transform(F.split(line, ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)"), lambda c: F.trim(F.regexp_replace(c, "^\\s*\"|\"\\s*$", "")))
    lines = F.filter(F.split(F.regexp_replace("value", "^\ufeff", ""), "\\r?\\n"), lambda line: F.trim(line) != "")
    csv = whole.where(~F.lower("path").endswith(".json")).select("path", lines.alias("lines")).where(F.size("lines") > 1)
    csv = csv.select("path", cells(F.get("lines", F.lit(0))).alias("header"), F.explode(F.slice("lines", 2, 2**30)).alias("line"))
    at = F.filter(F.array(*[F.array_position("header", c) for c in TICKER_SPELLINGS]), lambda i: i > 0)
    found = csv.select("path", F.try_element_at(cells(F.col("line")), F.get(at, F.lit(0)).cast("int")).alias("ticker"))
    records = whole.where(F.lower("path").endswith(".json")).select("path", F.explode(F.from_json("value", "array<map<string,string>>")).alias("r"))
    named = records.select("path", F.coalesce(*[F.nullif(F.trim(F.try_element_at("r", F.lit(c))), F.lit("")) for c in TICKER_SPELLINGS]).alias("ticker"))
    return found.unionByName(named)


def ticker_list(lines: DataFrame) -> DataFrame:
    """Distinct tickers of text lines without blanks, comments and ``.NE`` listings."""
    t = F.upper(F.trim("value"))
    return lines.select(t.alias("ticker")).where("ticker <> '' and ticker not like '#%' and ticker not like '%.NE'").distinct()


def earnings_dates(lines: DataFrame) -> DataFrame:
    """``ticker,report_ts`` lines to distinct (ticker, date)."""
    f = F.from_csv("value", "ticker string, report_ts string").alias("f")
    rows = lines.select(f).select("f.ticker", F.try_to_timestamp(F.substring("f.report_ts", 1, 10), F.lit("yyyy-MM-dd")).cast("date").alias("report_date"))
    return rows.dropna().distinct()


def replace_pending(old: DataFrame, new: DataFrame) -> DataFrame:
    """New pending rows instead of the old ones; history stays."""
    return old.where("intent_status <> 'PENDING'").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add rows with unseen keys; the first of a batch wins."""
    rest = [c for c in new.columns if c not in keys and c != order]
    first = new.join(old.select(*keys), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(order, *rest), order).alias("_r")).select(*keys, "_r.*")
    return old.unionByName(first.select(*old.columns))


def upsert_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per key."""
    both = old.unionByName(new)
    rest = [c for c in both.columns if c not in keys and c != version]
    return both.groupBy(*keys).agg(F.max_by(F.struct(version, *rest), version).alias("_r")).select(*keys, "_r.*")


def latest_snapshot(table: DataFrame, run: str = "run_date") -> DataFrame:
    """Rows of the newest run."""
    return table.where(F.col(run) == table.agg(F.max(run)).scalar())


def new_documents(found: DataFrame, ingested: DataFrame) -> DataFrame:
    """Files not read yet, or read without yielding anything."""
    done = ingested.where("items > 0").select("path")
    return found.join(done, "path", "left_anti")


def newest_required(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Last session on or before min(end, today) and the exclusive end of the fetch."""
    want = requests.withColumn("_want", F.least("end", "today"))
    s = sessions.select(F.col("date").alias("s"), F.col("date").alias("at"))
    return asof_join(want, s, None, "_want", "s", {"at": "newest"}).withColumn("exclusive_end", F.date_add("end", 1)).drop("_want")


def write_run(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """One directory per run; a repeated run replaces only its own partition."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("header", True).partitionBy("run_date").format(fmt).save(path))


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a state table as a whole."""
    df.write.mode("overwrite").parquet(path)


# --- inputs derived from the stored tables, for the checks above ------------------------------------------------

def damaged(bars: DataFrame) -> DataFrame:
    """Bars with known faults on three days of each month."""
    d = F.dayofmonth("date")
    return bars.select(
        "ticker", "date", "open", F.when(d == 7, F.col("low") - 1).otherwise(F.col("high")).alias("high"), "low", F.when(d != 13, F.col("close")).alias("close"),
        F.when(d == 21, -F.col("volume")).otherwise(F.col("volume")).alias("volume"))


def isolated_spikes(bars: DataFrame) -> DataFrame:
    """Spike scan over faulty input: bad rows are reported as failures and do not stop the rest."""
    from tapeloom.operators.scans import volume_spikes

    c = contract_check(damaged(bars))
    bad = c.where("size(reasons) > 0").select("ticker", "date", F.lit(True).alias("failed"), F.lit(None).cast("double").alias("spike_pct"))
    good = volume_spikes(c.where("size(reasons) = 0").drop("reasons"))
    return bad.unionByName(good.select("ticker", "date", F.lit(False).alias("failed"), "spike_pct"))


def reasons_example(part: DataFrame, bars: DataFrame) -> DataFrame:
    extra = part.sparkSession.range(2).select(F.when(F.col("id") == 0, "GONE").otherwise("VOID").alias("ticker"))
    requested = part.select(F.col("p_brand").alias("ticker")).distinct().unionByName(extra)
    keep = lambda c: F.when(F.col("ticker") != "Brand#6", F.col(c)).alias(c)
    found = bars.select("ticker", "date", keep("open"), keep("high"), keep("low"), F.when(F.col("ticker") != "Brand#5", F.col("close")).alias("close"))
    return load_reasons(requested, found)


def plan_example(part: DataFrame, bars: DataFrame) -> DataFrame:
    day = lambda s: F.lit(s).cast("date")
    requests = part.select(F.col("p_brand").alias("ticker")).distinct().select(
        "ticker", day("1995-06-01").alias("start"), day("2001-06-30").alias("end"), day("2001-06-29").alias("newest"), F.lit(False).alias("fresh"))
    cached = bars.where("(ticker < 'Brand#2' or date >= date'1996-01-01') and ticker <> 'Brand#7' and (ticker > 'Brand#22' or date < date'2001-01-01')")
    return fetch_plan(cached, requests)


def screener_example(bars: DataFrame) -> DataFrame:
    """Heavy days as rows of dated files, each with its own spelling of the ticker column."""
    k = F.dayofmonth("date") % 3
    path = F.concat(F.lit("screen_"), F.date_format("date", "yyyyMMdd"), F.lit(".csv"))
    rows = bars.where("volume >= 60").select(path.alias("path"), *[F.when(k == i, F.concat(F.lit(" "), F.lower("ticker"))).alias(c) for i, c in enumerate(["Ticker", "symbol", "ticker_"])])
    rows = rows.withColumnRenamed("ticker_", "Symbol2").withColumn("ticker2", F.col("Symbol2"))
    return rows.select("path", "Ticker", F.coalesce("symbol", "ticker2").alias("symbol")).unionByName(rows.select("path", "Ticker", F.coalesce("symbol", "ticker2").alias("symbol")))


def list_example(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey") % 5
    return part.select(F.when(k == 0, "  ").when(k == 1, F.concat(F.lit("# "), "p_name")).when(k == 2, F.concat("p_name", F.lit(".ne"))).otherwise(F.concat(F.lit(" "), "p_name")).alias("value"))


def ignore_example(events: DataFrame) -> DataFrame:
    cols = ["user_id", "event_id", "value"]
    first = events.where("event_id < 50").groupBy("user_id").agg(F.min("event_id").alias("event_id"), F.min_by("value", "event_id").alias("value"))
    return insert_ignore(first, events.where("event_id >= 50").select(*cols), ["user_id"], "event_id")
