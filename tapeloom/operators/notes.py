"""Broker notes, releases and watchlists: feeds, candidates and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.functions import text
from tapeloom.operators.asof import asof_join
from tapeloom.operators.scans import latest, price_context

# Action groups of the feed filter.
ACTION_GROUPS = {"ratings": ["upgrade", "downgrade"], "coverage": ["initiate"]}


def exploded(reports: DataFrame) -> DataFrame:
    """report_tickers(report_id, position, symbol) from the ordered array."""
    return reports.select("report_id", "published", F.posexplode("tickers").alias("position", "symbol"))


def feed(reports: DataFrame, tags: DataFrame, since: str | None = None, ticker: str | None = None, words: str | None = None,
         tone: str | None = None, action: str | None = None) -> DataFrame:
    """Notes filtered by window, ticker membership, text and labels; an action may name a group."""
    r = reports.join(tags, "report_id", "left")
    if since and not ticker:
        r = r.where(F.col("published") >= F.lit(since).cast("date"))
    if ticker:
        named = exploded(reports).where(F.col("symbol") == ticker).select("report_id")
        r = r.join(named, "report_id", "left_semi")
    if words:
        r = r.where(F.col("theme").contains(words) | F.col("lang").contains(words))
    if tone:
        r = r.where(F.col("tone") == tone)
    if action:
        r = r.where(F.col("action").isin(ACTION_GROUPS.get(action, [action])))
    return r


def feed_page(rows: DataFrame, size: int) -> DataFrame:
    """Newest rows of a feed with the total and whether the page is cut."""
    page = rows.orderBy(F.col("published").desc(), "report_id").limit(size)
    return page.withColumn("total", rows.agg(F.count("*")).scalar()).withColumn("truncated", F.col("total") > size)


def company_notes(reports: DataFrame, most: int = 2) -> DataFrame:
    """Notes about a company: few listed tickers."""
    return reports.where(F.size("tickers") <= most)


def top_covered(reports: DataFrame, n: int) -> DataFrame:
    notes = company_notes(reports).select("report_id", F.col("tickers")[0].alias("symbol"))
    return notes.groupBy("symbol").agg(F.countDistinct("report_id").alias("notes")).orderBy(F.col("notes").desc(), "symbol").limit(n)


def theme_counts(reports: DataFrame, tags: DataFrame) -> DataFrame:
    return reports.join(tags, "report_id").groupBy("theme").agg(
        F.count("*").alias("notes"), F.count_if(F.col("tone") == "bullish").alias("bullish"), F.count_if(F.col("tone") == "bearish").alias("bearish"))


def digest_overview(reports: DataFrame, tags: DataFrame, totals: DataFrame) -> DataFrame:
    """Per digest day: tone split, moves by action group, and notes missed against the largest alert total."""
    r = reports.join(tags, "report_id", "left").withColumn("tone", F.coalesce("tone", F.lit("untagged")))
    g = r.groupBy("published").pivot("tone", ["bullish", "neutral", "bearish", "untagged"]).count().na.fill(0)
    moves = r.groupBy("published").agg(F.count("*").alias("notes"), *[F.count_if(F.col("action").isin(a)).alias(k) for k, a in ACTION_GROUPS.items()])
    most = totals.groupBy("published").agg(F.max("total").alias("total"))
    return g.join(moves, "published").join(most, "published", "left").withColumn("missed", F.greatest(F.lit(0), F.coalesce(F.col("total") - F.col("notes"), F.lit(0))))


def unresolved_subjects(subjects: DataFrame, symbol_map: DataFrame) -> DataFrame:
    """Subjects with no mapping on (symbol, exchange, company), newest note first."""
    todo = subjects.join(symbol_map, ["symbol", "exchange", "company"], "left_anti")
    return todo.groupBy("symbol", "exchange", "company").agg(F.max("published").alias("newest"))


def note_prices(subjects: DataFrame, bars: DataFrame) -> DataFrame:
    """Last close finished before each note (16:00 rule)."""
    want = F.when(F.col("hour") >= 16, F.col("published")).otherwise(F.date_sub("published", 1))
    px = bars.select("ticker", F.col("date").alias("d"), "close")
    s = subjects.withColumn("ticker", F.col("symbol")).withColumn("_want", want)
    return asof_join(s, px, "ticker", "_want", "d", {"close": "base_close"}).where("base_close is not null").select("report_id", "base_close")


def latest_context(bars: DataFrame) -> DataFrame:
    """Newest price context per ticker."""
    return latest(price_context(bars))


def candidates(reports: DataFrame, subjects: DataFrame, tags: DataFrame, symbol_map: DataFrame, bars: DataFrame) -> DataFrame:
    """Bullish company notes with mapping, price context and price before the note: six tables."""
    notes = company_notes(reports).select("report_id").join(tags.where("tone = 'bullish'"), "report_id").join(subjects, "report_id")
    ctx = latest_context(bars).withColumn("market_symbol", F.concat("ticker", F.lit(".TO"))).drop("ticker", "date")
    j = notes.join(symbol_map, ["symbol", "exchange", "company"], "left").join(ctx, "market_symbol", "left").join(note_prices(subjects, bars), "report_id", "left")
    return j.withColumn("since_note", ind.ratio("close", "base_close") - 1)


def candidate_table(rows: DataFrame) -> DataFrame:
    """One row per stock: its newest note and how many there were."""
    newest = F.max_by(F.struct("report_id", "market_symbol", "close", "pct_off_high", "since_note"), F.struct("published", "report_id"))
    return rows.groupBy("symbol", "company").agg(F.count("*").alias("notes"), F.max("published").alias("published"), newest.alias("n")).select(
        "symbol", "company", "notes", "published", "n.*")


def backlog(releases: DataFrame, parsed: DataFrame) -> DataFrame:
    return releases.join(parsed.select("guid"), "guid", "left_anti")


def parsed_of(releases: DataFrame) -> DataFrame:
    """parsed(guid, headline): the releases read so far."""
    return releases.where("guid % 3 <> 0").select("guid", F.concat("category", F.lit(" by "), "ticker").alias("headline"))


def analysis_of(releases: DataFrame) -> DataFrame:
    """analysis(guid, json): verdicts stored as JSON text."""
    verdict = F.when(F.col("value") > 50, "positive").when(F.col("value") < 5, "negative").otherwise("neutral")
    return releases.where("guid % 2 = 0").select("guid", F.to_json(F.struct(verdict.alias("verdict"), F.col("value").alias("score"))).alias("json"))


def terms_of(releases: DataFrame) -> DataFrame:
    """terms(guid, issue_price, offered, outstanding, offering_type): financing terms."""
    v = F.col("value")
    kind = F.when(F.col("guid") % 3 == 0, "public_offering").when(F.col("guid") % 3 == 1, "private_placement").otherwise("rights")
    return releases.where("category = 'financing'").select(
        "guid", (45 + v * 2).alias("issue_price"), F.when(F.col("guid") % 5 != 0, v * 1000).alias("offered"), (10000 + F.col("user_id") * 100).cast("double").alias("outstanding"), kind.alias("offering_type"))


def release_view(releases: DataFrame) -> DataFrame:
    """Seen releases with their parse, verdict and terms where they exist."""
    a = analysis_of(releases).select("guid", F.from_json("json", "verdict string, score double").alias("a")).select("guid", "a.verdict", "a.score")
    return releases.join(parsed_of(releases), "guid", "left").join(a, "guid", "left").join(terms_of(releases), "guid", "left")


def release_events(releases: DataFrame) -> DataFrame:
    """Parsed releases with a ticker, and their verdict if analysed."""
    a = analysis_of(releases).select("guid", F.get_json_object("json", "$.verdict").alias("verdict"))
    return releases.where("ticker is not null and ticker <> ''").join(parsed_of(releases), "guid").join(a, "guid", "left")


def financing_metrics(rows: DataFrame) -> DataFrame:
    """Discount to the last close before, dilution, and their buckets; rows carry terms and pre_close."""
    d, s = ind.ratio("issue_price", "pre_close") - 1, F.col("offered") / F.nullif("outstanding", F.lit(0.0))
    bucket_d = (F.when(F.col("discount").isNull(), None).when(F.col("discount") >= 0, "a premium (>= 0%)").when(F.col("discount") > -0.10, "b 0 to -10%")
                .when(F.col("discount") > -0.25, "c -10 to -25%").otherwise("d below -25%"))
    bucket_s = (F.when(F.col("dilution").isNull(), None).when(F.col("dilution") < 0.05, "a < 5%").when(F.col("dilution") < 0.15, "b 5-15%")
                .when(F.col("dilution") < 0.30, "c 15-30%").otherwise("d >= 30%"))
    return rows.withColumn("discount", d).withColumn("dilution", s).withColumn("discount_bucket", bucket_d).withColumn("dilution_bucket", bucket_s)


RISK_FLAGS = {"public_offering": "Public offering: a risk flag, not a signal."}


def risk_flag(c: str) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RISK_FLAGS.items() for x in kv])
    return table[F.col(c)]


def shares_before(releases: DataFrame, filings: DataFrame, max_age: int) -> DataFrame:
    """Share count on file at or before a release, not older than ``max_age`` days."""
    r = releases.withColumn("day", F.to_date("ts"))
    f = filings.select("ticker", F.col("filed").alias("at"), F.col("filed").alias("as_of"), "shares")
    j = asof_join(r, f, "ticker", "day", "at", {"shares": "shares", "as_of": "as_of"})
    return j.withColumn("shares_outstanding", F.when(F.datediff("day", "as_of") <= max_age, F.col("shares")))


def watch_items(releases: DataFrame) -> DataFrame:
    """Watchlist: the newest high release per user and ticker, with the price it was flagged at."""
    g = releases.where("materiality = 'high'").groupBy("user_id", "ticker").agg(F.max(F.struct("ts", "guid", "value")).alias("r"))
    status = F.when(F.col("r.guid") % 3 == 0, "watching").when(F.col("r.guid") % 3 == 1, "inbox").otherwise("closed")
    return g.select("user_id", "ticker", F.to_date("r.ts").alias("flagged"), F.col("r.guid").alias("guid"), (F.col("r.value") + 1).alias("flag_price"), status.alias("status"))


def price_history(items: DataFrame, bars: DataFrame) -> DataFrame:
    """Closes of a watched ticker from the day it was flagged."""
    days = items.where("status = 'watching'").withColumn("end", bars.agg(F.max("date")).scalar()).where("flagged <= end").withColumn("date", F.explode(F.sequence("flagged", "end")))
    return days.join(bars.select("ticker", "date", "close"), ["ticker", "date"]).select("user_id", "ticker", "guid", "date", "close")


def with_history(items: DataFrame, history: DataFrame, recent: int = 5) -> DataFrame:
    """Items with their last closes as an ordered array; only the rows that fit are nested."""
    w = Window.partitionBy("guid").orderBy(F.col("date").desc())
    last = history.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= recent)
    nested = last.groupBy("guid").agg(F.sort_array(F.collect_list(F.struct("date", "close"))).alias("history"))
    return items.join(nested, "guid", "left")


def watch_state(items: DataFrame, history: DataFrame) -> DataFrame:
    """Latest price of each item (the flag price without history), change and age."""
    last = history.groupBy("guid").agg(F.max_by("close", "date").alias("last_close"), F.max("date").alias("last_date"))
    j = items.join(last, "guid", "left").withColumn("price", F.coalesce("last_close", "flag_price"))
    return j.withColumn("change_pct", (ind.ratio("price", "flag_price") - 1) * 100).withColumn("days", F.coalesce(F.datediff("last_date", "flagged"), F.lit(0)))


def first_listed(requests: DataFrame, known: DataFrame) -> DataFrame:
    """First candidate symbol, in order, that has any history before the publication day."""
    c = requests.select("guid", "day", F.posexplode(text.symbol_candidates(F.col("listing"))).alias("pos", "symbol"))
    hit = c.join(known, "symbol").where("first_date < day")
    return hit.groupBy("guid").agg(F.min_by("symbol", "pos").alias("symbol"))


def company_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of company names that match.

    The names of each side are reduced to distinct strings and split by (first token,
    token) on the shared non-leading tokens, so a common first word does not put all
    its pairs in one place; one-word names meet on the first token alone.
    """
    a = left.select("name_a").distinct().withColumn("ta", text.name_tokens(F.col("name_a")))
    b = right.select("name_b").distinct().withColumn("tb", text.name_tokens(F.col("name_b")))
    keyed = lambda df, t: df.withColumn("first", F.get(t, F.lit(0))).withColumn(
        "key", F.explode(F.when(F.size(t) == 1, F.array(F.lit(""))).otherwise(F.array_distinct(F.slice(t, 2, 2**30)))))
    multi = keyed(a, "ta").where("key <> ''").join(keyed(b, "tb").where("key <> ''"), ["first", "key"])
    # A one-word name matches any name with that first word, so those pairs are real results.
    lead = lambda df, t: df.withColumn("first", F.get(t, F.lit(0)))
    fa, fb = lead(a, "ta"), lead(b, "tb")
    short = fa.where("size(ta) = 1").join(fb, "first").unionByName(fa.where("size(ta) > 1").join(fb.where("size(tb) = 1"), "first"))
    pairs = multi.select("name_a", "name_b", "ta", "tb").unionByName(short.select("name_a", "name_b", "ta", "tb")).dropDuplicates(["name_a", "name_b"])
    return pairs.where(text.names_match(F.col("ta"), F.col("tb"))).select("name_a", "name_b")


def highlight_rows(reports: DataFrame, subjects: DataFrame, tags: DataFrame, symbol_map: DataFrame, bars: DataFrame, cap: int = 2) -> DataFrame:
    """Selected highlights with subject, tone, mapping, price context and return since the note."""
    from tapeloom.operators.documents import daily_picks, select_highlights

    h = select_highlights(daily_picks(reports), tags, cap).join(subjects.drop("published"), "report_id").join(tags, "report_id", "left")
    ctx = latest_context(bars).select(F.concat("ticker", F.lit(".TO")).alias("market_symbol"), "close")
    j = h.join(symbol_map, ["symbol", "exchange", "company"], "left").join(ctx, "market_symbol", "left").join(note_prices(subjects, bars), "report_id", "left")
    return j.withColumn("since_note", ind.ratio("close", "base_close") - 1)


def stale_releases(releases: DataFrame, days: int = 7) -> DataFrame:
    """Older than ``days`` before the newest release; an unreadable time is not stale."""
    read = F.when(F.col("guid") % 9 != 0, F.col("ts"))
    return releases.select("guid", F.coalesce(releases.agg(F.max("ts")).scalar() - read > F.expr(f"INTERVAL {days} DAYS"), F.lit(False)).alias("stale"))


def listed_requests(events: DataFrame) -> DataFrame:
    """Releases naming a company without a suffix, resolved to the first market symbol with earlier history."""
    suffix = F.when(F.col("user_id") % 3 == 0, ".V").when(F.col("user_id") % 3 == 1, ".CN").otherwise("")
    name = F.concat(F.lit("U"), F.col("user_id").cast("string"))
    start = events.agg(F.to_date(F.min("ts"))).scalar()
    known = events.select(F.concat(name, suffix).alias("symbol")).distinct().withColumn("first_date", start)
    return first_listed(events.select(F.col("event_id").alias("guid"), F.to_date("ts").alias("day"), name.alias("listing")), known)
