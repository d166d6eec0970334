"""Filings, releases and digests parsed as Spark jobs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import text

#: Pieces of a page: comments and elements nobody sees, tags with name and attributes, and text.
_PIECE = re.compile(r"<!--.*?-->|<!.*?>|<(script|style|noscript)\b.*?</\1\s*>|<(?P<end>/?)(?P<name>[a-z][\w:-]*)(?P<attrs>[^>]*)>|(?P<text>[^<]+|<)", re.S | re.I)
#: What opens an article's body, in order of preference.
MARKERS = (
    lambda name, attrs: re.search(r"\bitemprop\s*=\s*[\"']?articleBody\b", attrs),
    lambda name, attrs: name == "article" and re.search(r"\bid\s*=\s*[\"']?release\b", attrs),
    lambda name, attrs: name == "article",
)
#: Tags that end a line, and those that end a cell of a table row.
_LINES = re.compile("p|div|br|li|h[1-6]|table|ul|ol|section|article|blockquote")
_CELL, _CELLS = "\x1f", ("td", "th")


def _body(pieces: list[re.Match]) -> list[re.Match]:
    """The pieces inside the best marked element: up to the tag that closes as many of its name as were opened."""
    opened = [(i, m["name"].lower(), m["attrs"]) for i, m in enumerate(pieces) if m["name"] and not m["end"]]
    for marker in MARKERS:
        found = next(((i, name) for i, name, attrs in opened if marker(name, attrs)), None)
        if found:
            inside = pieces[found[0] + 1 :]
            steps = [0 if (m["name"] or "").lower() != found[1] else -1 if m["end"] else 1 for m in inside]
            closed = next((k for k, level in enumerate(accumulate(steps)) if level < 0), len(inside))
            return inside[:closed]
    return []


def page_text(page: str | None) -> str | None:
    """Visible text of a page's article, a line for each block and one with bars for each table row; None without an article."""
    if page is None:
        return None
    out, in_row = [], False
    for m in _body(list(_PIECE.finditer(page))):
        name = (m["name"] or "").lower()
        if m["text"]:
            out.append(unescape(m["text"]).replace("\n", " "))
        elif name == "tr":
            out.append("\n")
            in_row = not m["end"]
        elif name in _CELLS and in_row:
            out.append(_CELL if m["end"] else "")
        elif _LINES.fullmatch(name):
            out.append(" " if in_row else "\n")
    rows = ([" ".join(cell.split()) for cell in line.split(_CELL)] for line in "".join(out).split("\n"))
    lines = (" | ".join(filter(None, cells)) for cells in rows)
    return "\n".join(filter(None, lines)) or None


def article_text(pages: DataFrame) -> DataFrame:
    """pages(page_id, html) to (page_id, body): HTML is parsed in Arrow batches inside tasks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"page_id": b["page_id"], "body": [page_text(h) for h in b["html"]]})

    return pages.select("page_id", "html").mapInPandas(run, "page_id bigint, body string")


FORM4 = ("reportingOwner struct<name:string,isDirector:int,isOfficer:int>, "
         "transactions struct<transaction:array<struct<code:string,shares:double,price:double,date:string>>>")


def form4_transactions(filings: DataFrame) -> DataFrame:
    """filings(accession, ticker, filing_date, xml) to one row per transaction."""
    f = filings.withColumn("d", F.from_xml("xml", FORM4))
    return f.select("accession", "ticker", "filing_date", F.col("d.reportingOwner.name").alias("owner"), (F.col("d.reportingOwner.isDirector") == 1).alias("is_director"),
                    (F.col("d.reportingOwner.isOfficer") == 1).alias("is_officer"), F.explode("d.transactions.transaction").alias("t")).select(
        "accession", "ticker", "filing_date", "owner", "is_director", "is_officer", "t.code", "t.shares", "t.price", F.to_date("t.date").alias("date"))


def open_market_buys(transactions: DataFrame) -> DataFrame:
    return transactions.where("code = 'P'")


# A code that starts with P, an entity, CDATA, a comment or an instruction; every filing with an open-market purchase has one.
BUY_CODE = r"<(?:[^<>\s]*:)?(?i:code)(?:\s[^<]*)?>\s*(?:P|&|<!|<\?)"


def filed_buys(filings: DataFrame) -> DataFrame:
    """The open-market purchases of filings; the text of a filing that can't hold one is searched but not parsed."""
    return open_market_buys(form4_transactions(filings.where(F.col("xml").rlike(BUY_CODE))))


def insider_clusters(buys: DataFrame, min_owners: int = 2) -> DataFrame:
    """Company-days with several distinct buyers."""
    g = buys.groupBy("ticker", "filing_date").agg(F.countDistinct("owner").alias("owners"), F.count("*").alias("lots"), F.sum("shares").alias("shares"))
    return g.where(F.col("owners") >= min_owners)


# Labels that open a block of a filing's header.
HEADER_LABELS = ["SUBJECT COMPANY", "FILED BY", "FILER", "ISSUER", "REPORTING-OWNER"]


def header_names(c: Column, label: str) -> Column:
    """Company names of every header block with this label, distinct and in order.  A block runs up to the next label."""
    blocks = F.slice(F.split(c, f"(?i)\\b{label}\\s*:"), 2, 2**30)
    own = lambda b: F.get(F.split(b, f"(?i)\\b(?:{'|'.join(HEADER_LABELS)})\\s*:", 2), F.lit(0))
    names = F.transform(blocks, lambda b: F.trim(F.regexp_extract(own(b), "(?i)CONFORMED NAME\\s*:[ \\t]*([^\\r\\n]+)", 1)))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def percent_of_class(c: Column) -> Column:
    """Largest of the first percentages after each "Percent of Class"."""
    parts = F.slice(F.split(c, "(?i)Percent\\s+of\\s+Class"), 2, 2**30)
    first = F.transform(parts, lambda p: F.nullif(F.regexp_extract(p, "(\\d{1,3}(?:\\.\\d+)?)\\s*%", 1), F.lit("")).cast("double"))
    return F.array_max(first)


def activist_filings(filings: DataFrame) -> DataFrame:
    """filings(url, ticker, body) to filers, subject and stake."""
    return filings.select(
        "url", "ticker", F.array_join(header_names(F.col("body"), "FILED BY"), "; ").alias("filer"),
        F.get(header_names(F.col("body"), "SUBJECT COMPANY"), F.lit(0)).alias("subject"), percent_of_class(F.col("body")).alias("pct"))


def accession(url: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1), "\\.txt$", "")


def dedupe_by_accession(hits: DataFrame) -> DataFrame:
    """One row per accession, preferring one that has a ticker."""
    h = hits.withColumn("accession", accession(F.col("url")))
    rest = [c for c in h.columns if c != "accession"]
    first = F.min(F.struct(F.col("ticker").isNull(), *[F.col(c) for c in rest]))
    return h.groupBy("accession").agg(first.alias("_r")).select("accession", *[F.col(f"_r.{c}").alias(c) for c in rest])


INDEX = "cik string, name string, form string, filed string, filename string"
# Forms of interest and what they mean.
FORMS = {
    "4": "insider_txn",
    "3": "insider_init",
    "5": "insider_annual",
    "SC 13D": "activist_stake",
    "SC 13D/A": "activist_stake_amend",
    "SC 13G": "passive_stake",
    "SC 13G/A": "passive_stake_amend",
    "SCHEDULE 13D": "activist_stake",
    "SCHEDULE 13D/A": "activist_stake_amend",
    "SCHEDULE 13G": "passive_stake",
    "SCHEDULE 13G/A": "passive_stake_amend",
    "8-K": "material_event",
    "13F-HR": "institutional_holdings",
}


def filing_index(lines: DataFrame) -> DataFrame:
    """Pipe-delimited index lines (value): five fields and a numeric CIK, dates basic or extended."""
    p = F.split("value", "\\|")
    rows = lines.where((F.size(p) == 5) & F.get(p, F.lit(0)).rlike("^[0-9]+$"))
    field = lambda i: F.get(p, F.lit(i))
    d = F.trim(field(3))
    day = F.coalesce(F.try_to_timestamp(d, F.lit("yyyyMMdd")), F.try_to_timestamp(d, F.lit("yyyy-MM-dd"))).cast("date")
    return rows.select(field(0).cast("bigint").alias("cik"), field(1).alias("name"), F.trim(field(2)).alias("form"), day.alias("date"), field(4).alias("filename"))


def scan_hits(index: DataFrame, watchlist: DataFrame, names: DataFrame) -> DataFrame:
    """Index rows of interest for watched companies, with category, ticker and URL."""
    category = F.create_map(*[F.lit(x) for kv in FORMS.items() for x in kv])
    h = index.where(F.col("form").isin(*FORMS)).join(watchlist.select("cik").distinct(), "cik", "left_semi").join(names, "cik", "left")
    return h.select("cik", "name", "form", "date", "ticker", category[F.col("form")].alias("category"), F.concat(F.lit("https://filings.example/Archives/"), "filename").alias("url"))


def short_volume(lines: DataFrame) -> DataFrame:
    """``Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market`` lines with a positive total."""
    f = F.from_csv(F.col("value"), "d string, symbol string, short double, exempt double, total double, market string", {"sep": "|"})
    r = lines.where(~F.col("value").startswith("Date|")).select(f.alias("f")).select("f.*")
    return r.where("total > 0").select("symbol", F.try_to_date("d", "yyyyMMdd").alias("date"), "short", "total", (F.col("short") / F.col("total")).alias("ratio"))


RSS = "channel struct<item:array<struct<guid:string,title:string,link:string,pubDate:string,category:string>>>"


def feed_items(feeds: DataFrame) -> DataFrame:
    """feeds(feed, xml) to one row per item."""
    return feeds.select("feed", F.explode(F.from_xml("xml", RSS)["channel"]["item"]).alias("i")).select(
        "feed", "i.guid", F.trim("i.title").alias("title"), "i.link", text.parse_published(F.col("i.pubDate")).alias("published"))


def salvage_entries(c: Column) -> Column:
    """Complete flat objects of a JSON list that may be cut off."""
    body = F.regexp_extract(c, "(?s)\"list\"\\s*:\\s*\\[(.*)", 1)
    return F.regexp_extract_all(body, F.lit("(\\{[^{}]*\\})"), F.lit(1))


def list_items(responses: DataFrame) -> DataFrame:
    """responses(feed, body): JSON lists, possibly truncated, to items; French and untitled ones are dropped."""
    e = F.from_json("e", "id bigint, title string, language string, mainSymbol string, date string")
    rows = responses.select("feed", F.explode(salvage_entries(F.col("body"))).alias("e")).select("feed", e.alias("j")).select("feed", "j.*")
    keep = rows.where("id is not null and title is not null and coalesce(language, '') <> 'fr'")
    return keep.select("feed", F.concat(F.lit("news:"), F.col("id").cast("string")).alias("guid"), F.trim("title").alias("title"), F.trim("mainSymbol").alias("symbol"))


def digest_items(digests: DataFrame) -> DataFrame:
    """digests(digest_id, as_of, html) to items: time with day roll-back, company, headline and listed pairs.

    Blocks are cut with ``split`` and read with regular expressions on columns.
    """
    block = F.explode(F.slice(F.split("html", "<tr class=\"item\">"), 2, 2**30))
    b = digests.select("digest_id", "as_of", block.alias("b"))
    plain = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("b", p, 1), "<[^>]+>", " "), "\\s+", " "))
    title = plain("(?s)<b>(.*?)</b>")
    b = b.select("digest_id", "as_of", F.regexp_extract("b", "(\\d{1,2}:\\d{2}[ap]m) ET", 1).alias("clock"), title.alias("title"), plain("(?s)<td>(.*?)</td>").alias("listed"))
    company, headline = text.split_title(F.col("title"))
    return b.where("clock <> ''").select(
        "digest_id", text.clock_time(F.col("as_of"), F.col("clock"), F.col("as_of")).alias("published"), company.alias("company"), headline.alias("headline"),
        text.listed_pairs(F.col("listed")).alias("pairs"))


# --- company facts ----------------------------------------------------------------------------------------------

# Candidate tags per metric, and the metrics measured over a period.
METRIC_TAGS = {
    "revenue": ["Revenues", "RevenueFromContractWithCustomerExcludingAssessedTax", "RevenueFromContractWithCustomerIncludingAssessedTax", "SalesRevenueNet"],
    "net_income": ["NetIncomeLoss", "ProfitLoss", "NetIncomeLossAvailableToCommonStockholdersBasic"],
    "assets": ["Assets"],
    "liabilities": ["Liabilities", "LiabilitiesAndStockholdersEquity"],
    "equity": ["StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"],
    "eps_diluted": ["EarningsPerShareDiluted", "EarningsPerShareBasicAndDiluted"],
    "cash": ["CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents"],
    "long_term_debt": ["LongTermDebtNoncurrent", "LongTermDebt", "LongTermDebtAndCapitalLeaseObligations", "DebtInstrumentCarryingAmount"],
}
FLOWS = ["revenue", "net_income", "eps_diluted"]
#: Bare maps of tags, and files that nest them as facts, taxonomy, tag.
FACTS = "map<string,struct<units:map<string,array<struct<val:double,start:string,end:string,form:string,fy:int,fp:string>>>>>"


def fundamentals(facts: DataFrame, stale_days: int = 120) -> DataFrame:
    """facts(cik, json) to the chosen value per metric.

    Newest wins; period metrics prefer a quarter of 80 to 100 days; balance metrics
    must lie within ``stale_days`` of the newest assets; missing liabilities are
    assets minus equity of the same date.
    """
    metric = F.create_map(*[F.lit(x) for m, ts in METRIC_TAGS.items() for t in ts for x in (t, m)])
    order = F.create_map(*[F.lit(x) for m, ts in METRIC_TAGS.items() for i, t in enumerate(ts) for x in (t, i)])
    # Spread by company before anything is parsed: one task may hold all texts of a small file.  Every later step stays on this partitioning.
    facts = facts.select("cik", "json").repartition("cik")
    nested = F.get_json_object("json", "$.facts.us-gaap")
    tags = facts.select("cik", F.explode(F.from_json(F.coalesce(nested, F.col("json")), FACTS)).alias("tag", "f"))
    units = tags.select("cik", "tag", F.explode("f.units").alias("unit", "entries"))
    e = units.select("cik", "tag", "unit", F.explode("entries").alias("x")).select(
        "cik", metric[F.col("tag")].alias("metric"), order[F.col("tag")].alias("rank"), "tag", "unit", "x.val", F.to_date("x.end").alias("end"),
        F.datediff(F.to_date("x.end"), F.to_date("x.start")).alias("days")).where("metric is not null and val is not null and end is not null")
    m = F.col("metric")
    company = Window.partitionBy("cik").orderBy("metric").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    e = e.withColumn("anchor", F.max(F.when(m == "assets", F.col("end"))).over(company))
    flow = m.isin(*FLOWS)
    quarter = F.coalesce(F.col("days").between(80, 100), F.lit(False))
    usable = e.where(flow | F.col("anchor").isNull() | (F.abs(F.datediff("anchor", "end")) <= stale_days))
    best = F.max_by(F.struct("tag", "unit", "val", "end", "days"), F.struct(F.when(flow & quarter, 1).otherwise(0), F.col("end"), -F.col("rank")))
    picked = usable.groupBy("cik", "metric").agg(best.alias("b"))
    side = lambda name: F.max(F.when(m == name, F.col("b"))).over(company).alias(name)
    sides = picked.select("cik", "metric", "b", side("assets"), side("equity"), side("liabilities"))
    named = F.col("liabilities.tag")
    derive = F.coalesce((F.col("assets.end") == F.col("equity.end")) & (named.isNull() | (named == "LiabilitiesAndStockholdersEquity")), F.lit(False))
    derived = F.struct(F.lit("liabilities").alias("metric"), F.lit("DERIVED(assets-equity)").alias("tag"), F.col("assets.unit").alias("unit"),
                       (F.col("assets.val") - F.col("equity.val")).alias("val"), F.col("assets.end").alias("end"), F.lit(None).cast("int").alias("days"))
    kept = F.struct("metric", "b.*")
    rows = F.filter(F.array(F.when(~(derive & (m == "liabilities")), kept), F.when(derive & (m == "assets"), derived)), lambda x: x.isNotNull())
    return sides.select("cik", F.explode(rows).alias("r")).select("cik", "r.*")


def clean_labels(raw: DataFrame, fields: dict[str, tuple[list[str], str]]) -> DataFrame:
    """Supplied classifier labels limited to their vocabularies."""
    return raw.select("*", *[text.closed_vocabulary(F.col(c), allowed, other).alias(f"{c}_clean") for c, (allowed, other) in fields.items()])


def select_highlights(picks: DataFrame, tags: DataFrame, cap: int) -> DataFrame:
    """Supplied picks per day and side: first mention of a note, never against its tone, at most ``cap`` a side."""
    p = picks.join(tags.select("report_id", "tone"), "report_id", "left")
    wrong = F.when(F.col("side") == "bullish", "bearish").otherwise("bullish")
    p = p.where(F.col("tone").isNull() | (F.col("tone") != wrong))
    first = p.groupBy("day", "side", "report_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("day", "side").orderBy("rank", "report_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= cap)


def daily_picks(reports: DataFrame) -> DataFrame:
    """Supplied picks: every note is proposed twice for its day, with different ranks."""
    side = F.when(F.col("report_id") % 2 == 0, "bullish").otherwise("bearish")
    ranks = F.explode(F.array(F.col("report_id") % 5, F.col("report_id") % 7 + 5))
    return reports.select(F.col("published").alias("day"), side.alias("side"), "report_id", ranks.alias("rank"))


def string_showcase(part: DataFrame) -> DataFrame:
    """The text clean-ups over part names."""
    k = F.col("p_partkey")
    listing = F.concat(F.lit(" p"), k.cast("string"), F.when(k % 3 == 0, ".cse").when(k % 3 == 1, ".v").otherwise(""))
    company, headline = text.split_title(F.concat("p_name", F.lit(" - size "), F.col("p_size").cast("string"), F.lit(" - more")))
    return part.select(
        "p_partkey", text.clean_ticker(F.concat(F.lit(" "), F.lower("p_brand"))).alias("ticker"), F.array_join(text.symbol_candidates(listing), ",").alias("candidates"),
        text.share_class(F.concat(F.lit("A"), k.cast("string"), F.lit(".B"))).alias("class_symbol"), company.alias("company"), headline.alias("headline"),
        text.alert_name(F.concat(F.lit("Broker - Equities, Sectors, "), F.col("p_type"))).alias("alert"))


def math_showcase(customers: DataFrame) -> DataFrame:
    """Signed logs, clipping, guarded ratios and annualisation that stops at a total loss."""
    b = F.col("c_acctbal")
    base = 1 + b / 1000
    return customers.select(
        "c_custkey", F.when(b > -1, F.log1p(F.abs(b))).otherwise(-F.log1p(F.abs(b))).alias("logged"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + b / 100)).alias("clipped"),
        (b / (F.abs(b) + 1e-9)).alias("ratio"), F.when(base > 0, F.pow(base, 252.0 / 60) - 1).alias("annual"))


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def null_showcase(events: DataFrame) -> DataFrame:
    i = F.col("event_id") % 5
    dirty = F.when(i == 0, F.lit(float("nan"))).when(i == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    return events.select("event_id", finite(dirty).alias("cleaned"))


def name_pairs(part: DataFrame) -> DataFrame:
    """Even and odd part names compared as company names, blocked on the first token."""
    suffix = F.when(F.col("p_partkey") % 4 == 1, " Canada").otherwise(" Inc.")
    a = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("a"), text.name_tokens(F.col("p_name")).alias("ta"))
    b = part.where("p_partkey % 2 = 1").select(F.col("p_partkey").alias("b"), text.name_tokens(F.concat("p_name", suffix)).alias("tb"))
    j = a.join(b, (F.get("ta", F.lit(0)) == F.get("tb", F.lit(0))) & (F.col("a") + 1 == F.col("b")))
    return j.select("a", "b", F.coalesce(text.names_match(F.col("ta"), F.col("tb")), F.lit(False)).alias("matched"))
