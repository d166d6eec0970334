"""Raw text in the formats the document jobs read, written out from the stored tables.

The stored tables hold no filings or feeds, so each row is rendered as the text a
collector would have saved; the jobs parse it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORM_CYCLE = ["4", "SC 13D", "8-K", "10-Q", "SC 13G/A", "3", "13F-HR", "S-1", "5"]


def _s(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def index_lines(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    form = F.element_at(F.array(*[F.lit(x) for x in FORM_CYCLE]), (i % 9 + 1).cast("int"))
    day = F.when(i % 2 == 0, F.date_format("ts", "yyyyMMdd")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    line = F.concat_ws("|", _s("user_id"), F.concat(F.lit("Company "), _s("user_id")), form, day, F.concat(F.lit("data/"), _s("user_id"), F.lit("/"), _s("event_id"), F.lit(".txt")))
    return events.select(F.when(i % 17 == 0, F.concat(F.lit("header|"), _s("event_id"))).otherwise(line).alias("value"))


def company_names(events: DataFrame) -> DataFrame:
    """names(cik, ticker): listed companies, one row per company."""
    return events.where("user_id % 3 = 0").select(F.col("user_id").alias("cik"), F.concat(F.lit("T"), _s("user_id")).alias("ticker")).distinct()


def watchlist(events: DataFrame) -> DataFrame:
    return events.where("user_id % 2 = 0").select(F.col("user_id").alias("cik")).distinct()


def short_volume_lines(events: DataFrame) -> DataFrame:
    g = events.groupBy(F.date_format("ts", "yyyyMMdd").alias("d"), "event_type").agg(
        F.count_if(F.col("value") < 20).alias("short"), F.count_if(F.col("value") < 2).alias("exempt"), F.count("*").alias("total"))
    lines = g.select(F.concat_ws("|", "d", "event_type", _s("short"), _s("exempt"), _s("total"), F.lit("Q")).alias("value"))
    heads = g.select("d").distinct().select(F.lit("Date|Symbol|ShortVolume|ShortExemptVolume|TotalVolume|Market").alias("value"))
    return lines.unionByName(heads)


def form4_filings(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    lot = lambda code, shares: F.concat(
        F.lit("<transaction><code>"), code, F.lit("</code><shares>"), _s(shares), F.lit("</shares><price>"), _s("value"), F.lit("</price><date>"),
        F.date_format("ts", "yyyy-MM-dd"), F.lit("</date></transaction>"))
    xml = F.concat(
        F.lit("<ownershipDocument><reportingOwner><name>Owner "), _s(F.col("user_id") % 40), F.lit("</name><isDirector>"), _s(i % 2), F.lit("</isDirector><isOfficer>"), _s(i % 3 % 2),
        F.lit("</isOfficer></reportingOwner><transactions>"), lot(F.when(i % 4 == 0, "P").otherwise("S"), i % 100 + 1), lot(F.lit("A"), i % 7 + 1),
        F.lit("</transactions></ownershipDocument>"))
    return events.select(
        F.concat(F.lit("acc-"), _s("event_id")).alias("accession"), F.col("event_type").alias("ticker"), F.to_date("ts").alias("filing_date"), xml.alias("xml"))


def activist_texts(events: DataFrame) -> DataFrame:
    i = F.col("event_id")
    block = lambda label, name: F.concat(F.lit(f"{label}:\n COMPANY DATA:\n  COMPANY CONFORMED NAME:   "), name, F.lit("\n  CENTRAL INDEX KEY: 0\n"))
    body = F.concat(
        block("SUBJECT COMPANY", F.concat(F.lit("Target "), _s("user_id"))), block("FILED BY", F.concat(F.lit("Fund "), _s(i % 13))),
        F.when(i % 2 == 0, block("FILED BY", F.concat(F.lit("Fund "), _s(i % 7 + 20)))).otherwise(""),
        F.lit("\nPercent of Class represented: "), _s(i % 90), F.lit(".5%\n"), F.when(i % 3 == 0, F.concat(F.lit("Percent  of class (row 13) "), _s(i % 40), F.lit("%"))).otherwise(""))
    return events.select(
        F.concat(F.lit("https://filings.example/"), _s(i % 500), F.lit(".txt")).alias("url"), F.when(i % 4 != 0, F.concat(F.lit("T"), _s("user_id"))).alias("ticker"), body.alias("body"))


def rss_documents(events: DataFrame) -> DataFrame:
    item = lambda suffix, title: F.concat(
        F.lit("<item><guid>"), _s("event_id"), F.lit(suffix + "</guid><title> "), title, F.lit(" </title><link>https://news.example/en/"), _s("event_id"), F.lit("</link><pubDate>"),
        F.date_format("ts", "EEE, d MMM yyyy HH:mm:ss"), F.lit(" -0500</pubDate></item>"))
    xml = F.concat(F.lit("<rss><channel>"), item("a", F.concat(F.lit("Release "), _s("event_type"))), item("b", F.lit("Follow-up")), F.lit("</channel></rss>"))
    return events.select(F.concat(F.lit("feed"), _s(F.col("user_id") % 4)).alias("feed"), xml.alias("xml"))


def list_responses(events: DataFrame) -> DataFrame:
    entry = lambda i, lang, title: F.concat(
        F.lit("{\"id\": "), _s(i), F.lit(", \"title\": \""), title, F.lit(f"\", \"language\": \"{lang}\", \"mainSymbol\": \""), _s("event_type"), F.lit("\", \"date\": \"2024-01-01\"}"))
    i = F.col("event_id") * 10
    body = F.concat(F.lit("{\"totalItems\": 3, \"list\": ["), entry(i, "en", F.concat(F.lit("News "), _s("user_id"))), F.lit(", "), entry(i + 1, "fr", F.lit("Nouvelle")), F.lit(", "),
                    entry(i + 2, "en", F.lit("Third")))
    whole = F.concat(body, F.lit("]}"))
    cut = F.substring(whole, F.lit(1), F.length(whole) - 20)
    return events.select(F.col("event_type").alias("feed"), F.when(F.col("event_id") % 2 == 0, whole).otherwise(cut).alias("body"))


def digests(documents: DataFrame) -> DataFrame:
    i = F.col("doc_id")
    item = lambda hh, half, company, tickers: F.concat(
        F.lit("<tr class=\"item\"><td>"), tickers, F.lit("</td> "), hh, F.lit(f":15{half}m ET <b>"), company, F.lit(" - Note <i>"), _s("doc_id"), F.lit("</i></b></tr>"))
    html = F.concat(
        F.lit("<table>"), item(_s(i % 12 + 1), "p", F.concat(F.lit("Alpha "), F.col("source")), F.concat(F.lit("LTH AW CN A"), _s(i % 5), F.lit(" US ..."))),
        item(_s((i + 3) % 12 + 1), "a", F.lit("Beta"), F.lit("XYZ XYZ")), F.lit("</table>"))
    as_of = F.make_timestamp_ntz(F.lit(1998), F.lit(3), (i % 28 + 1).cast("int"), F.lit(18), F.lit(24), F.lit(0).cast("decimal(16,6)"))
    return documents.select(i.alias("digest_id"), as_of.alias("as_of"), html.alias("html"))


def company_facts(customers: DataFrame) -> DataFrame:
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    e = lambda val, end, start=None: F.concat(
        F.lit("{\"val\": "), _s(val), F.lit(f", \"end\": \"{end}\"" + (f", \"start\": \"{start}\"" if start else "") + ", \"form\": \"10-Q\"}"))
    tag = lambda name, *entries: F.concat(F.lit(f"\"{name}\": {{\"units\": {{\"USD\": ["), F.concat_ws(", ", *entries), F.lit("]}}"))
    parts = F.concat_ws(
        ", ", tag("Assets", e(b + 20000, "2000-03-31"), e(b + 10000, "1999-12-31")),
        F.when(k % 2 == 0, tag("StockholdersEquity", e(b + 5000, "2000-03-31"))).otherwise(tag("StockholdersEquity", e(b + 4000, "1999-12-31"))),
        F.when(k % 3 == 0, tag("Liabilities", e(F.lit(1234.5), "2000-03-31"))).when(k % 3 == 1, tag("Liabilities", e(F.lit(99.5), "1998-12-31"))),
        F.when(k % 5 < 3, tag("LiabilitiesAndStockholdersEquity", e(b + 20000, "2000-03-31"))),
        tag("Revenues", e(k * 10.5, "2000-03-31", "1999-04-01"), e(k * 2.5, "1999-12-31", "1999-10-01")),
        F.when(k % 4 != 0, tag("ProfitLoss", e(k * 1.5, "2000-03-31", "2000-01-01"))))
    return customers.select(k.alias("cik"), F.when(k % 2 == 0, F.concat(F.lit("{\"facts\": {\"us-gaap\": {"), parts, F.lit("}}}"))).otherwise(F.concat(F.lit("{"), parts, F.lit("}"))).alias("json"))
