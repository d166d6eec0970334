"""Document, filing and text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import text
from tapeloom.operators import documents as doc
from tapeloom.plans import oracle
from tapeloom.plans.registry import query
from tapeloom.sources import raw

FR = oracle.FRAGMENTS

# The stored pages have one article of headings, paragraphs, bold text and breaks, with the five basic entities and two more.
# As in HTML, and in the query, their semicolon may be missing: a heading is cut at a fixed length, also inside an entity.
FR["articles"] = r"""arx AS (SELECT page_id, regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) AS a FROM pages),
ary AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(a, '\s+', ' ', 'g'), '<(?:/?(?:p|h[1-6]|div|li|ul|table|tr)|br)\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g') AS a FROM arx),
arz AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(a, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#39;?', chr(39), 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g') AS a FROM ary),
articles AS MATERIALIZED (SELECT page_id, nullif(array_to_string(list_filter(list_transform(string_split(a, chr(10)), lambda l: trim(l)), lambda l: l <> ''), chr(10)), '') AS body FROM arz)"""
query("n1_article_text", "page_id:i body", "WITH @articles SELECT * FROM articles")(lambda t: doc.article_text(t.pages))
query("x10_html_body_lines", "page_id:i lines:i", "WITH @articles SELECT page_id, len(string_split(body, chr(10))) AS lines FROM articles")(
    lambda t: doc.article_text(t.pages).select("page_id", F.size(F.split("body", "\n")).alias("lines")))

FR["form4"] = """f4 AS (SELECT * FROM events),
form4 AS MATERIALIZED (SELECT 'acc-' || event_id AS accession, event_type AS ticker, ts :: DATE AS filing_date, 'Owner ' || (user_id % 40) AS owner, event_id % 2 = 1 AS is_director, event_id % 3 % 2 = 1 AS is_officer,
  CASE WHEN event_id % 4 = 0 THEN 'P' ELSE 'S' END AS code, event_id % 100 + 1 AS shares, value AS price, ts :: DATE AS date FROM f4
  UNION ALL SELECT 'acc-' || event_id, event_type, ts :: DATE, 'Owner ' || (user_id % 40), event_id % 2 = 1, event_id % 3 % 2 = 1, 'A', event_id % 7 + 1, value, ts :: DATE FROM f4)"""
form4 = lambda t: doc.form4_transactions(raw.form4_filings(t.events))
buys = lambda t: doc.filed_buys(raw.form4_filings(t.events))
F4 = "accession ticker filing_date:d owner is_director:b is_officer:b code shares:f price:f date:d"
query("n2_form4_transactions", F4, "WITH @form4 SELECT * FROM form4")(form4)
query("x9_xml_parse", F4, "WITH @form4 SELECT * FROM form4")(form4)
query("p55_insider_buys", F4, "WITH @form4 SELECT * FROM form4 WHERE code = 'P'")(lambda t: buys(t))
query("a22_insider_clusters", "ticker filing_date:d owners:i lots:i shares:f",
      "WITH @form4 SELECT ticker, filing_date, count(DISTINCT owner) AS owners, count(*) AS lots, sum(shares) AS shares FROM form4 WHERE code = 'P' GROUP BY 1, 2 HAVING count(DISTINCT owner) >= 2")(
    lambda t: doc.insider_clusters(buys(t)))
query("a22_insider_lots", "ticker owner lots:i shares:f", "WITH @form4 SELECT ticker, owner, count(*) AS lots, sum(shares) AS shares FROM form4 WHERE code = 'P' GROUP BY 1, 2")(
    lambda t: buys(t).groupBy("ticker", "owner").agg(F.count("*").alias("lots"), F.sum("shares").alias("shares")))
query("f12_materiality_floor", "accession value:f4", "WITH @form4 SELECT accession, shares * price AS value FROM form4 WHERE code = 'P' AND shares * price >= 500")(
    lambda t: buys(t).withColumn("value", F.col("shares") * F.col("price")).where("value >= 500"))
FR["activist"] = """activist AS MATERIALIZED (SELECT 'https://filings.example/' || (event_id % 500) || '.txt' AS url, CASE WHEN event_id % 4 <> 0 THEN 'T' || user_id END AS ticker,
  'Fund ' || (event_id % 13) || CASE WHEN event_id % 2 = 0 THEN '; Fund ' || (event_id % 7 + 20) ELSE '' END AS filer, 'Target ' || user_id AS subject,
  greatest(event_id % 90 + 0.5, CASE WHEN event_id % 3 = 0 THEN event_id % 40 ELSE 0 END) AS pct FROM events)"""
activist = lambda t: doc.activist_filings(raw.activist_texts(t.events))
query("n3_activist_filings", "url ticker filer subject pct:f", "WITH @activist SELECT * FROM activist")(activist)
query("x2_regex_percent", "url pct:f", "WITH @activist SELECT url, pct FROM activist")(activist)
query("u5_accession_deduplication", "accession ticker:s",
      "WITH @activist SELECT regexp_extract(url, '([0-9]+)\\.txt$', 1) AS accession, min(ticker) AS ticker FROM activist GROUP BY 1")(lambda t: doc.dedupe_by_accession(activist(t)))
FR["index"] = f"""ix AS (SELECT *, list_value({', '.join(repr(f) for f in raw.FORM_CYCLE)})[event_id % 9 + 1] AS form FROM events WHERE event_id % 17 <> 0),
index_rows AS MATERIALIZED (SELECT user_id AS cik, 'Company ' || user_id AS name, form, ts :: DATE AS date, 'data/' || user_id || '/' || event_id || '.txt' AS filename FROM ix)"""
index = lambda t: doc.filing_index(raw.index_lines(t.events))
query("s10_filing_index", "cik:i name form date:d filename", "WITH @index SELECT * FROM index_rows")(index)
CAT = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in doc.FORMS.items())
hits = lambda t: doc.scan_hits(index(t), raw.watchlist(t.events), raw.company_names(t.events))
HITS = f"""WITH @index, hit AS (SELECT *, CASE WHEN cik % 3 = 0 THEN 'T' || cik END AS ticker, CASE form {CAT} END AS category, 'https://filings.example/Archives/' || filename AS url FROM index_rows
  WHERE cik % 2 = 0 AND form IN ({', '.join(repr(k) for k in doc.FORMS)}))"""
query("f10_filing_hits", "cik:i form date:d ticker category url", f"{HITS} SELECT * FROM hit")(hits)
query("f11_business_day_range", "cik:i form date:d", f"{HITS} SELECT * FROM hit WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND isodow(date) < 6")(
    lambda t: hits(t).where("date between date'2024-01-05' and date'2024-01-20' and weekday(date) < 5"))
query("k5_dedupe_then_limit", "url cik:i", f"{HITS}, d AS (SELECT cik, max(url) AS url FROM hit GROUP BY 1) SELECT * FROM d ORDER BY url DESC LIMIT 20")(
    lambda t: hits(t).groupBy("cik").agg(F.max("url").alias("url")).orderBy(F.col("url").desc()).limit(20))
FR["shortvol"] = "shortvol AS MATERIALIZED (SELECT event_type AS symbol, ts :: DATE AS date, count_if(value < 20) AS short, count(*) AS total, count_if(value < 20) / count(*) AS ratio FROM events GROUP BY 1, 2)"
short = lambda t: doc.short_volume(raw.short_volume_lines(t.events))
query("s11_short_volume_scan", "symbol date:d short:f total:f ratio:f", "WITH @shortvol SELECT * FROM shortvol")(short)
query("n5_rss_items", "feed guid title link published:i",
      """SELECT 'feed' || (user_id % 4) AS feed, event_id || s AS guid, CASE s WHEN 'a' THEN 'Release ' || event_type ELSE 'Follow-up' END AS title, 'https://news.example/en/' || event_id AS link,
      CAST(epoch(date_trunc('second', ts) + INTERVAL 5 HOUR) AS BIGINT) AS published FROM events, (VALUES ('a'), ('b')) v(s)""")(
    lambda t: doc.feed_items(raw.rss_documents(t.events)).withColumn("published", F.unix_timestamp("published")))
query("x3_publication_time", "guid published:i toronto",
      """SELECT event_id || s AS guid, CAST(epoch(date_trunc('second', ts) + INTERVAL 5 HOUR) AS BIGINT) AS published, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS toronto FROM events, (VALUES ('a'), ('b')) v(s)""")(
    lambda t: doc.feed_items(raw.rss_documents(t.events)).withColumn(
        "toronto", F.date_format(text.toronto_time(F.col("published")), "yyyy-MM-dd HH:mm:ss")).withColumn("published", F.unix_timestamp("published")))
query("n5_json_list_items", "feed guid title symbol",
      """SELECT event_type AS feed, 'news:' || (event_id * 10) AS guid, 'News ' || user_id AS title, event_type AS symbol FROM events
      UNION ALL SELECT event_type, 'news:' || (event_id * 10 + 2), 'Third', event_type FROM events WHERE event_id % 2 = 0""")(lambda t: doc.list_items(raw.list_responses(t.events)))
query("x8_json_salvage", "feed guid", "SELECT event_type AS feed, 'news:' || (event_id * 10) AS guid FROM events UNION ALL SELECT event_type, 'news:' || (event_id * 10 + 2) FROM events WHERE event_id % 2 = 0")(
    lambda t: doc.list_items(raw.list_responses(t.events)))
query("x8_json_round_trip", "event_id:i k:i detail", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{\"k\":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS detail FROM events")(
    lambda t: t.events.withColumn("m", F.from_json("props", "k bigint")).select("event_id", F.col("m.k").alias("k"), F.to_json("m").alias("detail")))
FR["digest"] = """dga AS (SELECT doc_id, source, TIMESTAMP '1998-03-01 18:24:00' + INTERVAL 1 DAY * (doc_id % 28) AS as_of FROM documents),
dgb AS (SELECT doc_id, as_of, date_trunc('day', as_of) + INTERVAL 1 MINUTE * (((doc_id % 12 + 1) % 12 + 12) * 60 + 15) AS tt, 'Alpha ' || source AS company, 'LTH,AW:CN,A' || (doc_id % 5) || ':US' AS pairs FROM dga
  UNION ALL SELECT doc_id, as_of, date_trunc('day', as_of) + INTERVAL 1 MINUTE * ((((doc_id + 3) % 12 + 1) % 12) * 60 + 15), 'Beta', 'XYZ' FROM dga),
digest AS MATERIALIZED (SELECT doc_id AS digest_id, strftime(CASE WHEN tt > as_of THEN tt - INTERVAL 1 DAY ELSE tt END, '%Y-%m-%d %H:%M:%S') AS published, company, 'Note ' || doc_id AS headline, pairs FROM dgb)"""
pairs_text = lambda: F.array_join(F.transform("pairs", lambda p: F.when(p["exchange"] == "", p["symbol"]).otherwise(F.concat_ws(":", p["symbol"], p["exchange"]))), ",")
digest = lambda t: doc.digest_items(raw.digests(t.documents)).withColumn("pairs", pairs_text()).withColumn("published", F.date_format("published", "yyyy-MM-dd HH:mm:ss"))
query("n4_digest_items", "digest_id:i published company headline pairs", "WITH @digest SELECT * FROM digest")(digest)
query("x6_listed_pairs", "digest_id:i company pairs", "WITH @digest SELECT * FROM digest")(digest)
FR["facts"] = """fcf AS (SELECT c_custkey AS k, c_acctbal AS b FROM customer),
fcv AS (SELECT k AS cik, 'assets' AS metric, 'Assets' AS tag, b + 20000 AS val, DATE '2000-03-31' AS "end" FROM fcf
  UNION ALL SELECT k, 'equity', 'StockholdersEquity', CASE WHEN k % 2 = 0 THEN b + 5000 ELSE b + 4000 END, CASE WHEN k % 2 = 0 THEN DATE '2000-03-31' ELSE DATE '1999-12-31' END FROM fcf
  UNION ALL SELECT k, 'revenue', 'Revenues', k * 2.5, DATE '1999-12-31' FROM fcf UNION ALL SELECT k, 'net_income', 'ProfitLoss', k * 1.5, DATE '2000-03-31' FROM fcf WHERE k % 4 <> 0
  UNION ALL SELECT k, 'liabilities', CASE WHEN k % 3 = 0 THEN 'Liabilities' WHEN k % 2 = 0 THEN 'DERIVED(assets-equity)' ELSE 'LiabilitiesAndStockholdersEquity' END,
    CASE WHEN k % 3 = 0 THEN 1234.5 WHEN k % 2 = 0 THEN b + 20000 - (b + 5000) ELSE b + 20000 END, DATE '2000-03-31' FROM fcf WHERE k % 3 = 0 OR k % 2 = 0 OR k % 5 < 3)"""
FU = "cik:i metric tag val:f2 end:d"
facts = lambda t: doc.fundamentals(raw.company_facts(t.customer))
query("p54_fundamentals_pick", FU, "WITH @facts SELECT * FROM fcv")(facts)
query("n6_company_facts", FU, "WITH @facts SELECT * FROM fcv")(facts)
query("x7_map_explode", "cik:i facts:i", "WITH @facts SELECT cik, count(*) AS facts FROM fcv GROUP BY 1")(lambda t: facts(t).groupBy("cik").agg(F.count("*").alias("facts")))
query("n7_clean_labels", "report_id:i tone_clean action_clean",
      "WITH @tags SELECT report_id, CASE WHEN report_id % 7 = 0 THEN 'neutral' ELSE tone END AS tone_clean, CASE WHEN action IN ('upgrade', 'downgrade') THEN action ELSE 'other' END AS action_clean FROM tags")(
    lambda t: doc.clean_labels(t.tags.withColumn("tone", F.when(F.col("report_id") % 7 == 0, "unsure").otherwise(F.concat(F.lit(" "), F.initcap("tone")))),
                               {"tone": (["bullish", "bearish", "neutral"], "neutral"), "action": (["upgrade", "downgrade"], "other")}))
query("x11_loose_values", "o_orderkey:i priority number:f",
      "SELECT o_orderkey, CASE WHEN lower(trim(substring(o_orderpriority, 3))) IN ('urgent', 'high') THEN lower(trim(substring(o_orderpriority, 3))) ELSE 'other' END AS priority, o_totalprice AS number FROM orders")(
    lambda t: t.orders.select("o_orderkey", text.closed_vocabulary(F.substring("o_orderpriority", 3, 20), ["urgent", "high"], "other").alias("priority"),
                              text.to_number(F.concat(F.lit("$ "), F.format_number("o_totalprice", 2))).alias("number")))
FR["picks"] = """picks AS (SELECT published AS day, CASE WHEN report_id % 2 = 0 THEN 'bullish' ELSE 'bearish' END AS side, report_id, report_id % 5 AS rank FROM reports UNION ALL
  SELECT published, CASE WHEN report_id % 2 = 0 THEN 'bullish' ELSE 'bearish' END, report_id, report_id % 7 + 5 FROM reports)"""
picks = lambda t: doc.daily_picks(t.reports)
query("n8_highlight_selection", "day:d side report_id:i rank:i place:i",
      """WITH @reports, @tags, @picks, o AS (SELECT day, side, report_id, min(rank) AS rank FROM picks LEFT JOIN tags USING (report_id) WHERE tone IS NULL OR tone <> CASE side WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END GROUP BY 1, 2, 3)
      SELECT *, row_number() OVER (PARTITION BY day, side ORDER BY rank, report_id) AS place FROM o QUALIFY place <= 2""")(lambda t: doc.select_highlights(picks(t), t.tags, 2))
query("n8_day_readiness", "day:d notes:i tagged:i ready:b",
      "WITH @reports, @tags SELECT published AS day, count(*) AS notes, count(tone) AS tagged, count(tone) = count(*) AS ready FROM reports LEFT JOIN tags USING (report_id) GROUP BY 1")(
    lambda t: t.reports.join(t.tags, "report_id", "left").groupBy(F.col("published").alias("day")).agg(F.count("*").alias("notes"), F.count("tone").alias("tagged")).withColumn(
        "ready", F.col("notes") == F.col("tagged")))

# --- scalar families --------------------------------------------------------------------------------------------

query("x1_string_functions", "p_partkey:i ticker candidates class_symbol company headline alert",
      """SELECT p_partkey, upper(trim(p_brand)) AS ticker, CASE WHEN p_partkey % 3 = 0 THEN 'P' || p_partkey || '.CN' WHEN p_partkey % 3 = 1 THEN 'P' || p_partkey || '.V' ELSE 'P' || p_partkey || '.TO,P' || p_partkey || '.V,P' || p_partkey || '.CN,P' || p_partkey END AS candidates,
      'A' || p_partkey || '-B' AS class_symbol, p_name AS company, 'size ' || p_size || ' - more' AS headline, p_type AS alert FROM part""")(
    lambda t: doc.string_showcase(t.part))
query("x1_compact_numbers", "o_orderkey:i compact",
      "SELECT o_orderkey, CASE WHEN v >= 1e9 THEN printf('%.1f', floor(v / 1e9 * 10 + 0.5000001) / 10) || 'B' WHEN v >= 1e6 THEN printf('%.1f', floor(v / 1e6 * 10 + 0.5000001) / 10) || 'M' WHEN v >= 1e3 THEN printf('%.1f', floor(v / 1e3 * 10 + 0.5000001) / 10) || 'K' "
      "ELSE printf('%.0f', floor(v + 0.5000001)) END AS compact FROM (SELECT o_orderkey, o_totalprice * 3 AS v FROM orders)")(
    lambda t: t.orders.select("o_orderkey", text.compact(F.col("o_totalprice") * 3).alias("compact")))
query("x4_bounded_math", "c_custkey:i logged:f clipped:f ratio:f annual:f",
      """SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN ln(1 + abs(c_acctbal)) ELSE -ln(1 + abs(c_acctbal)) END AS logged, least(100, greatest(0, 50 + c_acctbal / 100)) AS clipped, c_acctbal / (abs(c_acctbal) + 1e-9) AS ratio,
      CASE WHEN 1 + c_acctbal / 1000 > 0 THEN (1 + c_acctbal / 1000) ** (252.0 / 60) - 1 END AS annual FROM customer""")(lambda t: doc.math_showcase(t.customer))
query("x12_null_handling", "event_id:i cleaned:f", "SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS cleaned FROM events")(lambda t: doc.null_showcase(t.events))
query("u6_name_token_difference", "a:i b:i matched:b",
      """WITH n AS (SELECT p_partkey AS k, string_split(p_name, ' ') AS w FROM part WHERE p_partkey % 2 = 0), m AS (SELECT p_partkey AS k, string_split(p_name, ' ') || [CASE WHEN p_partkey % 4 = 1 THEN 'canada' ELSE 'inc' END] AS w FROM part WHERE p_partkey % 2 = 1)
      SELECT n.k AS a, m.k AS b, m.k % 4 <> 1 AND (n.w[2] = m.w[2]) AS matched FROM n JOIN m ON n.k + 1 = m.k AND n.w[1] = m.w[1]""")(lambda t: doc.name_pairs(t.part))
