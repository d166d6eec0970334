"""Note, release, watchlist, demand and loading queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tapeloom.functions import indicators as ind
from tapeloom.operators import demand, documents, notes, runs, scans, shaping, studies
from tapeloom.plans import oracle
from tapeloom.plans.registry import query
from tapeloom.plans.studies import O as OUTCOMES
from tapeloom.sources import loading, raw

FR = oracle.FRAGMENTS
R = "@reports, @tags"

# --- notes ------------------------------------------------------------------------------------------------------

query("m13_reports", "report_id:i published:d hour:i theme lang tickers", "WITH @reports SELECT *, array_to_string(tickers, ',') AS tickers_ FROM reports".replace("*, array_to_string(tickers, ',') AS tickers_", "report_id, published, hour, theme, lang, array_to_string(tickers, ',') AS tickers"))(
    lambda t: t.reports.withColumn("tickers", F.array_join("tickers", ",")))
query("f8_feed_filter", "report_id:i published:d tone action",
      f"WITH {R} SELECT report_id, published, tone, action FROM reports LEFT JOIN tags USING (report_id) WHERE list_contains(tickers, 'Brand#8') AND action IN ('upgrade', 'downgrade')")(
    lambda t: notes.feed(t.reports, t.tags, ticker="Brand#8", action="ratings"))
query("j16_reports_with_ticker", "report_id:i", "WITH @reports SELECT report_id FROM reports WHERE list_contains(tickers, 'Brand#4')")(
    lambda t: t.reports.join(notes.exploded(t.reports).where("symbol = 'Brand#4'"), "report_id", "left_semi"))
query("k6_feed_page", "report_id:i published:d total:i truncated:b",
      "WITH @reports, f AS (SELECT *, count(*) OVER () AS total FROM reports WHERE published >= DATE '1999-01-01') SELECT report_id, published, total, total > 50 AS truncated FROM f ORDER BY published DESC, report_id LIMIT 50")(
    lambda t: notes.feed_page(notes.feed(t.reports, t.tags, since="1999-01-01"), 50))
query("f13_company_notes", "report_id:i symbol", "WITH @reports SELECT report_id, tickers[1] AS symbol FROM reports WHERE len(tickers) <= 2")(
    lambda t: notes.company_notes(t.reports).withColumn("symbol", F.col("tickers")[0]))
query("a12_theme_counts", "theme notes:i bullish:i bearish:i",
      f"WITH {R} SELECT theme, count(*) AS notes, count_if(tone = 'bullish') AS bullish, count_if(tone = 'bearish') AS bearish FROM reports JOIN tags USING (report_id) GROUP BY 1")(lambda t: notes.theme_counts(t.reports, t.tags))
query("a13_top_covered", "symbol notes:i", "WITH @reports SELECT tickers[1] AS symbol, count(DISTINCT report_id) AS notes FROM reports WHERE len(tickers) <= 2 GROUP BY 1 ORDER BY notes DESC, symbol LIMIT 10")(
    lambda t: notes.top_covered(t.reports, 10))
query("a14_digest_day_overview", "published:d bullish:i neutral:i bearish:i untagged:i notes:i ratings:i coverage:i missed:i",
      f"""WITH {R} SELECT published, count_if(coalesce(tone, '') = 'bullish') AS bullish, count_if(coalesce(tone, '') = 'neutral') AS neutral, count_if(coalesce(tone, '') = 'bearish') AS bearish, count_if(tone IS NULL) AS untagged, count(*) AS notes,
      count_if(coalesce(action, '') IN ('upgrade', 'downgrade')) AS ratings, count_if(coalesce(action, '') = 'initiate') AS coverage, greatest(0, max(report_id % 5 + 1) - count(*)) AS missed FROM reports LEFT JOIN tags USING (report_id) GROUP BY 1""")(
    lambda t: notes.digest_overview(t.reports, t.tags, t.reports.select("published", (F.col("report_id") % 5 + 1).alias("total"))))
query("j14_untagged_reports", "report_id:i", f"WITH {R} SELECT report_id FROM reports r WHERE NOT EXISTS (SELECT 1 FROM tags g WHERE g.report_id = r.report_id)")(
    lambda t: t.reports.join(t.tags, "report_id", "left_anti"))
S = "@reports, @subjects, @symbol_map"
query("j15_unresolved_subjects", "symbol exchange company newest:d",
      f"WITH {S} SELECT symbol, exchange, company, max(published) AS newest FROM subjects s WHERE NOT EXISTS (SELECT 1 FROM symbol_map m WHERE m.symbol = s.symbol AND m.exchange = s.exchange AND m.company = s.company) GROUP BY 1, 2, 3")(
    lambda t: notes.unresolved_subjects(t.subjects, t.symbol_map))
query("j32_resolved_company_notes", "report_id:i market_symbol", f"WITH {S} SELECT report_id, market_symbol FROM subjects JOIN symbol_map USING (symbol, exchange, company) WHERE listed <= 2 AND published >= DATE '1998-06-01'")(
    lambda t: t.subjects.where("listed <= 2 and published >= date'1998-06-01'").join(t.symbol_map, ["symbol", "exchange", "company"]))
FR["cands"] = """cx AS (SELECT ticker, close, pct_off_high FROM (SELECT ticker, date, close, close / max(close) OVER y - 1 AS pct_off_high, count(*) OVER[u,0] AS n FROM bars
  WINDOW y AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW)) WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1),
cp AS (SELECT report_id, b.close AS base_close FROM (SELECT *, CASE WHEN hour >= 16 THEN published ELSE published - 1 END AS want FROM subjects) s ASOF JOIN bars b ON b.ticker = s.symbol AND s.want >= b.date),
cands AS MATERIALIZED (SELECT s.report_id, s.symbol, s.company, s.published, m.market_symbol, cx.close, pct_off_high, base_close, cx.close / base_close - 1 AS since_note FROM subjects s JOIN tags g USING (report_id)
  LEFT JOIN symbol_map m ON m.symbol = s.symbol AND m.exchange = s.exchange AND m.company = s.company LEFT JOIN cx ON cx.ticker || '.TO' = m.market_symbol LEFT JOIN cp USING (report_id) WHERE s.listed <= 2 AND tone = 'bullish')"""
CD = f"@bars, {S}, @tags, @cands"
cands = lambda t: notes.candidates(t.reports, t.subjects, t.tags, t.symbol_map, t.bars)
query("j18_candidate_rows", "report_id:i symbol company market_symbol close:f pct_off_high:f base_close:f since_note:f", f"WITH {CD} SELECT * FROM cands")(cands)
query("j18_candidate_table", "symbol company notes:i published:d report_id:i market_symbol since_note:f",
      f"WITH {CD} SELECT symbol, company, count(*) AS notes, max(published) AS published, max_by(report_id, (published, report_id)) AS report_id, max_by(market_symbol, (published, report_id)) AS market_symbol, arg_max_null(since_note, (published, report_id)) AS since_note FROM cands GROUP BY 1, 2")(
    lambda t: notes.candidate_table(cands(t)))
query("j29_highlight_rows", "day:d side report_id:i place:i symbol tone since_note:f",
      f"""WITH {CD}, @picks, o AS (SELECT day, side, report_id, min(rank) AS rank FROM picks LEFT JOIN tags USING (report_id) WHERE tone IS NULL OR tone <> CASE side WHEN 'bullish' THEN 'bearish' ELSE 'bullish' END GROUP BY 1, 2, 3),
      h AS (SELECT *, row_number() OVER (PARTITION BY day, side ORDER BY rank, report_id) AS place FROM o QUALIFY place <= 2)
      SELECT h.*, s.symbol, tone, cx.close / base_close - 1 AS since_note FROM h JOIN subjects s USING (report_id) LEFT JOIN tags USING (report_id) LEFT JOIN symbol_map m ON m.symbol = s.symbol AND m.exchange = s.exchange AND m.company = s.company
      LEFT JOIN cx ON cx.ticker || '.TO' = m.market_symbol LEFT JOIN cp USING (report_id)""")(lambda t: notes.highlight_rows(t.reports, t.subjects, t.tags, t.symbol_map, t.bars))
query("j30_latest_price_context", "ticker date:d close:f pct_off_high:f",
      """WITH @bars SELECT * FROM (SELECT ticker, date, close, close / max(close) OVER y - 1 AS pct_off_high, count(*) OVER[u,0] AS n FROM bars WINDOW y AS (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW))
      WHERE n >= 60 QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) = 1""")(lambda t: notes.latest_context(t.bars))
query("j23_company_name_match", "name_a name_b",
      """SELECT DISTINCT p_name || ' corp' AS name_a, p_name || ' holdings ' || p_type AS name_b FROM part""")(
    lambda t: notes.company_matches(t.part.select(F.concat("p_name", F.lit(" corp")).alias("name_a")), t.part.select(F.concat("p_name", F.lit(" holdings "), "p_type").alias("name_b"))))
query("j21_dimension_lookup", "trade_id:i sector", "WITH @bars, @trades, @sectors SELECT trade_id, coalesce(sector, 'Unknown') AS sector FROM trades LEFT JOIN sectors USING (ticker)")(
    lambda t: t.trades.join(t.sectors, "ticker", "left").select("trade_id", F.coalesce("sector", F.lit("Unknown")).alias("sector")))

# --- releases ---------------------------------------------------------------------------------------------------

FR["relview"] = """parsed AS (SELECT guid, category || ' by ' || ticker AS headline FROM releases WHERE guid % 3 <> 0), analysis AS (SELECT guid, CASE WHEN value > 50 THEN 'positive' WHEN value < 5 THEN 'negative' ELSE 'neutral' END AS verdict FROM releases WHERE guid % 2 = 0),
terms AS MATERIALIZED (SELECT guid, 45 + value * 2 AS issue_price, CASE WHEN guid % 5 <> 0 THEN value * 1000 END AS offered, CAST(10000 + user_id * 100 AS DOUBLE) AS outstanding, CASE guid % 3 WHEN 0 THEN 'public_offering' WHEN 1 THEN 'private_placement' ELSE 'rights' END AS offering_type
  FROM releases WHERE category = 'financing'),
relview AS MATERIALIZED (SELECT r.*, headline, verdict, issue_price, offering_type FROM releases r LEFT JOIN parsed USING (guid) LEFT JOIN analysis USING (guid) LEFT JOIN terms USING (guid))"""
RV = "@releases, @relview"
query("j13_unparsed_backlog", "guid:i", f"WITH {RV} SELECT guid FROM releases WHERE guid NOT IN (SELECT guid FROM parsed)")(lambda t: notes.backlog(t.releases, notes.parsed_of(t.releases)))
query("k7_oldest_first_backlog", "guid:i ts:s", f"WITH {RV} SELECT guid, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts FROM releases WHERE guid NOT IN (SELECT guid FROM parsed)")(
    lambda t: notes.backlog(t.releases, notes.parsed_of(t.releases)).orderBy("ts", "guid").withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")))
query("j17_release_view", "guid:i headline verdict issue_price:f offering_type", f"WITH {RV} SELECT * FROM relview")(lambda t: notes.release_view(t.releases))
query("j31_release_events", "guid:i headline verdict", f"WITH {RV} SELECT guid, headline, verdict FROM releases JOIN parsed USING (guid) LEFT JOIN analysis USING (guid) WHERE ticker <> ''")(lambda t: notes.release_events(t.releases))
FR["fin"] = """fin AS MATERIALIZED (SELECT o.guid, o.ticker, issue_price, offered, outstanding, offering_type, pre_close, issue_price / pre_close - 1 AS discount, offered / outstanding AS dilution FROM outcomes o JOIN terms USING (guid))"""
FI = f"{OUTCOMES}, @relview, @fin"
fin = lambda t: notes.financing_metrics(studies.outcomes(t).join(notes.terms_of(t.releases), "guid"))
query("p52_financing_metrics", "guid:i discount:f dilution:f discount_bucket dilution_bucket",
      f"""WITH {FI} SELECT *, CASE WHEN discount IS NULL THEN NULL WHEN discount >= 0 THEN 'a premium (>= 0%)' WHEN discount > -0.1 THEN 'b 0 to -10%' WHEN discount > -0.25 THEN 'c -10 to -25%' ELSE 'd below -25%' END AS discount_bucket,
      CASE WHEN dilution IS NULL THEN NULL WHEN dilution < 0.05 THEN 'a < 5%' WHEN dilution < 0.15 THEN 'b 5-15%' WHEN dilution < 0.3 THEN 'c 15-30%' ELSE 'd >= 30%' END AS dilution_bucket FROM fin""")(fin)
query("j25_terms_to_releases", "guid:i entry_date:d offering_type", f"WITH {FI} SELECT o.guid, entry_date, offering_type FROM outcomes o LEFT JOIN terms USING (guid)")(
    lambda t: studies.outcomes(t).join(notes.terms_of(t.releases), "guid", "left"))
query("p53_risk_flag", "guid:i risk", f"WITH {RV} SELECT guid, CASE offering_type WHEN 'public_offering' THEN 'Public offering: a risk flag, not a signal.' END AS risk FROM terms")(
    lambda t: notes.terms_of(t.releases).withColumn("risk", notes.risk_flag("offering_type")))
query("j24_share_count_asof", "guid:i as_of:d shares_outstanding:f",
      """WITH @releases, f AS (SELECT event_type AS ticker, ts :: DATE AS filed, max(user_id) * 1000.0 AS shares FROM events GROUP BY 1, 2)
      SELECT guid, filed AS as_of, CASE WHEN ts :: DATE - filed <= 2 THEN shares END AS shares_outstanding FROM releases r ASOF LEFT JOIN f ON f.ticker = r.ticker AND r.ts :: DATE >= f.filed""")(
    lambda t: notes.shares_before(t.releases, t.events.groupBy(F.col("event_type").alias("ticker"), F.to_date("ts").alias("filed")).agg((F.max("user_id") * 1000.0).alias("shares")), 2))
query("f7_stale_by_age", "guid:i stale:b", "WITH @releases SELECT guid, coalesce(guid % 9 <> 0 AND (SELECT max(ts) FROM releases) - ts > INTERVAL 7 DAY, false) AS stale FROM releases")(lambda t: notes.stale_releases(t.releases))
query("f9_high_only_feeds", "guid:i feed materiality", "WITH @releases SELECT * FROM releases WHERE feed NOT IN ('feed1', 'feed3') OR materiality = 'high'")(
    lambda t: t.releases.where(~F.col("feed").isin("feed1", "feed3") | (F.col("materiality") == "high")))
query("f16_release_selection", "guid:i link", """WITH @releases SELECT guid, 'https://news.example/en/' || guid AS link FROM releases WHERE guid % 4 <> 0 AND (category IN ('financing', 'drilling') OR materiality = 'high')""")(
    lambda t: t.releases.withColumn("link", F.concat(F.lit("https://news.example/"), F.when(F.col("guid") % 4 != 0, "en").otherwise("fr"), F.lit("/"), F.col("guid").cast("string")))
    .where(F.col("link").rlike("/en/") & (F.col("category").isin("financing", "drilling") | (F.col("materiality") == "high"))))
FR["watch"] = """watch AS MATERIALIZED (SELECT user_id, ticker, max(ts) :: DATE AS flagged, max_by(guid, ts) AS guid, max_by(value, ts) + 1 AS flag_price, CASE max_by(guid, ts) % 3 WHEN 0 THEN 'watching' WHEN 1 THEN 'inbox' ELSE 'closed' END AS status
  FROM releases WHERE materiality = 'high' GROUP BY 1, 2),
whist AS MATERIALIZED (SELECT w.guid, w.user_id, w.ticker, d.date, d.close FROM watch w JOIN day_bars d ON d.ticker = w.ticker AND d.date >= flagged WHERE status = 'watching')"""
WA = "@releases, @hourly, @day_bars, @watch"
items = lambda t: notes.watch_items(t.releases)
whist = lambda t: notes.price_history(items(t), t.day_bars)
query("j20_items_with_history", "guid:i ticker history",
      f"WITH {WA}, l AS (SELECT * FROM whist QUALIFY row_number() OVER (PARTITION BY guid ORDER BY date DESC) <= 5) SELECT w.guid, w.ticker, h.history FROM watch w LEFT JOIN (SELECT guid, string_agg(printf('%s=%.4f', CAST(date AS VARCHAR), close), ',' ORDER BY date) AS history FROM l GROUP BY 1) h USING (guid)")(
    lambda t: notes.with_history(items(t), whist(t)).withColumn("history", F.array_join(F.transform("history", lambda x: F.format_string("%s=%.4f", x["date"].cast("string"), x["close"])), ",")))
query("a29_watch_state", "guid:i status price:f change_pct:f days:i",
      f"WITH {WA}, h AS (SELECT guid, max_by(close, date) AS c, max(date) AS d FROM whist GROUP BY 1) SELECT w.guid, status, coalesce(c, flag_price) AS price, (coalesce(c, flag_price) / flag_price - 1) * 100 AS change_pct, coalesce(d - flagged, 0) AS days FROM watch w LEFT JOIN h USING (guid)")(
    lambda t: notes.watch_state(items(t), whist(t)))
query("a30_volume_against_mean", "ticker date:d ratio:f", "WITH @bars SELECT ticker, date, volume / avg(volume) OVER[-20,-1] AS ratio FROM bars")(
    lambda t: t.bars.withColumn("ratio", F.col("volume") / F.avg("volume").over(ind.rows(-20, -1))))
query("j22_first_listed_symbol", "guid:i symbol",
      """WITH k AS (SELECT DISTINCT 'U' || user_id || CASE user_id % 3 WHEN 0 THEN '.V' WHEN 1 THEN '.CN' ELSE '' END AS symbol, user_id FROM events)
      SELECT event_id AS guid, k.symbol FROM events e JOIN k USING (user_id) WHERE e.ts :: DATE > (SELECT min(ts) :: DATE FROM events)""")(lambda t: notes.listed_requests(t.events))
query("j27_insider_evidence", "ticker accession sector:s", "WITH @form4 SELECT f.ticker, accession, 'T' || length(f.ticker) AS sector FROM form4 f WHERE code = 'P'")(
    lambda t: documents.filed_buys(raw.form4_filings(t.events)).join(
        t.events.select(F.col("event_type").alias("ticker")).distinct().withColumn("sector", F.concat(F.lit("T"), F.length("ticker").cast("string"))), "ticker"))
query("a27_coverage_counts", "category releases:i parsed:i analysed:i", f"WITH {RV} SELECT category, count(*) AS releases, count(headline) AS parsed, count(verdict) AS analysed FROM relview GROUP BY 1")(
    lambda t: notes.release_view(t.releases).groupBy("category").agg(F.count("*").alias("releases"), F.count("headline").alias("parsed"), F.count("verdict").alias("analysed")))
query("a23_survivorship", "total:i scored:i no_data:i", f"WITH {OUTCOMES} SELECT (SELECT count(*) FROM releases) AS total, count_if(complete) AS scored, (SELECT count(*) FROM releases) - count(*) AS no_data FROM outcomes")(
    lambda t: t.releases.select("guid").join(studies.outcomes(t).select("guid", "complete"), "guid", "left").agg(
        F.count("*").alias("total"), F.count_if("complete").alias("scored"), F.count_if(F.col("complete").isNull()).alias("no_data")))
query("f5_quality_predicate", "c_custkey:i", "SELECT c_custkey FROM customer WHERE c_acctbal >= 1000 AND c_nationkey > 3 AND CASE WHEN c_custkey % 10 <> 0 THEN c_acctbal END >= 1500")(
    lambda t: t.customer.withColumn("price", F.when(F.col("c_custkey") % 10 != 0, F.col("c_acctbal"))).where("c_acctbal >= 1000 and c_nationkey > 3 and price >= 1500"))

# --- demand -----------------------------------------------------------------------------------------------------

FR["venue"] = """venue AS MATERIALIZED (SELECT p_brand AS ticker, date_trunc('week', l_shipdate) :: DATE AS week, sum(l_quantity * (30 + round(l_discount * 100))) / 100 AS venue_shares FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
weekvol AS MATERIALIZED (SELECT ticker, date_trunc('week', date) :: DATE AS week, sum(volume) AS total FROM bars WHERE isodow(date) < 7 GROUP BY 1, 2)"""
query("a9_venue_volume", "ticker week:d venue_shares:f", "WITH @bars, @venue SELECT * FROM venue")(lambda t: demand.venue_volume(t.lineitem, t.part))
query("a10_weekly_volume", "ticker week:d total:f", "WITH @bars, @venue SELECT * FROM weekvol")(lambda t: demand.weekly_volume(t.bars))
FR["dark"] = """dra AS (SELECT ticker, week AS date, venue_shares / total AS ratio FROM venue JOIN weekvol USING (ticker, week) WHERE total > 0), drb AS (SELECT *, lag(ratio) OVER[] AS r1, lag(ratio, 2) OVER[] AS r2 FROM dra),
dark AS MATERIALIZED (SELECT ticker, date, 'darkpool' AS source, CASE WHEN ratio > r1 AND r1 > r2 THEN 'darkpool_ratio_rising' ELSE 'darkpool_ratio' END AS signal_type, CASE WHEN ratio > r1 AND r1 > r2 THEN 'bullish' ELSE 'neutral' END AS direction,
  least(1, greatest(0, coalesce(ratio - r1, 0) / 0.05)) AS strength, 14 AS lag_days FROM drb)"""
FR["shortsig"] = """ssa AS (SELECT symbol AS ticker, date, ratio FROM shortvol), ssb AS (SELECT *, lag(ratio) OVER[] AS r1, lag(ratio, 2) OVER[] AS r2 FROM ssa),
shortsig AS MATERIALIZED (SELECT ticker, date, 'short_volume' AS source, CASE WHEN ratio < r1 AND r1 < r2 THEN 'short_volume_covering' WHEN ratio > r1 AND r1 > r2 THEN 'short_volume_pressure' ELSE 'short_volume_ratio' END AS signal_type,
  CASE WHEN ratio < r1 AND r1 < r2 THEN 'bullish' WHEN ratio > r1 AND r1 > r2 THEN 'bearish' ELSE 'neutral' END AS direction, least(1, abs(coalesce(ratio - r1, 0)) / 0.05) AS strength, 1 AS lag_days FROM ssb)"""
FR["options"] = """options AS MATERIALIZED (SELECT p_brand AS ticker, l_shipdate :: DATE AS date, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS cv, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS pv,
  sum(CASE WHEN l_returnflag = 'R' THEN round(l_tax * 1000) ELSE 0 END) AS co, sum(CASE WHEN l_returnflag <> 'R' THEN round(l_tax * 1000) ELSE 0 END) AS po FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
optsig AS MATERIALIZED (SELECT ticker, date, 'options' AS source, 'unusual_call_volume' AS signal_type, 'bullish' AS direction, least(1, cv / co / 6) AS strength, 0 AS lag_days FROM options WHERE co > 0 AND cv / co >= 2
  UNION ALL SELECT ticker, date, 'options', 'unusual_put_volume', 'bearish', least(1, pv / po / 6), 0 FROM options WHERE po > 0 AND pv / po >= 2
  UNION ALL SELECT ticker, date, 'options', 'call_put_skew', CASE WHEN cv > pv THEN 'bullish' WHEN cv < pv THEN 'bearish' ELSE 'neutral' END, abs(cv - pv) / (cv + pv), 0 FROM options WHERE cv + pv > 0)"""
options = lambda t: demand.option_totals(demand.option_legs(t.lineitem, t.part))
query("a11_option_totals", "ticker date:d call_volume:f put_volume:f call_open_interest:f put_open_interest:f",
      "WITH @options SELECT ticker, date, cv AS call_volume, pv AS put_volume, co AS call_open_interest, po AS put_open_interest FROM options")(
    options)
SG = "ticker date:d source signal_type direction strength:f lag_days:i"
dark = lambda t: demand.darkpool_signals(demand.venue_volume(t.lineitem, t.part), demand.weekly_volume(t.bars))
shortsig = lambda t: demand.short_volume_signals(documents.short_volume(raw.short_volume_lines(t.events)))
optsig = lambda t: demand.option_signals(options(t))
query("p49_darkpool_signals", SG, "WITH @bars, @venue, @dark SELECT * FROM dark")(dark)
query("p49_short_volume_signals", SG, "WITH @shortvol, @shortsig SELECT * FROM shortsig")(shortsig)
query("p49_option_signals", SG, "WITH @options SELECT * FROM optsig")(optsig)
FR["demand"] = """insig AS (SELECT ticker, filing_date AS date, 'insider' AS source, 'insider_buy' AS signal_type, 'bullish' AS direction, 1.0 AS strength, 2 AS lag_days FROM form4 WHERE code = 'P'),
dsig AS MATERIALIZED (SELECT * FROM dark UNION ALL SELECT * FROM shortsig UNION ALL SELECT * FROM optsig UNION ALL SELECT * FROM insig),
dnew AS (SELECT * FROM dsig QUALIFY date = max(date) OVER (PARTITION BY ticker, source)),
dg AS (SELECT ticker, count(*) FILTER (signal_type = 'darkpool_ratio_rising') > 0 AS dk, monthname(max(date) FILTER (signal_type = 'darkpool_ratio_rising')) AS dkm, count(*) FILTER (signal_type = 'short_volume_covering') > 0 AS cov, count(*) FILTER (signal_type = 'short_volume_pressure') > 0 AS prs,
  count(*) FILTER (signal_type = 'unusual_call_volume') > 0 AS uc, count(*) FILTER (signal_type = 'unusual_put_volume') > 0 AS up, count(*) FILTER (signal_type = 'call_put_skew' AND direction = 'bullish') > 0 AS lc,
  count(*) FILTER (signal_type = 'call_put_skew' AND direction = 'bearish') > 0 AS lp, count(*) FILTER (signal_type = 'call_put_skew' AND direction = 'neutral') > 0 AS le FROM dnew GROUP BY 1),
dh AS (SELECT g.*, (SELECT count(*) FROM insig i WHERE i.ticker = g.ticker) AS buys FROM dg g),
di AS (SELECT *, (buys > 0) :: INT + dk :: INT + cov :: INT - prs :: INT + (uc AND NOT up) :: INT - (up AND NOT uc) :: INT + lc :: INT - lp :: INT AS score, buys > 0 OR dk OR cov OR prs OR uc OR up AS raised,
  concat_ws('; ', CASE WHEN buys > 0 THEN 'insider buys: ' || buys END, CASE WHEN dk THEN 'dark pool share rising for 3 weeks to ' || dkm END, CASE WHEN cov THEN 'shorts covering' END,
  CASE WHEN prs THEN 'shorts pressing' END, CASE WHEN uc AND up THEN 'option volume on both sides' END, CASE WHEN uc AND NOT up THEN 'call volume' END, CASE WHEN up AND NOT uc THEN 'put volume' END,
  CASE WHEN lc THEN 'calls lead' END, CASE WHEN lp THEN 'puts lead' END, CASE WHEN le THEN 'calls and puts level' END,
  CASE WHEN (lc OR lp OR le) AND NOT (buys > 0 OR dk OR cov OR prs OR uc OR up) THEN 'nothing unusual' END) AS reasons FROM dh)"""
signals = lambda t: dark(t).unionByName(shortsig(t)).unionByName(optsig(t)).unionByName(
    demand.insider_signals(documents.filed_buys(raw.form4_filings(t.events))))
DM = "@bars, @venue, @dark, @shortvol, @shortsig, @options, @form4, @demand"
query("p50_demand_composite", "ticker label score:i reasons",
      f"WITH {DM} SELECT ticker, CASE WHEN reasons = '' THEN 'no data' WHEN score > 0 THEN CASE WHEN raised THEN 'bullish' ELSE 'mild bullish' END WHEN score < 0 THEN CASE WHEN raised THEN 'bearish' ELSE 'mild bearish' END "
      "ELSE CASE WHEN raised THEN 'mixed' ELSE 'neutral' END END AS label, score, reasons FROM di")(lambda t: demand.composite(signals(t)))
query("a28_signals_per_ticker", "ticker source signals:i newest:d mean_strength:f", f"WITH {DM} SELECT ticker, source, count(*) AS signals, max(date) AS newest, avg(strength) AS mean_strength FROM dsig GROUP BY 1, 2")(
    lambda t: signals(t).groupBy("ticker", "source").agg(F.count("*").alias("signals"), F.max("date").alias("newest"), F.avg("strength").alias("mean_strength")))
query("p48_macro_regime", "composite:i label",
      """WITH @bars, @weekly, v AS (SELECT * FROM (VALUES ('Brand#1', 3, true), ('Brand#2', 2, false), ('Brand#3', 3, true)) v(s, n, up)),
      l AS (SELECT ticker, close, n, up, lead(close) OVER w AS older, row_number() OVER w AS k FROM weekly JOIN v ON ticker = s WINDOW w AS (PARTITION BY ticker ORDER BY date DESC)),
      g AS (SELECT ticker, up, bool_and(close > older) AS r, bool_and(close < older) AS f FROM l WHERE k < n AND older IS NOT NULL GROUP BY 1, 2)
      SELECT sum(CASE WHEN CASE WHEN up THEN r ELSE f END THEN 1 WHEN CASE WHEN up THEN f ELSE r END THEN -1 ELSE 0 END) AS composite,
        CASE WHEN sum(CASE WHEN CASE WHEN up THEN r ELSE f END THEN 1 WHEN CASE WHEN up THEN f ELSE r END THEN -1 ELSE 0 END) > 0 THEN 'risk_on' WHEN sum(CASE WHEN CASE WHEN up THEN r ELSE f END THEN 1 WHEN CASE WHEN up THEN f ELSE r END THEN -1 ELSE 0 END) < 0 THEN 'risk_off' ELSE 'neutral' END AS label FROM g""")(
    lambda t: demand.regime_vote(shaping.weekly_bars(t.bars).select(F.col("ticker").alias("series"), "date", F.col("close").alias("value")), {"Brand#1": (3, True), "Brand#2": (2, False), "Brand#3": (3, True)}))

# --- loading ----------------------------------------------------------------------------------------------------

query("s1_load_bars", "ticker date:d close:f", "WITH @bars SELECT * FROM bars WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND ticker IN ('Brand#1', 'Brand#12')")(
    lambda t: loading.load_bars(t.bars, ["Brand#1", "Brand#12"], "1997-01-01", "1998-12-31"))
query("s2_point_in_time_slice", "ticker as_of:d bars:i last_close:f",
      "WITH @bars, m AS (SELECT max(date) AS as_of FROM bars GROUP BY date_trunc('month', date)) SELECT ticker, as_of, count(*) AS bars, max_by(close, date) AS last_close FROM bars JOIN m ON date <= as_of GROUP BY 1, 2")(
    lambda t: loading.as_known(t.bars, shaping.month_ends(t.bars)))
query("s3_quality_slice", "ticker date:d close:f",
      "WITH @bars, r AS (SELECT * FROM bars WHERE date >= (SELECT max(date) FROM bars) - 425) SELECT * FROM r WHERE ticker IN (SELECT ticker FROM r GROUP BY 1 HAVING count(*) > 200 AND max_by(close, date) > 0)")(
    lambda t: loading.quality_slice(t.bars, 365, 200))
DIRTY = "dirty AS (SELECT ticker, date, open, CASE WHEN day(date) = 7 THEN low - 1 ELSE high END AS high, low, CASE WHEN day(date) <> 13 THEN close END AS close, CASE WHEN day(date) = 21 THEN -volume ELSE volume END AS volume FROM bars)"
query("s4_contract_check", "ticker date:d reasons",
      f"""WITH @bars, {DIRTY} SELECT * FROM (SELECT ticker, date, concat_ws(',', CASE WHEN close IS NULL THEN 'missing_close' END, CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
      CASE WHEN close > high OR close < low THEN 'close_outside_range' END) AS reasons FROM dirty) WHERE reasons <> ''""")(
    lambda t: loading.contract_check(loading.damaged(t.bars)).where("size(reasons) > 0").withColumn("reasons", F.array_join("reasons", ",")))
query("p59_isolated_scan", "ticker date:d failed:b spike_pct:f",
      f"""WITH @bars, {DIRTY}, c AS (SELECT *, close IS NULL OR high < low OR volume < 0 OR close > high OR close < low AS failed FROM dirty),
      g AS (SELECT *, lag(close) OVER[] AS p, avg(volume) OVER[-20,-1] AS av FROM c WHERE NOT failed)
      SELECT ticker, date, true AS failed, NULL AS spike_pct FROM c WHERE failed UNION ALL SELECT ticker, date, false, (volume - av) / av * 100 FROM g WHERE close > p AND volume > av AND av > 0""")(lambda t: loading.isolated_spikes(t.bars))
query("s5_load_reasons", "ticker rows:i reason",
      """WITH @bars, r AS (SELECT DISTINCT p_brand AS ticker FROM part UNION ALL SELECT 'GONE' UNION ALL SELECT 'VOID'), f AS (SELECT ticker, CASE WHEN ticker <> 'Brand#5' THEN close END AS close, CASE WHEN ticker <> 'Brand#6' THEN open END AS p FROM bars)
      SELECT r.ticker, any_value(g.n) AS rows, any_value(CASE WHEN g.n IS NULL THEN 'no_data' WHEN pr = 0 THEN 'missing_ohlcv' WHEN cl = 0 THEN 'all_nan_close' END) AS reason FROM r LEFT JOIN (SELECT ticker, count(*) AS n, count(close) AS cl, count(p) AS pr FROM f GROUP BY 1) g USING (ticker) GROUP BY 1""")(
    lambda t: loading.reasons_example(t.part, t.bars))
query("s6_range_upsert", "ticker date:d close:f",
      """WITH @bars, o AS (SELECT * FROM bars WHERE date < DATE '2000-01-01'), n AS (SELECT ticker, date, close + 1 AS close FROM bars WHERE date >= DATE '1999-06-01' AND ticker < 'Brand#2'),
      s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM n GROUP BY 1) SELECT o.ticker, o.date, o.close FROM o LEFT JOIN s USING (ticker) WHERE a IS NULL OR date < a OR date > b UNION ALL SELECT * FROM n""")(
    lambda t: loading.upsert_ranges(t.bars.where("date < date'2000-01-01'").select("ticker", "date", "close"),
                                    t.bars.where("date >= date'1999-06-01' and ticker < 'Brand#2'").select("ticker", "date", (F.col("close") + 1).alias("close"))))
PLAN = """rq AS (SELECT DISTINCT p_brand AS ticker, DATE '1995-06-01' AS start, DATE '2001-06-30' AS "end", DATE '2001-06-29' AS newest FROM part), ca AS (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars WHERE (ticker < 'Brand#2' OR date >= DATE '1996-01-01') AND ticker <> 'Brand#7'
  AND (ticker > 'Brand#22' OR date < DATE '2001-01-01') GROUP BY 1), pl AS (SELECT rq.ticker, CASE WHEN lo IS NULL OR lo - start > 5 THEN start ELSE greatest(start, hi - 5) END AS fetch_from, "end" + 1 AS fetch_before FROM rq LEFT JOIN ca USING (ticker)
  WHERE lo IS NULL OR lo - start > 5 OR hi < newest)"""
query("s7_fetch_plan", "ticker fetch_from:d fetch_before:d", f"WITH @bars, {PLAN} SELECT * FROM pl")(lambda t: loading.plan_example(t.part, t.bars))
query("s7_fetch_groups", "fetch_from:d fetch_before:d tickers:i first_ticker", f"WITH @bars, {PLAN} SELECT fetch_from, fetch_before, count(*) AS tickers, min(ticker) AS first_ticker FROM pl GROUP BY 1, 2")(
    lambda t: loading.fetch_groups(loading.plan_example(t.part, t.bars)))
query("s8_dated_screener_rows", "date:d ticker", "WITH @bars SELECT DISTINCT date, upper(ticker) AS ticker FROM bars WHERE volume >= 60")(lambda t: loading.screener_rows(loading.screener_example(t.bars)))
query("s9_ticker_list", "ticker", "SELECT DISTINCT upper(p_name) AS ticker FROM part WHERE p_partkey % 5 > 2")(lambda t: loading.ticker_list(loading.list_example(t.part)))
query("s12_s13_replace_pending", "intent_id:i intent_status", "WITH @bars, @trades, @intents SELECT intent_id, intent_status FROM intents WHERE intent_status <> 'PENDING' UNION ALL SELECT intent_id + 1000000, 'PENDING' FROM intents WHERE intent_status = 'EXECUTED' AND intent_id % 10 = 0")(
    lambda t: loading.replace_pending(t.intents.select("intent_id", "intent_status"), t.intents.where("intent_status = 'EXECUTED' and intent_id % 10 = 0").select(
        (F.col("intent_id") + 1000000).alias("intent_id"), F.lit("PENDING").alias("intent_status"))))
query("s14_insert_or_ignore", "user_id:i event_id:i value:f",
      """WITH o AS (SELECT user_id, min(event_id) AS event_id, min_by(value, event_id) AS value FROM events WHERE event_id < 50 GROUP BY 1) SELECT * FROM o UNION ALL
      SELECT user_id, min(event_id), min_by(value, event_id) FROM events WHERE event_id >= 50 AND user_id NOT IN (SELECT user_id FROM o) GROUP BY 1""")(lambda t: loading.ignore_example(t.events))
query("s15_insert_or_replace", "user_id:i event_type event_id:i value:f", "SELECT user_id, event_type, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY 1, 2")(
    lambda t: loading.upsert_latest(t.events.where("event_id < 5000").select("user_id", "event_type", "event_id", "value"), t.events.where("event_id >= 5000").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id"))
query("s17_latest_snapshot", "ticker run_date:d close:f", "WITH @bars SELECT ticker, date AS run_date, close FROM bars WHERE date = (SELECT max(date) FROM bars)")(
    lambda t: loading.latest_snapshot(t.bars.withColumnRenamed("date", "run_date")))
query("s20_incremental_documents", "doc_id:i", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0 OR doc_id % 6 = 0")(
    lambda t: loading.new_documents(t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path")),
                                    t.documents.where("doc_id % 3 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), (F.col("doc_id") % 6).alias("items"))))
query("s21_earnings_dates", "ticker report_date:d", "WITH @bars, @dividends, @earnings SELECT DISTINCT ticker, report_date FROM earnings")(
    lambda t: loading.earnings_dates(t.earnings.select(F.concat("ticker", F.lit(","), F.col("report_date").cast("string"), F.lit("T16:05:00")).alias("value")).unionByName(
        t.earnings.select(F.concat("ticker", F.lit(",unknown")).alias("value")))))
query("s22_newest_required", "trade_id:i newest:d exclusive_end:d",
      "WITH @bars, @trades, s AS (SELECT DISTINCT date FROM bars) SELECT trade_id, s.date AS newest, exit_date + 1 AS exclusive_end FROM trades t ASOF LEFT JOIN s ON least(t.exit_date, DATE '2000-06-30') >= s.date")(
    lambda t: loading.newest_required(t.trades.select("trade_id", F.col("exit_date").alias("end"), F.lit("2000-06-30").cast("date").alias("today")), t.bars.select("date").distinct()))
query("u3_common_dates", "date:d", "WITH @bars SELECT date FROM bars WHERE ticker = 'Brand#1' INTERSECT SELECT date FROM bars WHERE ticker = 'Brand#2'")(
    lambda t: t.bars.where("ticker = 'Brand#1'").select("date").intersect(t.bars.where("ticker = 'Brand#2'").select("date")))
