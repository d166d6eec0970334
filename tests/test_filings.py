"""Open-market purchases: filings that can't hold one are not parsed, and no purchase is lost."""

from tapeloom.operators import documents
from tapeloom.plans import catalogue

CODES = ["<code>P</code>", "<code>S</code>", "<code> P\n</code>", '<code at="1">P</code>', '<code at="a>b">P</code>', "<code><![CDATA[P]]></code>", "<code>&#80;</code>",
         "<code><!-- kept -->P</code>", "<code>A</code>", "<code/>", "<code></code>", "<Code>P</Code>", "<code>PX</code>"]


def test_no_purchase_is_lost(spark):
    lot = "<transaction>%s<shares>2</shares><price>3</price><date>2024-01-02</date></transaction>"
    xml = "<ownershipDocument><reportingOwner><name>N</name></reportingOwner><transactions>%s</transactions></ownershipDocument>"
    texts = [xml % (lot % c + lot % "<code>A</code>") for c in CODES] + [xml % (lot % "<code>S</code>" + lot % "<code>P</code>"), None, "", "no xml <code>P</code>"]
    filings = spark.createDataFrame([(str(i), "A", None, x) for i, x in enumerate(texts)], "accession string, ticker string, filing_date date, xml string")
    key = lambda r: r["accession"]
    want = sorted(documents.open_market_buys(documents.form4_transactions(filings)).collect(), key=key)
    assert sorted(documents.filed_buys(filings).collect(), key=key) == want and len(want) >= 5


def test_filings_are_searched_before_they_are_parsed(spark):
    for name in ("p50_demand_composite", "p55_insider_buys", "a22_insider_clusters", "a22_insider_lots", "j27_insider_evidence", "f12_materiality_floor"):
        plan = catalogue()[name].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RLIKE" in plan, name
