"""The article query against its SQL twin on headings that are cut inside an entity."""

import duckdb

from tapeloom.operators import documents
from tapeloom.plans import catalogue

PAGES = [
    (1, "<article><h1>Bread &amp; butter &amp</h1><p>Bread &amp; butter &amp; jam</p></article>"),
    (2, "<article><h1>a &lt</h1><p>b &gt;&quot</p><p>it&#39;s &copy 1 &middot; 2 &am</p></article>"),
]


def test_entities_without_semicolon(spark):
    got = {r["page_id"]: r["body"] for r in documents.article_text(spark.createDataFrame(PAGES, "page_id long, html string")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", PAGES)
    assert got == dict(con.execute(catalogue()["n1_article_text"].oracle()).fetchall())
    assert got[1] == "Bread & butter &\nBread & butter & jam"
