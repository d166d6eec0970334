"""Company facts: the chosen values, and one parse that is spread over tasks."""

import datetime
import json

from tapeloom.operators import documents


def test_fundamentals_parse_once_and_spread(spark):
    old, new = "1999-12-31", "2000-03-31"
    tag = lambda *entries: {"units": {"USD": [{"val": v, "end": e} for v, e in entries]}}
    rows = [
        (1, {"Assets": tag((90.0, old), (100.0, new)), "StockholdersEquity": tag((60.0, new))}),
        (2, {"Assets": tag((100.0, new)), "StockholdersEquity": tag((60.0, new)), "LiabilitiesAndStockholdersEquity": tag((100.0, new))}),
        (3, {"Assets": tag((100.0, new)), "StockholdersEquity": tag((60.0, new)), "Liabilities": tag((41.0, new))}),
        (4, {"Assets": tag((100.0, new)), "StockholdersEquity": tag((60.0, old)), "Liabilities": tag((7.0, "1998-12-31"))}),
        (5, {"Assets": tag((80.0, old))}), (5, {"StockholdersEquity": tag((50.0, old))}),
    ]
    facts = spark.createDataFrame([(k, json.dumps(j)) for k, j in rows], "cik long, json string").coalesce(1)
    got = documents.fundamentals(facts)
    plan = got._jdf.queryExecution().executedPlan().toString()
    steps = [line for line in plan.splitlines() if "Exchange" in line or "Generate" in line and "from_json" in line]
    assert ["Exchange" in s for s in steps] == [False, True], steps
    day = datetime.date(2000, 3, 31)
    kept = {(r["cik"], r["metric"]): (r["tag"], r["val"]) for r in got.collect()}
    assert kept == {
        (1, "assets"): ("Assets", 100.0), (1, "equity"): ("StockholdersEquity", 60.0), (1, "liabilities"): ("DERIVED(assets-equity)", 40.0),
        (2, "assets"): ("Assets", 100.0), (2, "equity"): ("StockholdersEquity", 60.0), (2, "liabilities"): ("DERIVED(assets-equity)", 40.0),
        (3, "assets"): ("Assets", 100.0), (3, "equity"): ("StockholdersEquity", 60.0), (3, "liabilities"): ("Liabilities", 41.0),
        (4, "assets"): ("Assets", 100.0), (4, "equity"): ("StockholdersEquity", 60.0),
        (5, "assets"): ("Assets", 80.0), (5, "equity"): ("StockholdersEquity", 50.0), (5, "liabilities"): ("DERIVED(assets-equity)", 30.0),
    }
    assert got.where("cik = 1 and metric = 'liabilities'").first()["end"] == day
