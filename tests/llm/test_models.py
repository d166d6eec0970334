from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import language, quality, toxicity, urls

SF = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_gradients_of_the_network():
    draw = np.random.default_rng(0)
    net = language.Network(["a", "b", "c"], hidden=3)
    for r in (net.ahead, net.backward):
        for name in ("gate_in", "cand_in", "gate_rec", "cand_rec", "cand_bias"):
            setattr(r, name, getattr(r, name).astype(np.float64))
    net.out, net.bias = net.out.astype(np.float64), net.bias.astype(np.float64)
    windows, labels = draw.integers(97, 105, (5, 6)).astype(np.uint8), np.array([0, 1, 2, 1, 0])

    def loss():
        p, _ = net.probabilities(np.ascontiguousarray(windows.T))
        return -np.log(p[:, np.arange(5), labels]).mean()

    for a, g in zip(net.parameters(), net.gradients(windows, labels)):
        for spot in [np.unravel_index(k, a.shape) for k in draw.integers(0, a.size, 4)] + ([(98, 1)] if a.shape[0] == 256 else []):
            old, step = a[spot], 1e-2
            a[spot] = old + step
            up = loss()
            a[spot] = old - step
            down = loss()
            a[spot] = old
            assert g[spot] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-4)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r["doc_id"]: r for r in language.language_id(docs, per_language=120).collect()}
    want = [(r["doc_id"], r["lang"]) for r in docs.select("doc_id", "lang").collect() if is_held_out(r["doc_id"])]
    assert len(got) == docs.count()
    assert all(got[i]["held_out"] for i, _ in want)
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in want]) > 0.95


def test_languages_of_odd_rows(odd_docs, no_docs):
    windows = np.tile(language.windows_of(b"the cat and the dog went to town" * 2), (2, 1))
    net = language.train(windows, np.array([0] * (len(windows) // 2) + [1] * (len(windows) - len(windows) // 2)), ["en", "de"], steps=2, batch=4)
    rows = language.predict(odd_docs, net).collect()
    assert len(rows) == odd_docs.count()
    none = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert none == {2, 3, 4, 9} and all(r["score"] == 0 for r in rows if r["doc_id"] in none)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert language.language_id(no_docs).count() == 0
    assert language.fit(odd_docs.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {r["lang_pred"] for r in language.predict(odd_docs, None).collect()} == {"und"}


def test_toxicity_of_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    words = ["idiot", "scum", "moron"]
    marked = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" " + " ".join(words)))).otherwise(F.regexp_replace("text", "|".join(words), "x")).alias("text"))
    truth = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    rows = toxicity.toxicity(marked, truth).collect()
    right = [r["predicted"] == int(r["doc_id"] % 3 == 0) for r in rows if r["held_out"]]
    assert len(rows) == docs.count() and np.mean(right) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == is_held_out(r["doc_id"]) for r in rows)
    assert labels.count()


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 1), (5, 1, 0), (None, 1, 1), (8, None, None), (1, 0, 1)], "doc_id long, toxic int, text int")
    rows = toxicity.toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert toxicity.toxicity(no_docs, labels).count() == 0
    nobody = toxicity.toxicity(odd_docs, labels.limit(0)).collect()
    assert len({r["score"] for r in nobody}) == 1


def test_ftrl_leaves_weak_slots_at_zero():
    draw = np.random.default_rng(2)
    examples = [(np.unique(np.r_[draw.integers(100, 1000, 20), [5] if y else []]).astype(np.uint32), int(y)) for y in draw.random(400) < 0.3]
    used, weights, _ = toxicity.fit(examples, bits=10)
    assert 5 in used and weights[used == 5][0] == weights.max() and len(used) < 400


def repeated_by_hand(words):
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    return len({i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)})


def test_repeated_words():
    draw = np.random.default_rng(3)
    for n in (0, 3, 5, 6, 40, 300):
        for kinds in (1, 2, 3, 50):
            words = [b"w%d" % k for k in draw.integers(0, kinds, n)]
            assert quality.repeated_words(words) == repeated_by_hand(words)


def test_lines_and_verdicts():
    assert quality.failed_rule(b"home | about | contact", 5) == "navigation"
    assert quality.failed_rule(b"All rights reserved.", 3) == "boilerplate"
    assert quality.failed_rule(b"no end of a sentence here", 5) == "punctuation"
    assert quality.failed_rule(b"a!! b!! c!!", 3) == "punctuation"
    assert quality.failed_rule("Sie sagte: „Ja.“ Dann ging sie.".encode(), 6) is None
    good = "This is a sentence of some words. Here is another one of them."
    lost = quality.judge_text(good + "\nhome | about | contact | more | items | in | this | long | list | of | nothing | useful | at | all | really")
    assert lost[6] is False and lost[7] == 1 and lost[8] == good
    assert quality.judge_text(good + "\nAll rights reserved.")[6] is True


def test_quality_of_odd_rows(odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in quality.quality_rules(odd_docs, with_text=True).collect()}
    assert rows[2]["n_words"] == rows[3]["n_words"] == rows[4]["n_words"] == 0 and not rows[2]["kept"] and rows[2]["base_failed"]
    assert rows[10]["word_chars"] == 300_000 and rows[1]["kept"]
    assert quality.quality_rules(odd_docs).count() == odd_docs.count()
    assert quality.quality_rules(no_docs).count() == 0
    kept = quality.only_kept(odd_docs)
    assert kept.columns == odd_docs.columns and quality.only_kept(no_docs).count() == 0


URLS = [
    (1, "http://A.Example.NET/en/5?x=1", "a.example.net", "/en/5", "example.net/en/", "allow"),
    (2, "https://www.other.net/de/", "www.other.net", "/de/", "net/", "block"),
    (3, "https://example.com/de/1#top", "example.com", "/de/1", "example.com/de/", "block"),
    (4, "x://b.org/fr/", "b.org", "/fr/", "org/fr/", "allow"),
    (5, "https://planet", "planet", "", None, None),
    (6, "https://some.net", "some.net", "", None, None),
    (7, "https://some.net?q=/en/", "some.net", "", None, None),
    (8, "no scheme", "", "", None, "allow"),
    (9, None, "", "", None, "allow"),
    (10, "", "", "", None, "allow"),
    (11, "a://b://c/d", "b:", "//c/d", None, None),
    (12, "https://notexample.com/de/1", "notexample.com", "/de/1", None, None),
    (13, "http://İ.NET/\n?", "İ.net", "/\n", "net/", "block"),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u, *_ in URLS] + [(14, "https://free-casino-bets.shop.example/en/", "c", "c"), (15, "https://blog.library.example/en/1", "c", "c"), (15, "https://blog.library.example/en/1", "c", "c")], "page_id long, url string, host string, score string")
    found = urls.url_filters(pages, urls.labelled_urls(spark))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    rows = {r["page_id"]: r for r in found.collect()}
    for i, _, host, path, rule, verdict in URLS:
        r = rows[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), r
        assert verdict is None or r["verdict"] == verdict
    assert rows[14]["verdict"] == "block" and rows[15]["verdict"] == "allow" and found.count() == len(URLS) + 3
    assert urls.url_filters(pages.limit(0), urls.labelled_urls(spark)).count() == 0
