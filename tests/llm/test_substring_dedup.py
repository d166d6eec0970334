from __future__ import annotations

import random
import re

import pytest

from tapeloom.llm import substring_dedup
from tapeloom.llm.queries import QUERIES

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LAST = 1 << 63


def by_hand(rows, window):
    """Sorted (id, words, removed, kept) by comparing all windows."""
    split = [(i, LAST if i is None else i, WORD.findall((t or "").encode())) for i, t in rows]
    least = {}
    for _, did, words in split:
        for k in range(len(words) - window + 1):
            run = tuple(words[k : k + window])
            least[run] = min(least.get(run, did), did)
    out = []
    for i, did, words in split:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < did:
                gone.update(range(k, k + window))
        out.append((str(i), len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    return sorted(out)


def by_spark(spark, rows, **settings):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.kept_words(docs, **settings).collect())


def shared_text(seed, n=60):
    """Texts of a few words with copies, passages shared in unlike surroundings, periodic texts, repeated and missing ids."""
    draw = random.Random(seed)
    word = lambda: draw.choice("abcdefgh") + draw.choice(["", "x", "ü"])
    passages = [[word() for _ in range(draw.randint(8, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(passages) if draw.random() < 0.6 else [word() for _ in range(draw.randint(1, 20))]
        if draw.random() < 0.1:
            words = [word()] * draw.randint(1, 60)
        text = "".join(w + draw.choice([" ", "\n", "\t ", "  "]) for w in words)
        rows += [(None if draw.random() < 0.05 else draw.randrange(n) if draw.random() < 0.1 else i, text)] * draw.choice((1, 1, 1, 2))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "window", "gram", "together"), [(1, 13, 6, 256), (2, 13, 6, 4), (3, 7, 3, 2), (4, 13, 13, 8), (5, 5, 1, 3)])
def test_against_all_windows(spark, monkeypatch, seed, window, gram, together):
    """Also with anchors dealt over many parts and blocks of a few places."""
    monkeypatch.setattr(substring_dedup, "TOGETHER", together)
    monkeypatch.setattr(substring_dedup, "BLOCK_PLACES", 50)
    rows = shared_text(seed)
    assert by_spark(spark, rows, window=window, gram=gram) == by_hand(rows, window)


def test_a_window_shared_between_parts_only(spark, monkeypatch):
    """The reference of a frequent anchor does not hold the window that others share."""
    monkeypatch.setattr(substring_dedup, "TOGETHER", 2)
    draw = random.Random(9)
    phrase = [f"p{k}" for k in range(8)]
    tails = [[f"t{j}w{k}" for k in range(12)] for j in range(5)]
    rows = [(i, " ".join([f"u{i}v{k}" for k in range(12)] + phrase + (tails[draw.randrange(5)] if i else [f"z{k}" for k in range(12)]))) for i in range(60)]
    got = by_spark(spark, rows)
    assert got == by_hand(rows, 13)
    assert sum(r[2] > 0 for r in got) == 54  # all but the reference and the first of each tail


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in substring_dedup.kept_words(odd_docs).collect())
    assert got == by_hand(rows, 13)
    assert substring_dedup.kept_words(no_docs).count() == 0


def test_long_and_periodic_texts(spark):
    rows = [(1, "x " * 400_000), (2, "x" * 5_000_000), (3, "y " + "x " * 100_000 + "z"), (4, "x" * 5_000_000 + " x" * 20)]
    got = {r[0]: r[1:3] for r in by_spark(spark, rows)}
    assert got == {"1": (400_000, 0), "2": (1, 0), "3": (100_002, 100_000), "4": (21, 20)}


def test_query_against_its_twin(spark):
    import duckdb

    from tapeloom.llm.queries import SQL

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    want = sorted(con.execute(SQL["op13_substring_dedup"]).fetchall())
    got = QUERIES["op13_substring_dedup"](spark, path)
    assert sorted(map(tuple, got.collect())) == want
