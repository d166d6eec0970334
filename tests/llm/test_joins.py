from __future__ import annotations

import hashlib
import os
import random
import re

import numpy as np
import pytest

from tapeloom.llm import ngram_join, suffix_dedup, topk
from tapeloom.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def classes_by_hand(rows, width, similar):
    sets = {i: shingle_set(t, width) for i, t in rows}
    parent = {i: i for i in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= similar * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {i: (len(sets[i]), top(i)) for i in sets}


def families(seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices("abcdefg", k=draw.randint(1, 4)))
    passage = [word() for _ in range(30)]
    rows = []
    for _ in range(25):
        base = [word() for _ in range(draw.choice((2, 3, 6, 20, 60, 200)))]
        if draw.random() < 0.5:
            base += passage
        for _ in range(draw.choice((1, 1, 2, 8))):
            text = [w if draw.random() > 0.012 else word() for w in base]
            rows.append(" ".join(text).upper() if draw.random() < 0.1 else " ".join(text))
    draw.shuffle(rows)
    return list(enumerate(rows))


def test_an_id_with_several_texts_has_the_links_of_all(spark):
    """Ids that repeat with other texts: all rows are compared by hand, and an id is one document."""
    other, shared = (" ".join(f"{name}{k}" for k in range(200)) for name in "at")
    near = shared.rsplit(" ", 1)[0]
    rows = [(5, other), (5, shared), (7, shared), (8, shared), (9, near), (9, None), (3, "a b"), (3, "x y z"), (6, "X y z")]
    rows += [(100 + i % 40, text) for i, text in families(9)]
    by_row = classes_by_hand(list(enumerate(t for _, t in rows)), 4, 85)
    label = {i: i for i, _ in rows}
    links = [(rows[r][0], rows[top][0]) for r, (_, top) in by_row.items()]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 4, 85).collect()
    assert len(got) == len(rows) and label[9] == label[8] == 5 and label[6] == 3
    for r in got:
        assert r["component_id"] == (label[r["doc_id"]] if r["n_shingles"] else r["doc_id"])


@pytest.mark.parametrize(("seed", "width", "similar"), [(1, 4, 85), (2, 5, 80), (3, 2, 70)])
def test_join_against_all_pairs(spark, seed, width, similar):
    rows = families(seed)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, similar).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_hand(rows, width, similar)


def test_join_with_small_groups(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "GROUP_SIZE", 3)
    monkeypatch.setattr(ngram_join, "QUERY_CHUNK", 4)
    rows = families(4)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == classes_by_hand(rows, 4, 85)


def test_join_of_odd_rows(odd_docs, no_docs):
    rows = ngram_join.ngram_jaccard_join(odd_docs, 4, 85).collect()
    got = {(r["doc_id"], r["n_shingles"] > 0): r["component_id"] for r in rows}
    assert len(rows) == odd_docs.count()
    assert got[(2, False)] == 2 and got[(3, False)] == 3 and got[(4, False)] == 4
    assert got[(6, True)] == 5 and got[(7, True)] == 7 and got[(None, True)] is None
    assert ngram_join.ngram_jaccard_join(no_docs).count() == 0


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 100), (7, 7), (60, 61), (61, 60)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 50, 50: 50, 60: 60, 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_hand(rows, length):
    """By (id, text): bytes, removed, spans and digest; equal rows are one document."""
    seen, out = set(), {}
    for key in sorted(set(rows)):
        raw = key[1].encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for p in range(len(raw)) if gone[p] and (p == 0 or not gone[p - 1]))
        out[key[0]] = (len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest())
    return out


def passages(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choices("abcdé \n", k=n))
    shared = [text(n) for n in (99, 100, 101, 130, 260, 500)]
    rows = ["a" * 350, "ab" * 200, "a" * 240, "\0" * 150, "x" * 99, "x" * 100, "x" * 100]
    for _ in range(40):
        parts = [text(draw.randint(0, 150)) if draw.random() < 0.6 else draw.choice(shared)[draw.randint(0, 40) :] for _ in range(5)]
        rows.append("".join(parts))
    rows += draw.choices(rows, k=6)
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "frequent"), [(1, 5000), (2, 2), (3, 8)])
def test_suffixes_against_all_windows(spark, monkeypatch, seed, frequent):
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    rows = passages(seed)
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == removed_by_hand(rows, 100)


def test_suffixes_of_odd_rows(odd_docs, no_docs):
    rows = suffix_dedup.suffix_dedup(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_bytes"] == 0 and by[2]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[10]["n_removed"] == 299_999 and by[10]["n_spans"] == 1  # all but the first byte
    assert by[6]["n_removed"] >= by[5]["n_bytes"] and by[7]["n_removed"] == 0
    assert suffix_dedup.suffix_dedup(no_docs).count() == 0
    kept = suffix_dedup.without_repeats(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_texts_without_an_id_keep_places_of_their_own(spark):
    draw = random.Random(8)
    text = lambda n: "".join(draw.choices("abcdefgh ", k=n))
    shared = text(300)
    rows = [(i, text(20 * k + 7) + shared + text(50)) for k, i in enumerate([None] * 12 + [7] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    documents = suffix_dedup._documents(docs, "doc_id", "text")
    places = suffix_dedup._repeated(documents, 100).collect()
    assert len(places) == len(rows) and max(len(r["places"]) for r in places) < 20
    removed = [r["n_removed"] for r in suffix_dedup.suffix_dedup(docs).collect()]
    assert sorted(removed)[0] < 100 and all(n >= 300 for n in sorted(removed)[1:])


def test_loser_tree_and_front_coding():
    draw = random.Random(5)
    runs = []
    for n in (0, 1, 7, 30, 12):
        keys = sorted(bytes(draw.choices(b"ab", k=12)) for _ in range(n))
        arr = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 12)
        s = suffix_dedup.Suffixes(arr, np.zeros((7, n), np.int64))
        back, shared, _ = suffix_dedup.front_decoded(*suffix_dedup.front_coded(s), 12) if n else ([], [], None)
        assert back == keys
        runs.append((back, shared))
    order, prefixes = suffix_dedup.merged(runs, 12)
    keys = [runs[r][0][k] for r, k in order]
    assert keys == sorted(k for r in runs for k in r[0])
    assert prefixes == [0, *(len(os.path.commonprefix(p)) for p in zip(keys[1:], keys))]


def top_by_hand(rows, k, every):
    """Every row counts, also those that repeat an id."""
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    held = lambda s: max(min(s, 2**63 - 1), -(2**63))
    out = set()
    for q in {i for i, _ in ok if i % every == 0}:
        scored = sorted((-held(sum(x * y for x, y in zip(a, b))), i) for p, a in ok if p == q for i, b in ok if i != q and len(b) == len(a))[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def test_top_k_keeps_large_vectors_and_repeated_ids(spark, monkeypatch):
    rows = [(0, [1.0, 2.0]), (1, [300000.0, 1.0]), (2, [1.0, 1.0]), (2, [3.0, 3.0])]
    vectors = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(vectors(rows)).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 1024 * 300002), (0, 2, 2, 1024 * 1024 * 9), (0, 3, 2, 1024 * 1024 * 3)]
    monkeypatch.setattr(topk, "ROW_BLOCK", 4)
    draw = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in draw.normal(0, s, 3)]) for i in draw.integers(0, 40, 120) for s in (draw.choice([0.5, 0.5, 1e5, 1e9, 1e16]),)]
    rows += [(100 * (i % 3), [0.25, 0.5, -0.125]) for i in range(30)] + [(7, [1e300, -1e300, 1.0]), (200, [1e300, 1.0, 1.0])]
    got = {tuple(r) for r in topk.top_k(vectors(rows), 5, 10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == top_by_hand(rows, 5, 10)


def test_top_k_against_all_products(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 64)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    draw = np.random.default_rng(6)
    rows = [(i, [float(x) for x in np.float32(draw.normal(0, 0.2, 7))]) for i in range(400)]
    rows += [(1000 + i, [0.5] * 7) for i in range(30)] + [(i, [1.0, 2.0]) for i in (2000, 2001, 2003)]
    rows += [(500, None), (501, []), (510, [1.0] * 6 + [float("nan")]), (511, [float("inf")] * 7), (None, [9.0] * 7), (520, [None] * 7), (530, [0.1] * 7), (530, [0.0] * 7)]
    vectors = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, rank int, score int")
    got = {tuple(r) for r in topk.top_k(vectors, 10, 10).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == top_by_hand([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], 10, 10)
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_top_k_broadcasts_nothing_however_small_its_queries_look(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(topk, "ROW_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "PART_QUERIES", 2)
    monkeypatch.setattr(topk, "FEW_PARTS", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        rows = [(i, [float(i % 7), float(i % 5)]) for i in range(200)]
        spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/vectors")
        best = topk.top_k(spark.read.parquet(f"{tmp_path}/vectors"), 3, 10)
        assert len(best.collect()) == 60
        assert "Broadcast" not in best._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
