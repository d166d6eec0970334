from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest

from tapeloom.llm import prefix_trie
from tapeloom.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn int, role string, text string, n_convs string, depth string"


def by_hand(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(r)] for c, r in own.items()}
    seq = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    members = {}
    for c, s in seq.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for s in members:
        if s:
            children.setdefault(s[:-1], []).append(s)
    out = []
    for s, m in members.items():
        below = [x for x in members if x[: len(s)] == s]
        ids = ",".join(map(str, sorted(c for c in m if seq[c] == s)))
        out.append((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(children.get(s, [])), sum(x not in children for x in below),
                    sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x), hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def by_spark(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "no", "no") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, prefix_trie.prefix_trie(prefix_trie.grafted(prefix_trie.turn_sequences(df))).collect()), key=str)


def talk(seed, n=80):
    """Conversations of few kinds of turns, with copies, prefixes of each other, gaps in ids, and nulls."""
    draw = random.Random(seed)
    kinds = [("user", "a"), ("assistant", "bb"), ("user", "ü"), (None, "c"), ("assistant", None), ("", "")]
    known, rows = [], []
    for c in range(n):
        if draw.random() < 0.1:
            continue
        turns = [draw.choice(kinds) for _ in range(draw.choice((1, 2, 3, 9, 14)))]
        if known and draw.random() < 0.6:
            turns = draw.choice(known)[: draw.randint(1, 20)] + turns[: draw.randint(0, 2)]
        known.append(turns)
        rows += [(c, None if k == 0 and draw.random() < 0.2 else k, *t) for k, t in enumerate(turns)]
    draw.shuffle(rows)
    return rows


def test_two_fattest():
    for a in range(40):
        for b in range(a + 1, 41):
            assert prefix_trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda x: x & -x)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_against_all_prefixes(spark, monkeypatch, seed):
    monkeypatch.setattr(prefix_trie, "TRIE_TURNS", 40 * seed)
    rows = talk(seed)
    assert by_spark(spark, rows) == by_hand(rows)


def test_exit_nodes_against_a_walk():
    """Every located node is the deepest one on the sequence's path, or the one whose edge it leaves."""
    draw = random.Random(4)
    trie, seen = prefix_trie.ZFastTrie(), []
    for k in range(300):
        turns = [bytes([draw.randrange(2)]) for _ in range(draw.randint(0, 40))]
        if seen and draw.random() < 0.7:
            turns = draw.choice(seen)[: draw.randint(0, 40)] + turns[: draw.randint(0, 3)]
        seen.append(turns)
        keys = prefix_trie.prefix_keys(turns)
        node = trie.root
        while node.extent < len(keys) - 1 and keys[node.extent + 1] in node.children:
            node = node.children[keys[node.extent + 1]]
            if not (node.extent < len(keys) and keys[node.extent] == node.path[node.extent]):
                break
        assert trie.exit_node(keys) is node
        trie.insert(keys, [0, *map(len, turns)], (k, 1))
    assert len(trie.handles) == len(trie.bottom_up()) - 1


def test_odd_tables(spark):
    assert by_spark(spark, []) == []
    assert by_spark(spark, [(None, 1, "user", "x")]) == []
    same = [(5, 1, "user", "x")] * 3 + [(6, None, None, None), (6, None, None, "y"), (7, 2, "user", "z" * 200_000)]
    assert by_spark(spark, same) == by_hand([*same])
    long = [(c, k, "user", str(k if k < 2900 else k * c)) for c in (10, 11, 12) for k in range(3000)]
    got = by_spark(spark, long)
    assert len(got) == 2900 + 1 + 300 and max(r[1] for r in got) == 3000
    copies = [(5 * c, k, "user", f"t{k}") for c in range(3000) for k in range(2)]
    assert [r[3] for r in by_spark(spark, copies)] == [3000] * 3


def test_query_against_its_twin(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = con.execute(SQL["op11_conversation_prefix_trie"]).fetchall()
    got = QUERIES["op11_conversation_prefix_trie"](spark, path)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
