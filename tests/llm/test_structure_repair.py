from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import duckdb
import pytest

from tapeloom.llm import structure_repair
from tapeloom.llm.queries import QUERIES, SQL

SCHEMA = "conv_id long, turn int, role string, text string, cost string, audit string"
INK = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    by = {}
    for c, turn, role, text in rows:
        kept = by.setdefault(c, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return {c: sorted(r) for c, r in by.items()}


def cheapest(rows):
    """Cost, initials and lines of the least edits, over all of them."""

    @lru_cache(maxsize=None)
    def best(i, state, made):
        out = []
        if i == len(rows) and state in ("", "a"):
            out.append((0, "", ()))
        name = "assistant" if state == "u" else "user"
        if made < 3:
            cost, audit, lines = best(i, name[0], made + 1)
            out.append((cost + 2, "I" + audit, (f"{name}:", *lines)))
        if i < len(rows):
            role, text, must, late = rows[i]
            cost, audit, lines = best(i + 1, state, 0)
            out.append((cost + 3, "D" + audit, lines))
            if not must:
                cost, audit, lines = best(i + 1, name[0], 0)
                out.append((cost + 2 + late, "R" + audit, (f"{name}:{text}", *lines)))
                if (role[:1], state) in (("s", ""), ("u", ""), ("u", "s"), ("u", "a"), ("a", "u")):
                    cost, audit, lines = best(i + 1, role[0], 0)
                    out.append((cost + late, "K" + audit, (f"{role}:{text}", *lines)))
        return min(out) if out else (10**9, "", ())

    return best(0, "", 0)


def by_hand(rows):
    out = []
    for c, turns in damage(rows).items():
        seen, judged, counts, pairs = set(), [], {"blank": 0, "again": 0, "cut": 0}, 0
        known = [t[1] for t in turns if t[0]]
        for k, (_, _, role, text) in enumerate(turns):
            blank, again = not INK.search(text), (role, text) in seen
            cut = not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text)
            seen.add((role, text))
            counts["blank" if blank else "again" if again else "cut" if cut else "fine"] = counts.get("blank" if blank else "again" if again else "cut" if cut else "fine", 0) + 1
            judged.append((role, text, blank or again, int(cut)))
            pairs += k > 0 and turns[k - 1][2][:1] + role[:1] not in ("su", "ua", "au")
        cost, audit, lines = cheapest(tuple(judged))
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out.append((c, gaps, counts["blank"], counts["again"], counts["cut"], pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def by_spark(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "no", "no") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, structure_repair.structure_repair(structure_repair.damaged(df)).collect()), key=str)


def talk(seed, n, longest):
    draw = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ux", "Sys"]
    rows = []
    for c in [*range(n), None]:
        for k in range(draw.randint(1, longest)):
            text = draw.choice(["Yes.", "no", "x! ", " ", None, "", f"Text {k}.", f"Text {draw.randrange(longest)}?", "ü…", "a\n.\n"])
            role = draw.choice(roles) if draw.random() < 0.4 else "user" if k % 2 == 0 else "assistant"
            rows.append((c, None if draw.random() < 0.1 else k + (draw.random() < 0.1), role, text))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "chunk", "longest"), [(1, 2048, 9), (2, 3, 30), (3, 1, 12)])
def test_against_all_edits(spark, monkeypatch, seed, chunk, longest):
    """Also with conversations cut into many chunks."""
    monkeypatch.setattr(structure_repair, "CHUNK", chunk)
    rows = talk(seed, 40, longest)
    assert by_spark(spark, rows) == by_hand(rows)


def test_one_long_conversation(spark, monkeypatch):
    """A third of all rows in one conversation, over many chunks, against a single chunk."""
    monkeypatch.setattr(structure_repair, "CHUNK", 50)
    rows = [(7, k, ("user", "assistant")[(k // 3) % 2], f"t{k % 700}" + ".!"[: k % 2]) for k in range(3000)] + [(100 + k // 4, k % 4, "user", f"q{k}.") for k in range(3000)]
    got = by_spark(spark, rows)
    monkeypatch.setattr(structure_repair, "CHUNK", 10_000)
    assert got == by_spark(spark, rows, 1)
    (turns,) = [t for c, t in damage(rows).items() if c == 7]
    (long,) = [r for r in got if r[0] == 7]
    assert len(long[7]) >= len(turns) and long[2] + long[3] + long[4] > 0


def test_rerun_stops_where_costs_differ_by_a_constant():
    draw = random.Random(5)
    for _ in range(200):
        flags = bytes(draw.randrange(32) for _ in range(draw.randint(0, 60)))
        old, new = (tuple(draw.randrange(9) for _ in range(4)) for _ in range(2))
        got = structure_repair.rerun(flags, old, structure_repair.backward(flags, old)[0], new)
        assert got == structure_repair.backward(flags, new)[0]


def test_odd_tables(spark):
    assert by_spark(spark, []) == []
    gone = next(c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert by_spark(spark, [(gone, 0, "user", "x.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", empty)]
    rows = [(1, 5, "user", "y" * 5_000_000), (1, 6, "assistant", "z" * 5_000_000 + "."), (2, None, None, None), (2, None, None, None)]
    assert by_spark(spark, rows) == by_hand(rows)


def test_query_against_its_twin(spark):
    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = con.execute(SQL["op12_conversation_repair"]).fetchall()
    got = QUERIES["op12_conversation_repair"](spark, path)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    rows = talk(6, 30, 12)
    con.execute("CREATE OR REPLACE TABLE odd (conv_id BIGINT, turn INTEGER, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO odd VALUES (?, ?, ?, ?)", rows)
    con.execute("CREATE OR REPLACE VIEW conversations AS SELECT * FROM odd")
    assert sorted(con.execute(SQL["op12_conversation_repair"]).fetchall(), key=str) == by_hand(rows)
