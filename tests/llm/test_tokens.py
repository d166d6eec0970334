from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from functools import lru_cache
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from tapeloom.llm import bpe, packing, token_counts
from tapeloom.llm.token_ids import ChunkIds, slices
from tests.llm.conftest import BYTE, WORD

ODD = ["", "  ", "a\x1cb", "x<|endoftext|>y", "<|ENDOFTEXT|>", "İ|", "Σας. ΟΔΟΣ,", "don't we'll", "é́ e\u0301.", "...!!!", "\x01 a", "word.\u0301", "tab\there\x0b\x0cthere\u3000wide"]


def test_chunk_ids_are_those_of_the_library(small_docs):
    texts = [r["text"] for r in small_docs.collect()] + ODD
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    got = ChunkIds(WORD, lambda a: a.tobytes()).batch(texts)
    assert [np.frombuffer(b"".join(g), np.uint32).tolist() for g in got] == want


def test_long_texts_are_cut_at_white_space():
    text = "ab cd\nef " * 1000
    parts = list(slices(text, 64))
    assert "".join(parts) == text and all(p[0].isspace() for p in parts[1:])
    assert list(slices("x" * 500, 64)) == ["x" * 500]


def test_token_counts_of_odd_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORD)
    got = [tuple(r) for r in token_counts.token_counts(odd_docs, WORD).collect()]
    want = [(r["doc_id"], len((r["text"] or "").encode()), n := len(tok.encode(r["text"] or "", add_special_tokens=False).ids), n > 2048) for r in odd_docs.collect()]
    assert Counter(got) == Counter(want)
    assert token_counts.token_counts(no_docs, WORD).count() == 0


def packed_right(rows, capacity):
    by_sequence: dict[int, list] = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_packing_of_odd_rows(odd_docs, no_docs):
    tok = Tokenizer.from_file(WORD)
    rows = packing.best_fit_packing(odd_docs, WORD, capacity=512).collect()
    packed_right(rows, 512)
    want = Counter()
    for r in odd_docs.collect():
        ids = [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            want[(r["doc_id"], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert packing.best_fit_packing(no_docs, WORD).count() == 0


def test_plan_fills_exactly_where_it_can():
    counts = np.zeros(101, np.int64)
    for n, k in ((60, 5), (40, 5), (50, 4), (70, 3), (21, 3), (9, 3), (85, 2), (8, 2), (5, 2), (2, 2)):
        counts[n] = k
    patterns = packing.plan(counts)
    used = Counter()
    for lengths, copies in patterns:
        assert sum(lengths) <= 100 and copies > 0
        for n in lengths:
            used[n] += copies
    assert used == Counter({int(n): int(counts[n]) for n in np.flatnonzero(counts)})
    assert sum(copies for _, copies in patterns) == -(-int((counts * np.arange(101)).sum()) // 100)


def test_plan_is_close_to_the_bound():
    counts = np.bincount(np.minimum(np.random.default_rng(1).lognormal(5, 1, 5000).astype(int) + 1, 1024), minlength=1025)
    patterns = packing.plan(counts)
    assert len(patterns) <= 1024
    assert sum(c for _, c in patterns) <= 1.01 * (counts * np.arange(1025)).sum() / 1024 + 1


def test_bpe_is_the_library(small_docs):
    texts = [r["text"] for r in small_docs.collect()] + ODD + ["a" * 400, "ab" * 300, "\n" * 50, "  x  "]
    tok, own = Tokenizer.from_file(BYTE), bpe.Bpe(BYTE)
    for text, want in zip(texts, tok.encode_batch(texts, add_special_tokens=False)):
        got = own.encode(text)
        assert np.frombuffer(got, np.uint32).tolist() == want.ids
        assert own.decode(got) == tok.decode(want.ids, skip_special_tokens=False)


def test_bpe_round_trip_of_odd_rows(odd_docs, no_docs):
    rows = bpe.bpe_round_trip(odd_docs, BYTE, with_ids=True).collect()
    texts = Counter((r["doc_id"], r["text"] or "") for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == texts
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest()
    assert bpe.bpe_round_trip(no_docs, BYTE).count() == 0


def test_small_packings_need_the_fewest_sequences():
    """Against an exhaustive packer: every exact fill is found, and best fit loses nothing at this size."""

    def fewest(lengths: tuple[int, ...], capacity: int) -> int:
        @lru_cache(None)
        def go(left: tuple[int, ...]) -> int:
            if not left:
                return 0
            first, rest = left[-1], left[:-1]
            best = len(left)
            for k in range(len(rest) + 1):
                for others in set(combinations(rest, k)):
                    if sum(others) + first <= capacity:
                        remaining = list(rest)
                        for o in others:
                            remaining.remove(o)
                        best = min(best, 1 + go(tuple(remaining)))
            return best

        return go(tuple(sorted(lengths)))

    for seed in range(40):
        r = np.random.default_rng(seed)
        capacity = int(r.integers(6, 16))
        lengths = tuple(int(x) for x in r.integers(1, capacity + 1, int(r.integers(1, 8))))
        counts = np.bincount(lengths, minlength=capacity + 1)
        patterns = packing.plan(counts)
        used = np.zeros(capacity + 1, np.int64)
        for pattern, copies in patterns:
            assert sum(pattern) <= capacity
            np.add.at(used, list(pattern), copies)
        assert used.tolist() == counts.tolist()
        assert sum(copies for _, copies in patterns) == fewest(lengths, capacity), (seed, lengths, capacity)
