"""Exact byte-pair encoding and decoding by dynamic programming over prefixes.

The encoding of a prefix ends with one certain token.  It is found among the tokens that are suffixes of the prefix: the token whose
left neighbour, the last token of the shorter prefix, it can stand beside, which is so when the merges never join bytes across the seam.
One pass stores the last token of every prefix, and following them back from the end gives the ids, so no merge queue is run.

The suffixes come from an automaton over the vocabulary.  Whether two tokens can stand side by side is decided by undoing their merges
from the latest on and looking for a merge across the seam that would have come earlier; the answers are remembered, and so are the ids of
the pieces into which the vocabulary's pattern cuts a text.

Null and empty texts have no tokens.  Every row is encoded by itself; a text is taken whole, and needs memory in proportion to itself.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import REMEMBERED, balanced, rows_per_batch, texts_of

#: Pattern of the byte-level vocabulary, which no token crosses.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pairs of tokens whose answer a worker remembers.
PAIRS = 2_000_000


def letters_of_bytes() -> dict[str, int]:
    """The letters by which a vocabulary file writes bytes: printable ones stand for themselves, the rest follow from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges, for encoding and decoding."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab, letters = data["model"]["vocab"], letters_of_bytes()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: bytes(letters[c] for c in w) for w, i in vocab.items() if w not in self.special}
        self.bytes_of |= {i: w.encode() for w, i in self.special.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in data["model"]["merges"]]
        self.joins = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        #: By token: when it was made and from what; single bytes have been there before the first merge.
        self.made: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, t) in self.joins.items():
            self.made.setdefault(t, (rank, a, b))
        self.suffixes = ahocorasick.Automaton()
        for w, i in vocab.items():
            if w not in self.special and (i in self.made or len(self.bytes_of[i]) == 1):
                self.suffixes.add_word(self.bytes_of[i].decode("latin-1"), (len(self.bytes_of[i]), i))
        self.suffixes.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split if self.special else lambda t: [t]
        self.beside: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def stand_apart(self, left: int, right: int) -> bool:
        """Whether no merge joins bytes of ``left`` and ``right`` when both are encoded together."""
        before, included = len(self.joins), False  # a merge across the seam counts if it comes before this one
        while True:
            join = self.joins.get((left, right))
            if join and (join[0] < before or included and join[0] == before):
                return False
            a, b = self.made.get(left), self.made.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and a[0] > b[0]:
                before, included, left = a[0], False, a[2]
            else:  # equal merges run from left to right, so one across the seam comes before that inside ``right``
                before, included, right = b[0], True, b[1]

    def ids(self, piece: str) -> bytes:
        """The ids of one piece, as little-endian 32-bit integers."""
        raw = piece.encode("utf-8", "surrogatepass").decode("latin-1")
        last, beside = [-1] * (len(raw) + 1), self.beside
        size = [0] * (len(raw) + 1)
        for end, (n, token) in self.suffixes.iter(raw):
            end += 1
            if last[end] >= 0:
                continue
            start = end - n
            if start:
                pair = last[start] << 32 | token
                ok = beside.get(pair)
                if ok is None:
                    if len(beside) > PAIRS:
                        beside.clear()
                    ok = beside[pair] = self.stand_apart(last[start], token)
                if not ok:
                    continue
            last[end], size[end] = token, n
        out, at = [], len(raw)
        while at:
            out.append(last[at])
            at -= size[at]
        return np.array(out[::-1], "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        out: list[bytes] = []
        for part in self.split(text) if self.special else [text]:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            pieces = self.cut(part)
            for p in set(pieces).difference(known):
                known[p] = self.ids(p)
            out += map(known.__getitem__, pieces)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, vocabulary: str, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token count and digests of ids and decoded text, and the ids themselves and the decoded text if asked for."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe(vocabulary)
        for b in balanced(batches):
            n, digest, back, ids, decoded = [], [], [], [], []
            for t in b.column(1).to_pylist():
                got = bpe.encode(t)
                text = bpe.decode(got)
                n.append(len(got) // 4)
                digest.append(hashlib.sha256(got).hexdigest())
                back.append(hashlib.sha256(text.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(got, "<u4").astype(np.int64))
                    decoded.append(text)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(run, schema)
