"""Suffix-array deduplication: remove every byte that a string of ``length`` bytes covers which also starts earlier.

Texts are UTF-8 bytes, matches never cross documents, and all strings are judged on the input.

1. *Anchors.*  In each window of ``length`` bytes the ``GRAM``-byte substring with the least hash is an anchor.  Equal windows have their
   anchor at the same place, so only anchors whose substring occurs twice or more can lie in a repeated window.  Substrings are counted
   over all documents, with partial sums before the shuffle.
2. *Runs.*  A window is judged at its own anchor only, so the bytes around an anchor matter as far as its windows reach.  Each task sorts the suffixes at its repeated anchors, ``length`` bytes from the anchor on and then the bytes before it
   backwards.  Of equal ones only the earliest goes on, since the others are covered by it.  The sorted run is cut by the anchor's
   substring into buckets and front-coded: every suffix is stored as the length of the prefix it shares with the one before and the rest.
3. *Merge.*  A bucket's runs are combined by a loser tree that knows the common prefix of each head with the last output.  Heads with
   different known prefixes need no comparison, and others are compared behind it.  The merged order comes with the common prefixes of
   neighbours, so suffixes that share any number of bytes are intervals, and together with the order of the bytes before the anchor they
   give, for each offset of a window around the anchor, the classes of equal windows.  All but the earliest of a class are covered.
4. *Cut.*  The covered spans go back to the texts that have any.

A substring that very many places share is cut further by the ``DEEP`` bytes before it.  Windows that begin closer to such an anchor share
all but ``DEEP - 1`` of their bytes from it on, which cut them instead.  A phrase shorter than ``length`` that very many texts hold, each in
surroundings of its own, has the same anchor and the same bytes before it everywhere, so its places still meet in one bucket.

Null and empty texts have no bytes.  Documents without an id come last, and rows with one id are ordered by a hash of their text; equal rows
are one document and are returned alike.  Suffixes are cut off at the end of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import balanced, rows_per_batch
from tapeloom.sources.workspace import stored

LENGTH = 100
GRAM = 32
#: Suffixes that a bucket is to hold.
BUCKET_ROWS = 40_000
#: Places from which on a substring counts as very frequent, and the bytes before it that cut it further.
FREQUENT, DEEP = 5_000, 3
NO_ID = (1 << 63) - 1


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """``best`` (np.minimum or np.maximum) of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the substring at every place, built from halves."""
    h, span = raw.astype(np.uint64) + np.uint64(1), 1
    while span < GRAM:
        h = h[:-span] * np.uint64(0x9E3779B97F4A7C15 + 2 * span) + (h[span:] ^ (h[span:] >> np.uint64(31)))
        span *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h >> np.uint64(16)


def anchors(raw: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and hashes of a text's anchors, and the least hash of each window."""
    if len(raw) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h, wide = gram_hashes(raw), length - GRAM + 1
    least = _sliding(h, wide, np.minimum)
    edge = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([edge, least, edge]), wide, np.maximum) == h)
    return at, h[at].astype(np.int64), least


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``did, th, raw``: the id for ordering, the hash that tells texts of one id apart, and the bytes."""
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(raw).alias("th"), raw.alias("raw"))


def _text_key() -> Column:
    """One number for a text and its id, so that texts with one id, or without any, do not meet; no wider than an id."""
    return F.xxhash64("did", "th").alias("text")


def _anchor_rows(documents: DataFrame, length: int, counted: bool) -> DataFrame:
    """``h, n`` of each task's anchors added up, or ``h, text, at`` of each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            found = [anchors(np.frombuffer(r, np.uint8), length) for r in b.column(1).to_pylist()]
            h = np.concatenate([f[1] for f in found])
            if counted:
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], ["h", "n"])
            else:
                text = np.repeat(b.column(0).to_numpy(), [len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(text), pa.array(np.concatenate([f[0] for f in found]))], ["h", "text", "at"])

    return rows_per_batch(documents.select(_text_key(), "raw")).mapInArrow(run, "h long, n long" if counted else "h long, text long, at long")


def _repeated(documents: DataFrame, length: int) -> DataFrame:
    """``text, places``: places of repeated anchors, doubled, and one more where the substring is very frequent."""
    often = _anchor_rows(documents, length, True).groupBy("h").agg(F.sum("n").alias("f")).where("f > 1").select("h", (F.col("f") > FREQUENT).cast("long").alias("frequent"))
    often = stored(often, "repeated-substrings")  # read from there, a side of the join that Spark can split where it is skewed
    places = _anchor_rows(documents, length, False).join(often, "h")
    return places.groupBy("text").agg(F.collect_set(F.col("at") * 2 + F.col("frequent")).alias("places"))


def suffixes_at(raw: np.ndarray, at: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rows of ``length`` bytes from each place on and then the bytes before it backwards, zeros outside the text."""
    before = length - GRAM
    padded = np.concatenate([np.zeros(before, np.uint8), raw, np.zeros(length, np.uint8)])
    reach = np.concatenate([np.arange(length), np.arange(-1, -before - 1, -1)])
    return padded[at[:, None] + before + reach[None, :]]


def _order(rows: np.ndarray) -> np.ndarray:
    """The sorted order of byte rows."""
    return np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")


def _prefixes(rows: np.ndarray) -> np.ndarray:
    """How many bytes each row shares with the one before."""
    differ = rows[1:] != rows[:-1]
    shared = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.concatenate([np.zeros(min(1, len(rows)), np.int64), shared])


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = (h ^ rows[:, k]) * np.uint64(0x100000001B3)
        h ^= h >> np.uint64(29)
    return h


def judged_offsets(at: np.ndarray, h: np.ndarray, least: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of an anchor from the start of a window whose anchor it is; these windows are neighbours."""
    starts = at[:, None] - np.arange(length - GRAM + 1)[None, :]
    own = (starts >= 0) & (starts < len(least)) & (least[np.clip(starts, 0, max(len(least) - 1, 0))] == h.astype(np.uint64)[:, None])
    return own.argmax(axis=1), length - GRAM - own[:, ::-1].argmax(axis=1)


class Suffixes:
    """Suffixes of a task or bucket as columns: key bytes, owner, place, bytes there are on both sides, and the offsets to judge."""

    COLUMNS = ("did", "th", "at", "left", "right", "low", "high")

    def __init__(self, keys: np.ndarray, columns: np.ndarray):
        self.keys, self.columns = keys, columns  # columns: one row for each name

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[self.COLUMNS.index(name)]

    def take(self, which: np.ndarray) -> Suffixes:
        return Suffixes(self.keys[which], self.columns[:, which])


def _spans(s: Suffixes, most: np.ndarray, least: np.ndarray, length: int) -> np.ndarray:
    """``did, th, start, stop``: what the windows at offsets ``least`` to ``most`` cover."""
    return np.stack([s["did"], s["th"], s["at"] - most, s["at"] - least + length], axis=1)


def reduced(s: Suffixes, length: int) -> tuple[Suffixes, np.ndarray]:
    """A sorted run with the earliest of equal suffixes, and the spans of the others."""
    by_age = np.lexsort((s["at"], s["th"], s["did"]))
    s = s.take(by_age)
    s = s.take(_order(s.keys))
    kind = s["low"]
    same = (_prefixes(s.keys) == s.keys.shape[1]) & np.r_[False, (np.diff(kind) == 0) & (np.diff(s["high"]) == 0) & (np.diff(s["left"]) == 0) & (np.diff(s["right"]) == 0)][: len(kind)]
    itself = same & np.r_[False, (np.diff(s["did"]) == 0) & (np.diff(s["th"]) == 0) & (np.diff(s["at"]) == 0)][: len(kind)]
    late = s.take(np.flatnonzero(same & ~itself))
    most = np.minimum(late["left"], late["high"])
    least = np.maximum(length - late["right"], late["low"])
    some = most >= least
    return s.take(np.flatnonzero(~same)), _spans(late.take(np.flatnonzero(some)), most[some], least[some], length)


def front_coded(s: Suffixes) -> tuple[bytes, bytes, bytes]:
    """Shared prefixes, the rests of the keys, and the columns."""
    shared = _prefixes(s.keys)
    rest = s.keys[np.arange(s.keys.shape[1])[None, :] >= shared[:, None]]
    return shared.astype(np.uint8).tobytes(), rest.tobytes(), s.columns.tobytes()


def front_decoded(shared: bytes, rest: bytes, columns: bytes, width: int) -> tuple[list[bytes], list[int], np.ndarray]:
    keys, prefixes, at, last = [], list(shared), 0, b""
    for p in prefixes:
        last = last[:p] + rest[at : at + width - p]
        at += width - p
        keys.append(last)
    return keys, prefixes, np.frombuffer(columns, np.int64).reshape(len(Suffixes.COLUMNS), -1)


def merged(runs: list[tuple[list[bytes], list[int]]], width: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Loser-tree merge of sorted runs with known prefixes: (run, place) in order, and the bytes shared with the one before."""
    n = 1
    while n < len(runs):
        n *= 2
    place = [0] * n
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (n - len(runs))
    known = [0] * n  # bytes that each head shares with the last output
    tree = [0] * n  # losers; tree[0] is the winner

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser then knows what it shares with the winner."""
        x, y = head[a], head[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        p = known[a]
        x, y = x[p:], y[p:]
        if x == y:
            known[b] = width
            return a, b
        apart = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
        shared = p + len(x) - (apart + 7) // 8
        if x < y:
            known[b] = shared
            return a, b
        known[a] = shared
        return b, a

    def build(node: int) -> int:
        if node >= n:
            return node - n
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    order: list[tuple[int, int]] = []
    prefixes: list[int] = []
    winner = build(1) if n > 1 else 0
    while head[winner] is not None:
        order.append((winner, place[winner]))
        prefixes.append(known[winner])
        place[winner] += 1
        keys, shared = runs[winner]
        if place[winner] < len(keys):
            head[winner], known[winner] = keys[place[winner]], shared[place[winner]]
        else:
            head[winner] = None
        node = (winner + n) // 2
        while node >= 1:
            winner, tree[node] = play(winner, tree[node])
            node //= 2
    return order, prefixes


def covered(s: Suffixes, prefixes: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Spans of all windows around the anchors that also start earlier; ``s`` is in merged order with its shared prefixes."""
    before = length - GRAM
    left_keys = s.keys[:, length:]
    by_left = _order(left_keys)
    left_shared = _prefixes(left_keys[by_left])
    age = np.lexsort((s["at"], s["th"], s["did"]))  # the earliest first
    most, least = np.full(len(age), -1, np.int64), np.full(len(age), length, np.int64)
    for offset in range(before + 1):
        usable = (s["left"] >= offset) & (s["right"] >= length - offset) & (s["low"] <= offset) & (s["high"] >= offset)
        right_class = np.cumsum(prefixes < length - offset)
        left_class = np.empty(len(age), np.int64)
        left_class[by_left] = np.cumsum(left_shared < offset)
        judged = age[usable[age]]
        key = right_class[judged] * (len(age) + 1) + left_class[judged]
        _, first = np.unique(key, return_index=True)
        late = np.ones(len(judged), bool)
        late[first] = False
        hit = judged[late]
        most[hit] = offset
        least[hit] = np.minimum(least[hit], offset)
    which = np.flatnonzero(most >= 0)
    return _spans(s.take(which), most[which], least[which], length)


def _runs(repeated: DataFrame, buckets: int, length: int) -> DataFrame:
    """``bucket, shared, rest, columns, spans``: each task's front-coded runs and the spans it could settle itself."""
    before = length - GRAM

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            keys, columns, frequent = [], [], []
            for did, th, raw, places in zip(*(c.to_pylist() for c in b.columns)):
                raw, places = np.frombuffer(raw, np.uint8), np.sort(np.array(places, np.int64))
                every, h, least = anchors(raw, length)
                k = np.searchsorted(every, places >> 1)
                fits = (k < len(every)) & (every[np.minimum(k, len(every) - 1)] == places >> 1) if len(every) else np.zeros(len(k), bool)
                at, often = places[fits] >> 1, (places[fits] & 1).astype(bool)  # other places belong to another text with this key
                low, high = judged_offsets(at, h[k[fits]], least, length)
                full = np.full(len(at), 1, np.int64)
                keys.append(suffixes_at(raw, at, length))
                columns.append(np.stack([did * full, th * full, at, np.minimum(at, before), np.minimum(len(raw) - at, length), low, high]))
                frequent.append(often)
            if not keys:
                continue
            s, often = Suffixes(np.concatenate(keys), np.concatenate(columns, axis=1)), np.concatenate(frequent)
            parts = [(s.take(np.flatnonzero(~often)), GRAM, 0)]
            if often.any():
                deep, near = (s.take(np.flatnonzero(often & some)) for some in (s["high"] >= DEEP, s["low"] < DEEP))
                deep.columns[5] = np.maximum(deep["low"], DEEP)
                near.columns[6] = np.minimum(near["high"], DEEP - 1)
                parts += [(deep, GRAM, DEEP), (near, length - DEEP + 1, 0)]
            for part, behind, ahead in parts:
                unread = np.concatenate([np.arange(length)[None, :] >= length - part["low"][:, None], np.arange(before)[None, :] >= part["high"][:, None]], axis=1)
                part.keys[unread] = 0  # bytes that no judged window reaches
                kept, spans = reduced(part, length)
                by = _hash_rows(np.concatenate([kept.keys[:, :behind], kept.keys[:, length : length + ahead]], axis=1))
                bucket = (by % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, int)
                rows = [(int(bucket[order[e]]), *front_coded(kept.take(order[e:stop])), b"") for e, stop in zip(edges, [*edges[1:], len(order)])]
                if len(spans):
                    rows.append((int(spans[0, 2]) % buckets, b"", b"", b"", np.ascontiguousarray(spans).tobytes()))
                cols = list(zip(*rows)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["bucket", "shared", "rest", "columns", "spans"])

    return rows_per_batch(repeated.select("did", "th", "raw", "places")).mapInArrow(run, "bucket long, shared binary, rest binary, columns binary, spans binary")


def _merge_bucket(length: int):
    width = 2 * length - GRAM

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        spans = [np.frombuffer(x, np.int64).reshape(-1, 4) for x in frame["spans"] if len(x)]
        decoded = [front_decoded(*x, width) for x in zip(frame["shared"], frame["rest"], frame["columns"]) if len(x[0])]
        if decoded:
            order, prefixes = merged([(keys, shared) for keys, shared, _ in decoded], width)
            keys = np.frombuffer(b"".join(decoded[r][0][k] for r, k in order), np.uint8).reshape(-1, width)
            starts = np.cumsum([0, *(len(d[0]) for d in decoded)])
            which = np.array([starts[r] + k for r, k in order])
            columns = np.concatenate([d[2] for d in decoded], axis=1)[:, which]
            spans.append(covered(Suffixes(keys, columns), np.array(prefixes), length))
        out = np.concatenate(spans) if spans else np.zeros((0, 4), np.int64)
        return pd.DataFrame(out, columns=["did", "th", "start", "stop"])

    return run


def _cut(texts: DataFrame) -> DataFrame:
    """``did, th, n_removed, n_spans, kept_sha256, kept`` from ``did, th, raw, spans``; the kept text has no halves of characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            removed, runs, digest, kept = [], [], [], []
            for raw, spans in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                edge = np.zeros(len(raw) + 1, np.int64)
                np.add.at(edge, [s["start"] for s in spans], 1)
                np.add.at(edge, [s["stop"] for s in spans], -1)
                gone = np.cumsum(edge[:-1]) > 0
                rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(int((np.diff(np.r_[False, gone].astype(np.int8)) == 1).sum()))
                digest.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest.decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                                             ["did", "th", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "did long, th long, n_removed long, n_spans long, kept_sha256 string, kept string")


def shortened(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``did, th, n_removed, n_spans, kept_sha256, kept`` of the documents that lose bytes."""
    documents = _documents(docs, id_col, text_col)
    repeated = stored(documents.withColumn("text", _text_key()).join(_repeated(documents, length), "text").drop("text").dropDuplicates(["did", "th"]), "repeated-anchors")
    total = repeated.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BUCKET_ROWS + 1)
    spans = _runs(repeated, buckets, length).groupBy("bucket").applyInPandas(_merge_bucket(length), "did long, th long, start long, stop long")
    per_text = spans.groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    return _cut(repeated.select("did", "th", "raw").join(per_text, ["did", "th"]).select("did", "th", "raw", "spans"))


def same_document(id_col: Column, text: Column) -> list[Column]:
    """The keys ``did, th`` of a row."""
    return [F.coalesce(id_col.cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(F.coalesce(text.cast("string").cast("binary"), F.lit(b""))).alias("th")]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document."""
    less = shortened(docs, length, id_col, text_col).drop("kept")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *same_document(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")),
                        F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    joined = every.join(less, ["did", "th"], "left")
    return joined.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
                         F.coalesce("kept_sha256", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of ``docs`` with all their columns and what is left of the text; the length column, where there is one, follows it."""
    less = shortened(docs, length, id_col, text_col).select(F.col("did").alias("_did"), F.col("th").alias("_th"), F.col("kept").alias("_kept"))
    did, th = same_document(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    joined = docs.withColumns({"_d": did, "_t": th}).join(less, (F.col("_d") == F.col("_did")) & (F.col("_t") == F.col("_th")), "left")
    new = {text_col: F.coalesce("_kept", F.col(f"`{text_col}`"))}
    if length_col in docs.columns:
        new[length_col] = F.when(F.col("_kept").isNull(), F.col(f"`{length_col}`")).otherwise(F.length("_kept").cast(docs.schema[length_col].dataType))
    return joined.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])
