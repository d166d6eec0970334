"""Substring deduplication by relative Lempel-Ziv parsing: remove every word that a window of ``window`` words covers which also starts in
a document with a smaller id.

Words are runs of bytes other than 0x20 and 0x09 to 0x0D, compared unchanged; windows never cross documents and are judged on the input.

1. *Where to look.*  In each window the group of ``gram`` words with the least hash is its anchor, so equal windows have equal anchors.
   Anchors are added up over all documents, with partial sums before the shuffle; those with one id alone cannot lie in a repeated window.
   The smallest id that holds an anchor is its reference document.
2. *Passages.*  What surrounds the anchors of one reference is a passage of the document, as long as they follow each other, and goes to
   the block of that reference; the reference sends its own.  All places of an anchor thus meet in a block.  Of equal passages in a batch
   only the smallest id goes on, for it covers the others.  Where very many documents hold an anchor, its passages are dealt over several
   parts, and the reference's own goes to each of them.
3. *Factors.*  A block is indexed by the exact rank of the window at every word, built by doubling, with the earliest source of each.  Every
   passage is parsed greedily: at the first window with a source in a smaller id the factor goes on as far as the source does, and is a
   duplicate span.  Where it breaks, the windows over the break are looked up by themselves, and the next factor begins with the first
   that has a source.
4. *What is left.*  In an anchor's parts a window that its reference does not hold may still be shared between two of them.  Words of such
   windows go through the same steps once more, each window being its own anchor, so its reference holds it and no part can miss it.
5. *Cut.*  Spans go back to the texts.

Null and empty texts have no words and lose none.  Rows without an id come after all ids and never count against each other; neither do rows
that repeat an id, and equal rows are returned alike.  An empty table gives an empty result.  A long text is read in slices, and its passages
are bounded by what it shares.  Hashes only choose where to look; a block compares words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import balanced, rows_per_batch
from tapeloom.sources.workspace import stored

WINDOW, GRAM = 13, 6
#: Documents with an anchor that meet in one part, and anchors of documents that a block is to hold.
TOGETHER, BLOCK_PLACES = 256, 60_000
NO_ID = (1 << 63) - 1
_SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_TEXTS = "did long, th long, base long, raw binary"


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    one = np.ones(1, np.uint64)
    up = np.concatenate([one, np.cumprod(np.full(n, _BASE, np.uint64))])
    return up, np.concatenate([one, np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), np.uint64))])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def words_at(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text start and stop, and a hash of each."""
    x = np.frombuffer(raw, np.uint8)
    space = np.ones(len(x) + 2, np.int8)
    space[1:-1] = (x == 32) | ((x >= 9) & (x <= 13))
    edge = np.diff(space)
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # a slice of whole words at a time
        upto = max(int(np.searchsorted(stops, starts[k] + _SLICE, "right")), k + 1)
        lo, hi = int(starts[k]), int(stops[upto - 1])
        up, down = _powers(max(_SLICE, 1 << (hi - lo).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((x[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo])])
        a, b = starts[k:upto] - lo, stops[k:upto] - lo
        hashes[k:upto] = _mixed((total[b] - total[a]) * down[a])
        k = upto
    return starts, stops, hashes


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    span = 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(raws: list[bytes], window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place among the text's words and hash of each anchor of some texts."""
    starts, _, w = words_at(b"\n".join(raws))
    ends = np.cumsum([len(r) + 1 for r in raws])
    text = np.searchsorted(ends, starts, "right")
    if len(w) < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(len(w) - gram + 1, np.uint64)
    for k in range(gram):
        h = h * np.uint64(_BASE) + w[k : k + len(h)]
    h = _mixed(h) | np.uint64(1)
    wide = window - gram + 1
    least = _least(h, wide)
    least[text[: len(least)] != text[window - 1 :]] = 0  # a window over two texts
    edge = np.zeros(wide - 1, np.uint64)
    at = np.flatnonzero(~_least(~np.concatenate([edge, least, edge]), wide) == h)
    first = np.searchsorted(text, np.arange(len(raws)))
    return text[at], at - first[text[at]], h[at].view(np.int64)


def _anchor_rows(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``h, lo, hi, n``: least and greatest id and the number of documents with each anchor, added up within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            text, _, h = anchors(b.column(1).to_pylist(), window, gram)
            did = b.column(0).to_numpy()[text]
            order = np.lexsort((did, h))
            h, did = h[order], did[order]
            new = np.r_[True, h[1:] != h[:-1]][: len(h)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(h)] - 1 if len(h) else first
            holders = np.add.reduceat((new | np.r_[True, did[1:] != did[:-1]][: len(h)]).astype(np.int64), first) if len(h) else first
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h[first], did[first], did[last], holders)], ["h", "lo", "hi", "n"])

    return rows_per_batch(texts.select("did", "raw")).mapInArrow(run, "h long, lo long, hi long, n long")


def _anchor_places(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``h, key, at`` of each anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            text, at, h = anchors(b.column(1).to_pylist(), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(b.column(0).to_numpy()[text]), pa.array(at.astype(np.int64))], ["h", "key", "at"])

    return rows_per_batch(texts.select("key", "raw")).mapInArrow(run, "h long, key long, at long")


def _passages(found: DataFrame, window: int, gram: int) -> DataFrame:
    """``ref, bits, part, did, th, start, stop, raw``: passages for the blocks; those that an equal one settles have no ``raw``."""
    names = ["ref", "bits", "part", "did", "th", "start", "stop", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            cut: dict[tuple[int, int, bytes], list[tuple[int, int, int, int]]] = {}
            for did, th, base, raw, spots in zip(*(c.to_pylist() for c in b.columns)):
                starts, stops, _ = words_at(raw)
                at = np.array([s["at"] for s in spots], np.int64)
                ref, bits = np.array([s["ref"] for s in spots], np.int64), np.array([s["bits"] for s in spots], np.int64)
                usable = (at + gram <= len(starts)) & (ref <= did)  # others belong to another text with this key
                order = np.flatnonzero(usable)[np.argsort(at[usable], kind="stable")]
                if not len(order):
                    continue
                at, ref, bits = at[order], ref[order], bits[order]
                new = np.r_[True, (np.diff(ref) != 0) | (np.diff(bits) != 0) | (np.diff(at) > 2 * window - gram)]
                head = np.flatnonzero(new)
                tail = np.r_[head[1:], len(at)] - 1
                for i, k in zip(head.tolist(), tail.tolist()):
                    lo, hi = max(int(at[i]) - (window - gram), 0), min(int(at[k]) + window, len(starts))
                    if hi - lo >= window:
                        text = raw[starts[lo] : stops[hi - 1]]
                        cut.setdefault((int(ref[i]), int(bits[i]), text), []).append((did, th, base + lo, base + hi))
            rows = []
            for (ref, bits, text), owners in cut.items():
                first = min(owners)
                for own in owners:
                    if own[0] > first[0]:
                        rows.append((ref, 0, own[1] & 1023, *own, None))
                    elif own[0] == ref:
                        rows += [(ref, bits, p, *own, text) for p in range(1 << bits)]
                    else:
                        rows.append((ref, bits, own[1] & ((1 << bits) - 1), *own, text))
            cols = list(zip(*rows)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names)

    return rows_per_batch(found.select("did", "th", "base", "raw", "spots")).mapInArrow(run, ", ".join(f"{n} long" for n in names[:7]) + ", raw binary")


class Block:
    """An indexed reference block: the words of some passages in order of their ids, and the earliest source of every window."""

    def __init__(self, ids: np.ndarray, passages: list[list[bytes]], window: int = WINDOW):
        known: dict[bytes, int] = {}
        sizes = np.array([len(p) for p in passages])
        self.ends = np.cumsum(sizes + 1)  # each passage is closed by a mark of its own
        self.offset = self.ends - sizes - 1
        self.words = np.empty(int(self.ends[-1]), np.int64)
        for p, at in zip(passages, self.offset):
            self.words[at : at + len(p)] = [known.setdefault(w, len(known)) for w in p]
        self.words[self.ends - 1] = len(known) + np.arange(len(passages))
        self.of = np.repeat(np.arange(len(passages)), sizes + 1)
        self.window = window
        rank, span = self.words, 1
        while 2 * span <= window:
            rank = self._paired(rank, span)
            span *= 2
        if span < window:
            rank = self._paired(rank, window - span)
        n = max(len(self.words) - window + 1, 0)
        self.whole = self.ends[self.of[:n]] - 1 - np.arange(n) >= window
        _, first, cls = np.unique(rank[:n], return_index=True, return_inverse=True)
        self.source = first[cls]
        self.late = self.whole & (ids[self.of[self.source]] < ids[self.of[:n]])

    @staticmethod
    def _paired(rank: np.ndarray, apart: int) -> np.ndarray:
        """Ranks of longer windows from those of two parts."""
        if len(rank) <= apart:
            return rank[:0]
        return np.unique(rank[:-apart] * (int(rank.max()) + 1) + rank[apart:], return_inverse=True)[1]

    def alike(self, i: int, j: int) -> int:
        """How many words go on alike from two places."""
        n, step = 0, 64
        while True:
            a, b = self.words[i + n : i + n + step], self.words[j + n : j + n + step]
            differ = a[: len(b)] != b[: len(a)]
            if differ.any():
                return n + int(differ.argmax())
            n, step = n + step, 2 * step

    def factors(self) -> list[tuple[int, int, int]]:
        """Greedy factors with a source in a smaller id: passage, first word and end there."""
        seeds = np.flatnonzero(self.late)
        out, k = [], 0
        while k < len(seeds):
            i = int(seeds[k])
            size = self.alike(i, int(self.source[i]))
            p = int(self.of[i])
            at = i - int(self.offset[p])
            out.append((p, at, at + size))
            k = int(np.searchsorted(seeds, i + size - self.window + 1))  # windows over the break are looked up by themselves
        return out


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[False, flags, False].astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _factor_block(window: int):
    """Spans of a block's passages, and as rows with ``raw`` what only another part may know."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        settled = frame["raw"].isna()
        rows = [(*r, None) for r in frame.loc[settled, ["did", "th", "start", "stop"]].itertuples(index=False)]
        frame = frame[~settled].sort_values(["did", "th", "start"], kind="stable")
        if len(frame):
            passages = [r.split() for r in frame["raw"]]
            did, th, start = (frame[c].to_numpy() for c in ("did", "th", "start"))
            block = Block(did, passages, window)
            rows += [(int(did[p]), int(th[p]), int(start[p]) + a, int(start[p]) + b, None) for p, a, b in block.factors()]
            for p in np.flatnonzero((frame["bits"].to_numpy() > 0) & (frame["ref"].to_numpy() != did)):
                at = int(block.offset[p])
                open_windows = block.whole[at : at + len(passages[p])] & ~block.late[at : at + len(passages[p])]
                for s, e in zip(*(x.tolist() for x in _runs(open_windows))):
                    rows.append((int(did[p]), int(th[p]), int(start[p]) + s, int(start[p]) + e + window - 1, b" ".join(passages[p][s : e + window - 1])))
        return pd.DataFrame(rows, columns=["did", "th", "start", "stop", "raw"])

    return run


def _round(texts: DataFrame, window: int, gram: int) -> DataFrame:
    """``did, th, start, stop, raw`` from ``did, th, base, raw``: spans, and passages that are still open."""
    texts = texts.withColumn("key", F.xxhash64("did", "th", "base"))
    often = _anchor_rows(texts, window, gram).groupBy("h").agg(F.min("lo").alias("ref"), F.max("hi").alias("hi"), F.sum("n").alias("n")).where("ref < hi")
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / TOGETHER))).cast("int")
    often = stored(often.select("h", "ref", bits.alias("bits"), "n"), "repeated-words")  # Spark can split this side of the join where it is skewed
    total = often.agg(F.sum("n")).first()[0] or 0
    blocks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // BLOCK_PLACES + 1)
    places = _anchor_places(texts, window, gram).join(often.drop("n"), "h").groupBy("key").agg(F.collect_list(F.struct("at", "ref", "bits")).alias("spots"))
    passages = _passages(texts.join(places, "key"), window, gram)
    block = F.pmod(F.xxhash64("ref", "bits", "part"), F.lit(blocks))
    return passages.withColumn("block", block).groupBy("block").applyInPandas(_factor_block(window), "did long, th long, start long, stop long, raw binary")


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    raw = F.coalesce(F.col(f"`{text_col}`").cast("string").cast("binary"), F.lit(b""))
    doc_id = F.col(f"`{id_col}`").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(NO_ID)).alias("did"), F.xxhash64(raw).alias("th"), raw.alias("raw"))


def spans(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``did, th, start, stop``: word spans that repeat a smaller id, of ``did, th, raw``; spans of one text may overlap."""
    found = stored(_round(documents.select("did", "th", F.lit(0).cast("long").alias("base"), "raw"), window, gram), "factors")
    sure, still_open = found.where("raw IS NULL").drop("raw"), found.where("raw IS NOT NULL")
    if still_open.isEmpty():
        return sure
    again = _round(still_open.select("did", "th", F.col("start").alias("base"), "raw"), window, window)
    return sure.unionByName(stored(again, "factors").where("raw IS NULL").drop("raw"))


def kept_words(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: what is left of each document, its words joined by one space."""
    documents = _documents(docs, id_col, text_col)
    per_text = spans(documents, window, gram).groupBy("did", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches, "raw"):
            counts, removed, kept = [], [], []
            for raw, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = raw.split()
                n, gone = len(words), 0
                if found:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in found], 1)
                    np.add.at(edge, [s["stop"] for s in found], -1)
                    stays = np.cumsum(edge[:-1]) == 0
                    words = [words[i] for i in np.flatnonzero(stays).tolist()]
                    gone = n - len(words)
                counts.append(n)
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    joined = documents.join(per_text, ["did", "th"], "left").select("doc_id", "raw", "spans")
    return rows_per_batch(joined).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
