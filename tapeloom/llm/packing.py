"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by exact-complement hashing.

Only lengths decide a packing, and there are at most ``capacity`` of them.  So the plan is made on the histogram of piece lengths.  Sums of
one, two and three lengths are indexed in tables.  From the longest length down, the gap to the capacity is looked up there, and a
combination that fills it exactly is used as often as the counts of its lengths allow, until no length has an exact complement.  The
residual lengths are packed by best fit, the longest that still fits first.  A pattern leaves fewer pieces of some length than it takes of
it, so the number of patterns depends on ``capacity`` only, whatever the number of documents.

The pieces then find their places without meeting: a piece needs its rank among the pieces of its length, and ranks come from counts by
(length, salt) and a row number inside the salt, so a length that a third of all pieces share is spread over many groups.

Null and empty texts are one piece that holds the end id alone.  Rows that repeat a document id are packed as rows of their own.  An
empty table gives an empty packing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import BATCH_BYTES, balanced, rows_per_batch, texts_of
from tapeloom.llm.token_ids import ChunkIds, id_bytes, worker_ids
from tapeloom.sources.workspace import stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Chunks that a worker keeps from task to task, about 200 bytes each.
WORKER_REMEMBERS = 800_000
#: Chunks that a task remembers, and bytes of text that it cuts at once, where workers keep nothing.  A cut text needs about ten times its bytes.
TASK_REMEMBERS = 100_000
SMALL_BATCH = 1 << 20
#: Pieces of one length that are ranked together.
RANKED_TOGETHER = 50_000


def pieces(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", keep_chunks: bool = True) -> DataFrame:
    """Encode each document, add the end id, and cut only what is longer than the capacity.

    With ``keep_chunks`` a worker remembers chunks from task to task; without, it remembers fewer of them, takes less text at once and
    gives that memory back after each task.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = worker_ids(vocabulary, WORKER_REMEMBERS) if keep_chunks else ChunkIds(vocabulary, id_bytes, TASK_REMEMBERS)
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for b in balanced(batches, most=BATCH_BYTES if keep_chunks else SMALL_BATCH):
            out: list[tuple] = []
            for doc_id, parts in zip(b.column(0).to_pylist(), ids.batch(b.column(1).to_pylist())):
                raw = b"".join(parts) + end
                out += [(doc_id, k, at // 4, (min(len(raw), at + step) - at) // 4, zlib.crc32(raw[at : at + step])) for k, at in enumerate(range(0, len(raw), step))]
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(encode, PIECES)


class SumTables:
    """Sums of one, two and three lengths, kept in tables that are built once, with the counts that are left.

    ``pairs[s]`` is the shorter length of the first pair of sum ``s`` that may still be used and ``triples[s]`` the longest length of
    the first such triple, the more even pairs and the longer lengths first; 0 where there is none.  Counts only fall, so a combination
    that is used up never comes back and an entry only moves on.
    """

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()
        capacity = len(counts) - 1
        have = self.left > 0
        self.pairs = np.zeros(capacity + 1, np.int64)
        for s in range(2, capacity + 1):
            a = np.arange(s // 2, 0, -1)
            ok = have[a] & have[s - a] & ((a * 2 != s) | (self.left[a] > 1))
            self.pairs[s] = a[np.argmax(ok)] if ok.any() else 0
        self.triples = np.maximum(np.arange(capacity + 1) - 2, 0)

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if self.left[gap] > 0 else None

    def _pair(self, total: int, left: np.ndarray) -> int:
        """The shorter length of the first pair of this sum that ``left`` allows, from where the table stands."""
        a = np.arange(self.pairs[total], 0, -1)
        ok = (left[a] > 0) & (left[total - a] > (a * 2 == total))
        k = int(np.argmax(ok)) if len(ok) else 0
        return int(a[k]) if len(ok) and ok[k] else 0

    def pair(self, gap: int, without: tuple[int, ...]) -> tuple[int, ...] | None:
        """A pair of this sum beside the lengths ``without``, which the pattern takes already."""
        if not self.pairs[gap]:
            return None
        self.pairs[gap] = self._pair(gap, self.left)
        for n in without:
            self.left[n] -= 1
        a = self._pair(gap, self.left)
        for n in without:
            self.left[n] += 1
        return (gap - a, a) if a else None

    def triple(self, gap: int, without: tuple[int, ...]) -> tuple[int, ...] | None:
        top = int(self.triples[gap])
        a = np.arange(top, 0, -1)
        passed = 0
        for n in a[(self.left[a] > 0) & (self.pairs[gap - a] > 0)].tolist():
            rest = self.pair(gap - n, (*without, n)) if self.left[n] > without.count(n) else None
            if rest:
                self.triples[gap] = min(top, passed or n)
                return (n, *rest)
            # an entry stays where only the lengths of this pattern are in the way
            passed = passed or (n if self.pairs[gap - n] else 0)
        self.triples[gap] = passed
        return None

    def exact(self, longest: int) -> tuple[int, ...] | None:
        """A pattern of up to four lengths, ``longest`` among them, that fills the capacity."""
        gap = len(self.left) - 1 - longest
        if gap == 0:
            return (longest,)
        used = (longest,)
        self.left[longest] -= 1
        rest = self.single(gap)
        self.left[longest] += 1
        rest = rest or self.pair(gap, used) or self.triple(gap, used)
        return rest and (longest, *rest)

    def best_fit(self, longest: int) -> tuple[int, ...]:
        """``longest`` and then the longest length that fits, again and again."""
        chosen, gap = [longest], len(self.left) - 1 - longest
        left = self.left.copy()
        left[longest] -= 1
        while gap > 0:
            fits = np.flatnonzero(left[1 : gap + 1])
            if not len(fits):
                break
            a = int(fits[-1]) + 1
            n = int(min(left[a], gap // a))
            chosen += [a] * n
            left[a] -= n
            gap -= n * a
        return tuple(chosen)

    def use(self, pattern: tuple[int, ...]) -> int:
        """Take a pattern as often as the counts allow."""
        lengths, uses = np.unique(pattern, return_counts=True)
        copies = int((self.left[lengths] // uses).min())
        self.left[lengths] -= copies * uses
        return copies


def _planned(counts: np.ndarray, exact_first: bool) -> list[tuple[tuple[int, ...], int]]:
    tables = SumTables(counts)
    either = lambda longest: tables.exact(longest) or tables.best_fit(longest)
    patterns: list[tuple[tuple[int, ...], int]] = []
    for find in (tables.exact, tables.best_fit) if exact_first else (either,):
        for longest in range(len(counts) - 1, 0, -1):
            while tables.left[longest] > 0 and (pattern := find(longest)):
                patterns.append((pattern, tables.use(pattern)))
    return patterns


def plan(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each is used; ``counts[n]`` pieces have length ``n`` and the capacity is the last index.

    Either exact fills are used up before best fit packs the residual lengths, or a length without an exact fill is packed at once by best
    fit, before shorter ones take what fits beside it.  The plan with fewer sequences is taken, the first of the two if both have as many.
    """
    return min((_planned(counts, first) for first in (True, False)), key=lambda patterns: sum(copies for _, copies in patterns))


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Where the pieces of each length go, by their rank: ``copies`` ranks from ``first`` on, to sequences from ``sequence`` on."""
    next_rank: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, copies in patterns:
        offset = 0
        for n in lengths:
            first = next_rank.get(n, 0)
            next_rank[n] = first + copies
            rows.append((n, first, sequence, offset))
            offset += n
        sequence += copies
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces_df: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece (``doc_id, piece, start, length, ids_crc32``) its sequence and its offset there."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces_df.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["count"]
    table = slots(plan(counts))
    lengths, first, sequence, offset = (table[c].to_numpy() for c in ("length", "first", "sequence", "offset"))

    salts = int(counts.max() // RANKED_TOGETHER) + 1
    salted = pieces_df.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    bases = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")).select("length", "salt", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", inside.cast("long")).join(bases, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        starts = np.searchsorted(lengths, np.arange(capacity + 2))
        for b in batches:
            at = np.zeros(len(b), np.int64)
            n, rank = b["length"].to_numpy(), b["rank"].to_numpy()
            for k in np.unique(n):
                mine = n == k
                lo, hi = starts[k], starts[k + 1]
                at[mine] = lo + np.searchsorted(first[lo:hi], rank[mine], side="right") - 1
            yield b[["doc_id", "piece", "start", "length", "ids_crc32"]].assign(sequence_id=sequence[at] + rank - first[at], offset=offset[at])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInPandas(place, f"{PIECES}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
                     keep_chunks: bool = True) -> DataFrame:
    """Documents to places in sequences; the pieces are written once, since the plan needs all their lengths first."""
    return pack(stored(pieces(docs, vocabulary, capacity, end_id, id_col, text_col, keep_chunks), "pieces"), capacity)
