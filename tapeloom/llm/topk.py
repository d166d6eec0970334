"""Exact top-k search by inner product with a bit-sliced index.

Each component becomes floor(1024 x).  Rows are dealt into blocks, and a block's index holds, for every component, the most significant
bits of its distance from the block's least value, one bitmap a bit.  The score of a query against all rows of a block is added up from
these bitmaps with bitmap arithmetic, for many queries at once, into bit slices of a sum.  Reading that sum from its most significant
slice downward selects the k largest rows without looking at any value.  What quantisation left out is bounded, so the rows that could still
belong to the top are those whose sum is within that bound of the k-th; they are resolved by the exact integer product.

Rows are dealt into parts of several blocks, which travel once; queries are dealt into blocks as well, and a copy of each goes to every part.
A part and at most ``PART_QUERIES`` query blocks meet in a cogroup, whatever their sizes are thought to be, so nothing is broadcast and nothing
is collected.  The k best of each part meet in a ranking per query.

A vector that is null, empty, without an id, or has a null or non-finite component takes no part.  Only vectors of as many components as
the query are compared.  Rows that repeat an id are candidates one by one, and none of them is a candidate of a query with that id; what
queries of one id find is ranked together.  Ties go to the smaller id.  Vectors with a component of 2**28 or more after scaling stay out of the
index and are compared by integers of any size; a score that a long cannot hold becomes the nearest one that it can.  An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROW_BLOCK = 1024
#: Blocks of a part, once there are as many parts as ``FEW_PARTS``; a task holds one part.
PART_BLOCKS = 16
FEW_PARTS = 64
QUERY_BLOCK = 512
#: Query blocks that meet a part at once, 16 MB of 64 components; a part is copied for each further so many.
PART_QUERIES = 64
BITS = 6
SCALE = 1024
LARGEST = 1 << 28


def scaled(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, v``: the vectors that take part, of whole numbers as doubles, which hold each of them exactly."""
    x = F.transform(F.col(f"`{vector_col}`"), lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    usable = F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vector_col}`").isNotNull() & (F.size(F.col(f"`{vector_col}`")) > 0)
    # from 2**53 on a double is whole, and this side of it a long holds the floor
    scaled_ = lambda c: F.when(F.abs(c) >= F.lit(2.0**43), c * F.lit(float(SCALE))).otherwise(F.floor(c * F.lit(float(SCALE))).cast("double"))
    largest = F.lit(float(np.finfo(float).max))
    held = lambda c: F.greatest(F.least(scaled_(c), largest), -largest)
    return vectors.where(F.when(usable, fine).otherwise(F.lit(False))).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(x, held).alias("v"))


def _slots(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _blocks(rows: DataFrame, slots: int) -> DataFrame:
    """``dim, slot, ids, body``: vectors of one length dealt over ``slots`` blocks, sorted by id, as binary."""

    def build(key, frame: pd.DataFrame) -> pd.DataFrame:
        ordered = sorted(zip(frame["vec_id"], map(tuple, frame["v"])))
        ids, body = np.array([r[0] for r in ordered], np.int64), np.array([r[1] for r in ordered], float)
        return pd.DataFrame([(int(key[0]), int(key[1]), ids.tobytes(), body.tobytes())], columns=["dim", "slot", "ids", "body"])

    dealt = rows.withColumn("dim", F.size("v")).withColumn("slot", F.pmod(F.xxhash64("vec_id", "v"), F.lit(slots)).cast("int"))
    return dealt.groupBy("dim", "slot").applyInPandas(build, "dim int, slot int, ids binary, body binary")


class BitSlices:
    """The index of a block: bitmaps of each component's leading bits."""

    def __init__(self, body: np.ndarray, bits: int = BITS):
        self.n, self.body = len(body), body
        self.words = -(-self.n // 64)
        self.least = body.min(axis=0)
        span = body.max(axis=0) - self.least
        self.down = np.array([max(0, int(s).bit_length() - bits) for s in span])
        self.top = (1 << bits) - 1
        coarse = (body - self.least) >> self.down
        self.slices = np.stack([self._packed((coarse >> b & 1).astype(bool)) for b in range(bits)])  # bit, component, word
        self.rows = self._packed(np.ones((self.n, 1), bool))[0]

    def _packed(self, flags: np.ndarray) -> np.ndarray:
        """Bitmaps of the columns of a row-by-column array."""
        padded = np.zeros((self.words * 64, flags.shape[1]), bool)
        padded[: self.n] = flags
        return np.ascontiguousarray(np.packbits(padded.T, axis=1, bitorder="little")).view(np.uint64)

    def sums(self, queries: np.ndarray) -> np.ndarray:
        """Slices of each query's sum over coarse components, (level, query, word); negative weights count from the top down."""
        weights = np.abs(queries) << self.down  # a coarse step of a component is worth that much
        most = int(weights.sum(axis=1).max()) * self.top
        levels = np.zeros((most.bit_length() + 1, len(queries), self.words), np.uint64)
        flip = np.where(queries < 0, ~np.uint64(0), np.uint64(0))
        for d in range(queries.shape[1]):
            column = weights[:, d]
            for j in range(int(column.max()).bit_length()):
                takes = np.where(column >> j & 1, ~np.uint64(0), np.uint64(0))[:, None]
                if not takes.any():
                    continue
                for b in range(len(self.slices)):
                    carry = (self.slices[b, d][None, :] ^ flip[:, d : d + 1]) & takes
                    for level in range(j + b, len(levels)):
                        both = levels[level] & carry
                        levels[level] ^= carry
                        carry = both
                        if not carry.any():
                            break
        return levels

    def candidates(self, queries: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best of each query, as a query-by-row array of flags."""
        levels = self.sums(queries)
        nq = len(queries)
        sure = np.zeros((nq, self.words), np.uint64)
        tied = np.repeat(self.rows[None, :], nq, axis=0)
        least = np.zeros(nq, np.int64)  # the k-th largest sum
        wanted = min(k, self.n)
        for level in range(len(levels) - 1, -1, -1):
            ones = tied & levels[level]
            enough = np.bitwise_count(sure | ones).sum(axis=1) >= wanted
            least += enough.astype(np.int64) << level
            sure = np.where(enough[:, None], sure, sure | ones)
            tied = np.where(enough[:, None], ones, tied & ~levels[level])
        # each component's left-out part lies between 0 and 2**down - 1
        unsure = (np.abs(queries) * ((1 << self.down) - 1)).sum(axis=1)
        floor = np.maximum(least - unsure, 0)
        greater, equal = np.zeros((nq, self.words), np.uint64), np.repeat(self.rows[None, :], nq, axis=0)
        for level in range(len(levels) - 1, -1, -1):
            bit = np.where(floor >> level & 1, ~np.uint64(0), np.uint64(0))[:, None]
            greater |= equal & levels[level] & ~bit
            equal &= ~(levels[level] ^ bit)
        flags = np.unpackbits((greater | equal).view(np.uint8), axis=1, bitorder="little")
        return flags[:, : self.n].astype(bool)


def best_of_block(index: BitSlices, ids: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the ids and scores of its k best rows of the block, those with its own id left out."""
    repeats = int(np.unique(ids, return_counts=True)[1].max())  # so many of the best may have its own id
    flags = index.candidates(queries, k + repeats)
    for q in range(len(queries)):
        rows = np.flatnonzero(flags[q])
        rows = rows[ids[rows] != query_ids[q]]
        scores = index.body[rows] @ queries[q]
        order = np.lexsort((ids[rows], -scores))[:k]
        yield int(query_ids[q]), ids[rows][order], scores[order]


def best_exact(ids: np.ndarray, body: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same by integers of any size."""
    whole = lambda m: [[int(x) for x in row] for row in m]
    rows = whole(body)
    for query_id, q in zip(query_ids, whole(queries)):
        scores = ((max(min(sum(a * b for a, b in zip(q, r)), (1 << 63) - 1), -(1 << 63)), int(i)) for i, r in zip(ids, rows) if i != query_id)
        best = sorted(scores, key=lambda s: (-s[0], s[1]))[:k]
        yield int(query_id), np.array([i for _, i in best], np.int64), np.array([s for s, _ in best], np.int64)


def best_of_pair(ids: np.ndarray, body: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The k best rows of a block for each query: by the index where longs hold all products, else by integers of any size."""
    small, small_q = (np.abs(m).max(axis=1) < LARGEST for m in (body, queries))
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    if small.any() and small_q.any():
        found += best_of_block(BitSlices(body[small].astype(np.int64)), ids[small], query_ids[small_q], queries[small_q].astype(np.int64), k)
    if not small.all() and small_q.any():
        found += best_exact(ids[~small], body[~small], query_ids[small_q], queries[small_q], k)
    if not small_q.all():
        found += best_exact(ids, body, query_ids[~small_q], queries[~small_q], k)
    return found


def _first(found: list[tuple[int, np.ndarray, np.ndarray]], k: int) -> pd.DataFrame:
    """``query_id, vec_id, score``: the k best of what was found for each query id."""
    q = np.concatenate([np.full(len(ids), query, np.int64) for query, ids, _ in found])
    ids, scores = (np.concatenate([f[c] for f in found]).astype(np.int64) for c in (1, 2))
    order = np.lexsort((ids, ~scores, q))  # ~ turns the order round for every long
    q, ids, scores = q[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    keep = place < k
    return pd.DataFrame({"query_id": q[keep], "vec_id": ids[keep], "score": scores[keep]})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose id is divisible by ``every``."""
    rows = scaled(vectors, id_col, vector_col)
    asked = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_asked = rows.count(), asked.count()
    row_slots = min(_slots(n_rows, ROW_BLOCK), max(FEW_PARTS, _slots(n_rows, ROW_BLOCK * PART_BLOCKS)))
    query_slots = _slots(n_asked, QUERY_BLOCK)
    block = ROW_BLOCK  # the size that holds here goes to the tasks
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    parts = _blocks(rows, row_slots).withColumn("share", upto(_slots(query_slots, PART_QUERIES)))
    queries = _blocks(asked, query_slots).select("dim", F.floor(F.col("slot") / PART_QUERIES).cast("int").alias("share"), "ids", "body").withColumn("slot", upto(row_slots))

    def search(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        best: list[pd.DataFrame] = []
        for ids, body, dim in zip(held["ids"], held["body"], held["dim"]):
            ids, body = np.frombuffer(ids, np.int64), np.frombuffer(body).reshape(-1, dim)
            pieces = np.array_split(np.arange(len(ids)), max(1, round(len(ids) / block)))  # even ones, a small rest costs as much as a block
            for query_ids, q in zip(asking["ids"], asking["body"]):
                query_ids, q = np.frombuffer(query_ids, np.int64), np.frombuffer(q).reshape(-1, dim)
                found = [f for at in pieces for f in best_of_pair(ids[at], body[at], query_ids, q, k)]
                if found:
                    best.append(_first(found, k))
        return pd.concat(best) if best else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("query_id", "vec_id", "score")})

    keys = ["dim", "slot", "share"]
    best = parts.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
