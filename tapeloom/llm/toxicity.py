"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are words, pairs of neighbours and pairs with one or two words between, hashed into a fixed number of slots; a document has a
slot or not.  Every slot keeps its own learning rate, and the L1 term leaves a slot at zero until the evidence for it exceeds a
threshold, so only few weights travel to the tasks, whatever the number of documents.

The model is fitted on a bounded sample: for each label at most ``per_label`` rows, the first ones by a hash of the id among labelled
rows that are not held out.  Scoring is one pass over whole texts without a shuffle.

Null and empty texts have no features and get the score of the bias.  Documents are scored row by row, so repeats score alike; without a
usable label, or with labels of one kind only, the bias decides everywhere.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import REMEMBERED, balanced, held_out, rows_per_batch, texts_of

BITS = 20
PER_LABEL = 4000
_WORD = re.compile(r"\w+")
#: Distances of paired words: neighbours, and skips of one and two words.
GAPS = (1, 2, 3)


class WordHashes(dict):
    """Checksums of words, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def slots(text: str, hashes: WordHashes, bits: int = BITS) -> np.ndarray:
    """Slots of all features of a text, with repeats."""
    words = _WORD.findall(text.lower())
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    mix, down = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - bits)
    parts = [h * mix >> down]
    for gap in GAPS:
        parts.append((h[:-gap] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * gap) + h[gap:]) * mix >> down)
    return np.concatenate(parts).astype(np.uint32)


@dataclass(frozen=True)
class Ftrl:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 16.0
    l2: float = 0.1
    epochs: int = 8


def weights_of(z: np.ndarray, n: np.ndarray, p: Ftrl) -> np.ndarray:
    w = (np.sign(z) * p.l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2)
    w[np.abs(z) <= p.l1] = 0.0
    return w


def fit(examples: list[tuple[np.ndarray, int]], bits: int = BITS, p: Ftrl = Ftrl()) -> tuple[np.ndarray, np.ndarray, float]:
    """Slots with a weight, their weights and the bias."""
    z, n, bias = np.zeros(1 << bits), np.zeros(1 << bits), 0.0
    order = np.random.default_rng(7)
    toxic = sum(y for _, y in examples)
    weight = (1.0, max(1.0, (len(examples) - toxic) / max(toxic, 1)))  # both labels weigh the same
    for epoch in range(p.epochs):
        for i in order.permutation(len(examples)):
            x, y = examples[i]
            zx, nx = z[x], n[x]
            w = weights_of(zx, nx, p)
            g = weight[y] * (_sigmoid(w.sum() + bias) - y)
            z[x] = zx + g - (np.sqrt(nx + g * g) - np.sqrt(nx)) / p.alpha * w
            n[x] = nx + g * g
            bias -= 0.02 * g / (1 + epoch)
    w = weights_of(z, n, p)
    used = np.flatnonzero(w)
    return used.astype(np.uint32), w[used].astype(np.float32), bias


def _sigmoid(x: float) -> float:
    return 1.0 / (1.0 + np.exp(-max(-30.0, min(30.0, x))))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The bounded training rows, with features instead of texts."""
    usable = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    pick = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for y in (0, 1)]
    chosen = pick[0].union(pick[1]).groupBy("doc_id").agg(F.max("y").alias("y"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in balanced(batches):
            x = [np.unique(slots(t, hashes)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.binary())], ["doc_id", "y", "x"])

    # ``chosen`` has at most twice ``per_label`` rows, so the texts stay where they are
    return rows_per_batch(texts_of(docs, id_col, text_col)).join(F.broadcast(chosen), "doc_id").mapInArrow(features, "doc_id long, y int, x binary")


def toxicity(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Fit on the sample and score every document."""
    rows = sorted(sample(docs, labels, per_label, id_col, text_col, label_col).collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    used, weights, bias = fit([(np.frombuffer(r["x"], np.uint32), r["y"]) for r in rows])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, hashes = np.zeros(1 << BITS, np.float32), WordHashes()
        dense[used] = weights
        for b in balanced(batches):
            out = []
            for t in b.column(1).to_pylist():
                x = slots(t, hashes)
                x = np.unique(x[dense[x] != 0])
                out.append(float(_sigmoid(float(dense[x].sum()) + bias)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), pa.array([int(s >= 0.5) for s in out], pa.int32())], ["doc_id", "score", "predicted"])

    scored = rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(score, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
