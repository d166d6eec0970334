"""Language identification by a bidirectional gated recurrent network over bytes.

The UTF-8 bytes of a text are read in windows of ``WINDOW`` bytes, forwards and backwards, by two small gated recurrent units.  At every
byte the two states together give a probability for each language, and a document's probabilities are the means over the bytes of its
letters.  Whole texts are read; windows only bound how far a state reaches, so thousands of them run side by side as matrix rows.

The network is trained here, in numpy, by backpropagation through time with Adam, on windows drawn from a bounded sample of labelled
rows: at most about ``per_language`` rows of each language, chosen by a hash of the id, never from the held-out fifth.  The weights are a
few kilobytes.  Prediction is one pass over the texts without a shuffle.

A null text and a text without a letter are ``und`` with score 0, and so is everything where no row has a language.  Repeated rows are
predicted one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.common import balanced, held_out, rewritten, rows_per_batch, texts_of

WINDOW = 48
HIDDEN = 8
PER_LANGUAGE = 400
#: Windows that each sampled row gives to training at most.
WINDOWS_PER_ROW = 12
#: Windows that run side by side when predicting.
SIDE_BY_SIDE = 1024
UNKNOWN = "und"

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def windows_of(raw: bytes) -> np.ndarray:
    """The windows of a text, the last one filled up with zeros."""
    n = -(-len(raw) // WINDOW)
    return np.frombuffer(raw.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1.0
    x *= 0.5
    return x


class Reader:
    """A gated recurrent unit that reads one way: gates and candidate from a byte and the state before."""

    def __init__(self, draw: np.random.Generator, hidden: int = HIDDEN):
        f = np.float32
        self.gate_in = draw.normal(0, 0.3, (256, 2 * hidden)).astype(f)
        self.cand_in = draw.normal(0, 0.3, (256, hidden)).astype(f)
        self.gate_rec = draw.normal(0, hidden**-0.5, (hidden, 2 * hidden)).astype(f)
        self.cand_rec = draw.normal(0, hidden**-0.5, (hidden, hidden)).astype(f)
        self.cand_bias = np.zeros(hidden, f)

    def parameters(self) -> list[np.ndarray]:
        return [self.gate_in, self.cand_in, self.gate_rec, self.cand_rec, self.cand_bias]

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple:
        k = h.shape[1]
        gates = h @ self.gate_rec
        gates += self.gate_in.take(x, axis=0)
        _sigmoid(gates)
        keep, reset = gates[:, :k], gates[:, k:]
        rec = h @ self.cand_rec
        rec += self.cand_bias
        cand = reset * rec
        cand += self.cand_in.take(x, axis=0)
        np.tanh(cand, out=cand)
        new = h - cand
        new *= keep
        new += cand
        return new, keep, reset, rec, cand

    def back(self, x: np.ndarray, h: np.ndarray, saved: tuple, d_new: np.ndarray, grads: list[np.ndarray]) -> np.ndarray:
        """Gradients of one step; returns that of the state before it."""
        _, keep, reset, rec, cand = saved
        d_cand = d_new * (1 - keep) * (1 - cand * cand)
        d_keep = d_new * (h - cand) * keep * (1 - keep)
        d_reset = d_cand * rec * reset * (1 - reset)
        d_rec = d_cand * reset
        d_gates = np.concatenate([d_keep, d_reset], axis=1)
        order = np.argsort(x, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(x[order]) != 0])
        grads[0][x[order][first]] += np.add.reduceat(d_gates[order], first)
        grads[1][x[order][first]] += np.add.reduceat(d_cand[order], first)
        grads[2] += h.T @ d_gates
        grads[3] += h.T @ d_rec
        grads[4] += d_rec.sum(axis=0)
        return d_new * keep + d_gates @ self.gate_rec.T + d_rec @ self.cand_rec.T


class Network:
    """Two readers and one output layer over both states at every byte."""

    def __init__(self, languages: list[str], seed: int = 11, hidden: int = HIDDEN):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.ahead, self.backward = Reader(draw, hidden), Reader(draw, hidden)
        self.out = draw.normal(0, 0.2, (2 * hidden, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.ahead.parameters(), *self.backward.parameters(), self.out, self.bias]

    def states(self, by_time: np.ndarray, save: bool) -> tuple[np.ndarray, list, list]:
        """States of both readers at every byte, (time, window, 2 x hidden), and what each step saved for the way back."""
        steps, n = by_time.shape
        both = np.empty((steps, n, 2 * self.hidden), np.float32)
        saved: list[list] = [[None] * steps, [None] * steps]
        for side, (reader, times) in enumerate(((self.ahead, range(steps)), (self.backward, range(steps - 1, -1, -1)))):
            h = np.zeros((n, self.hidden), np.float32)
            for t in times:
                got = reader.step(by_time[t], h)
                if save:
                    saved[side][t] = (h, got)
                h = got[0]
                both[t, :, side * self.hidden : (side + 1) * self.hidden] = h
        return both, saved[0], saved[1]

    def probabilities(self, by_time: np.ndarray, save: bool = False) -> tuple[np.ndarray, tuple]:
        states = self.states(by_time, save)
        steps, n, width = states[0].shape
        p = states[0].reshape(-1, width) @ self.out
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(steps, n, -1), states

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Backpropagation through time of the mean cross entropy over all bytes."""
        by_time = np.ascontiguousarray(windows.T)
        p, (both, saved_a, saved_b) = self.probabilities(by_time, save=True)
        p[:, np.arange(len(labels)), labels] -= 1
        p *= _IS_LETTER[by_time][:, :, None]
        p /= by_time.size
        grads = [np.zeros_like(a) for a in self.parameters()]
        flat = p.reshape(-1, p.shape[2])
        grads[10] += both.reshape(-1, both.shape[2]).T @ flat
        grads[11] += flat.sum(axis=0)
        d_both = (flat @ self.out.T).reshape(both.shape)
        for reader, saved, times, g, side in ((self.ahead, saved_a, range(len(by_time) - 1, -1, -1), grads[:5], 0), (self.backward, saved_b, range(len(by_time)), grads[5:10], 1)):
            d_h = np.zeros((len(labels), self.hidden), np.float32)
            for t in times:
                h, step = saved[t]
                d_h = reader.back(by_time[t], h, step, d_h + d_both[t, :, side * self.hidden : (side + 1) * self.hidden], g)
        return grads

    def document_means(self, windows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean probabilities over the letters' bytes of each document; ``starts`` has the first window of each."""
        sums = np.zeros((len(windows), len(self.languages)))
        letters = np.zeros(len(windows))
        for at in range(0, len(windows), SIDE_BY_SIDE):
            by_time = np.ascontiguousarray(windows[at : at + SIDE_BY_SIDE].T)
            p, _ = self.probabilities(by_time)
            use = _IS_LETTER[by_time]
            sums[at : at + SIDE_BY_SIDE] = np.einsum("tnk,tn->nk", p, use.astype(np.float32))
            letters[at : at + SIDE_BY_SIDE] = use.sum(axis=0)
        return np.add.reduceat(sums, starts) / np.maximum(np.add.reduceat(letters, starts), 1)[:, None]


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = 400, batch: int = 192, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over random batches of windows, the languages drawn alike often."""
    net, draw = Network(languages), np.random.default_rng(seed)
    params = net.parameters()
    first, second = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    members = [np.flatnonzero(labels == k) for k in range(len(languages))]
    for t in range(1, steps + 1):
        chosen = np.concatenate([draw.choice(m, max(1, batch // len(members))) for m in members])
        lr = rate * (1 - t / (steps + 1)) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        for a, g, m, v in zip(params, net.gradients(windows[chosen], labels[chosen]), first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            a -= lr * m / (np.sqrt(v) + 1e-8)
    return net


def _usable(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    return rows.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """Train on the bounded sample; None where nothing is labelled."""
    usable = _usable(docs, id_col, text_col, lang_col)
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not counts:
        return None
    languages = sorted(counts)
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sampled = usable.where(chance < F.element_at(share, F.col("lang")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches):
            out = []
            for text in b.column(1).to_pylist():
                w = windows_of((text or "").encode("utf-8", "surrogatepass"))
                some = np.random.default_rng(len(w)).permutation(len(w))[:WINDOWS_PER_ROW]
                out.append(w[some].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(out, pa.binary())], ["lang", "windows"])

    rows = rows_per_batch(sampled).mapInArrow(cut, "lang string, windows binary").collect()  # bounded by the sample
    rows.sort(key=lambda r: (r["lang"], bytes(r["windows"])))
    windows = np.frombuffer(b"".join(r["windows"] for r in rows), np.uint8).reshape(-1, WINDOW)
    labels = np.concatenate([np.full(len(r["windows"]) // WINDOW, languages.index(r["lang"])) for r in rows] or [np.zeros(0, int)])
    present = sorted(set(labels.tolist()))
    if not present:
        return None
    return train(windows, np.searchsorted(present, labels), [languages[k] for k in present])


def language_id(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: the score is the mean probability of the predicted language."""
    net = fit(docs, per_language, id_col, text_col, lang_col)
    return predict(docs, net, id_col, text_col)


class Judge:
    """Languages and scores of whole texts."""

    def __init__(self, net: Network | None):
        import regex

        self.net, self.letter = net, regex.compile(r"\p{L}").search

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
        full = [i for i, t in enumerate(texts) if self.letter(t)]
        if full and self.net is not None:
            cut = [windows_of(texts[i].encode("utf-8", "surrogatepass")) for i in full]
            starts = np.cumsum([0, *(len(w) for w in cut[:-1])])
            means = self.net.document_means(np.concatenate(cut), starts)
            for i, k, p in zip(full, means.argmax(axis=1), means.max(axis=1)):
                lang[i], score[i] = self.net.languages[k], min(1.0, float(p))
        return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` by a fitted network."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(net)
        for b in balanced(batches):
            lang, score = judge(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    found = rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def only_certain(docs: DataFrame, least: float, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents with a language whose score is at least ``least``, all columns as they are."""
    net = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)

    def judge():
        of = Judge(net)
        return lambda texts: [t if k != UNKNOWN and p >= least else None for t, k, p in zip(texts, *of(texts))]

    return rewritten(docs, judge, text_col)
