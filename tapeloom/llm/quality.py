"""Line-first quality rules: judge each line, remove those that fail, then reject a document that lost too much or is poor as a whole.

A line with a word fails by the first rule that holds:

* punctuation: no word of it ends like a sentence, or it has more marks than words;
* navigation: it is a row of items between separators;
* boilerplate: it holds a licence, cookie or menu phrase.

Lines without a word are kept and count for nothing.  A document is rejected when its failed lines hold more than ``most_lost`` of its
word characters, when it has too few words, or when too many of its words lie in five-word windows that it holds twice or more.

Words are runs without ASCII white space.  Null and empty texts have no words and are rejected.  Every row is judged by itself, so
repeated rows and ids get equal results, and a long text needs memory in proportion to itself only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tapeloom.llm.common import balanced, rewritten, rows_per_batch, texts_of

SYMBOLS = b"#*$%&|<>"
MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_SENTENCE = re.compile("(?:[.!?]|…)(?:[\"')\\]]|»|”)*(?:[ \t\x0b\x0c\r]|$)".encode())
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "cookie policy", "privacy policy", "terms of use", "terms of service",
               "click here", "subscribe to our", "sign up for", "enable javascript", "skip to content")
_BOILERPLATE = re.compile("|".join(BOILERPLATE).encode())
_SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5


@dataclass(frozen=True)
class Rules:
    fewest_words: int = 10
    most_repeated: int = 20  # per cent of the words
    most_lost: int = 50  # per cent of the word characters


def failed_rule(line: bytes, n_words: int) -> str | None:
    """The rule that a line with words fails."""
    if n_words >= 3 and 3 * sum(line.count(c) for c in (b"|", b">")) >= n_words:
        return "navigation"
    if _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    if len(line) - len(line.translate(None, MARKS)) > n_words or not _SENTENCE.search(line):
        return "punctuation"
    return None


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more, the first time included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    ordered = np.sort(mixed)
    if not (ordered[1:] == ordered[:-1]).any():
        return 0
    codes: dict[bytes, int] = {}  # equal hashes: now by the words themselves
    at = np.array([codes.setdefault(w, len(codes)) for w in words], np.int64)
    two = _renamed(at[:-1], at[1:])
    four = _renamed(two[:-2], two[2:])
    _, which, count = np.unique(_renamed(four[:-1], at[4:]), return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    often = np.flatnonzero(count[which] > 1)
    np.add.at(edge, often, 1)
    np.add.at(edge, often + WINDOW, -1)
    return int((np.cumsum(edge) > 0).sum())


def _renamed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each distinct pair."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)


def judge_text(text: str, rules: Rules = Rules()) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_failed_lines, cleaned text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines, seen, with_words, lost, kept_lines, failed = raw.split(b"\n"), set(), 0, 0, [], 0
    for line in lines:
        n = len(line.split())
        if n:
            with_words += 1
            seen.add(line)
            if failed_rule(line, n):
                failed += 1
                bare = line.translate(None, _SPACES).decode("utf-8", "surrogatepass")
                lost += len(bare)
                continue
        kept_lines.append(line)
    repeat = repeated_words(words)
    base_failed = n_words < rules.fewest_words or 100 * repeat > rules.most_repeated * n_words
    kept = not base_failed and 100 * lost <= rules.most_lost * word_chars
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    cleaned = text if not failed else b"\n".join(kept_lines).decode("utf-8", "surrogatepass")
    return n_words, word_chars, symbols, with_words - len(seen), repeat, base_failed, kept, failed, cleaned


COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
           ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("n_failed_lines", pa.int64()), ("cleaned", pa.string())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_failed_lines long"


def quality_rules(docs: DataFrame, rules: Rules = Rules(), with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts and verdicts, and the cleaned text if asked for."""
    columns = COLUMNS if with_text else COLUMNS[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in balanced(batches):
            rows = [judge_text(t, rules)[: len(columns)] for t in b.column(1).to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * len(columns)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, columns))], ["doc_id", *(n for n, _ in columns)])

    return rows_per_batch(texts_of(docs, id_col, text_col)).mapInArrow(run, SCHEMA + (", cleaned string" if with_text else ""))


def only_kept(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, without their failed lines and with all other columns as they are."""

    def judge():
        def clean(texts: list[str]) -> list[str | None]:
            return [j[8] if j[6] else None for j in (judge_text(t, rules) for t in texts)]

        return clean

    return rewritten(docs, judge, text_col)
