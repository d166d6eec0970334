"""Exact token ids of the word-end BPE vocabulary, chunk by chunk.

In this vocabulary white space separates and is dropped, and no token crosses it.  The ids of a text are therefore the ids of its
white-space chunks in a row, and a chunk that was met before need not be encoded again: natural text repeats most of its chunks.  New
chunks go to the library in batches.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain
from unicodedata import is_normalized

import numpy as np

from tapeloom.llm.common import LONG_TEXT, REMEMBERED

#: Stands between new chunks when they are encoded together; it is a token by itself.
MARK = "\x01"
#: str.split() cuts at the first four, the library does not; the fifth is the mark.
_NOT_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", MARK)
#: Lower-cased by context or into two characters, or perhaps a special string; left to the library.
_OWN_CASE = ("Σ", "İ", "<|")
#: A word and the marks after it.
_ENDED = re.compile(r"(\w+)([!-/:-@\[-^`{-~]+)")
_SPACE = re.compile(r"\s")
#: Characters of new chunks that the library gets in one string.
_JOINED = 1 << 16


def slices(text: str, most: int = LONG_TEXT) -> Iterator[str]:
    """Cut a long text at white space, which no token crosses."""
    start = 0
    while len(text) - start > most:
        cut = _SPACE.search(text, start + most)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def id_bytes(ids: np.ndarray) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return ids.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def worker_ids(path: str, remembered: int) -> ChunkIds:
    """The chunks that a Python worker remembers as bytes of ids, kept from task to task."""
    return ChunkIds(path, id_bytes, remembered)


class ChunkIds:
    """Ids of texts by remembered chunks.  ``store`` makes what is remembered of a chunk from its ids; joining chunks adds it up."""

    def __init__(self, path: str, store: Callable[[np.ndarray], object], remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        #: The same vocabulary for lower-case letters only, which need neither folding nor cutting.
        self.words = Tokenizer.from_file(path)
        self.words.no_truncation()
        self.words.no_padding()
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.store, self.remembered = store, remembered
        self.known: dict[str, object] = {}
        (self.mark,) = self.tok.encode(MARK, add_special_tokens=False).ids

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def chunks(self, text: str) -> list[str] | None:
        """The chunks of a text; None where only the library can cut it."""
        if any(c in text for c in _NOT_SPACE):
            return None
        return (text if any(c in text for c in _OWN_CASE) else text.lower()).split()

    def learn(self, chunks: set[str]) -> None:
        """Encode chunks that are not remembered yet.  Letters and the marks after them never share a token, so they go apart."""
        ended = {c: m.groups() for c in chunks if (m := _ENDED.fullmatch(c)) and m[1].isalpha() and "İ" not in c}
        wanted = chunks.difference(ended)
        wanted.update(p for parts in ended.values() for p in parts if p not in self.known)
        plain = {c for c in wanted if c.isalpha() and c.islower() and is_normalized("NFC", c)}
        for tok, some in ((self.words, plain), (self.tok, wanted - plain)):
            group: list[str] = []
            held = 0
            for c in some:
                group.append(c)
                held += len(c)
                if held > _JOINED:
                    self._encode(tok, group)
                    group, held = [], 0
            if group:
                self._encode(tok, group)
        for c, (letters, marks) in ended.items():
            self.known[c] = self.known[letters] + self.known[marks]

    def _encode(self, tok, group: list[str]) -> None:
        (got,) = tok.encode_batch_fast([f" {MARK} ".join(group)], add_special_tokens=False)
        ids = np.array(got.ids, dtype=np.uint32)
        cuts = np.flatnonzero(ids == self.mark).tolist()
        if len(cuts) == len(group) - 1:
            bounds = zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])
            if self.store is id_bytes:  # cut once as bytes
                raw = id_bytes(ids)
                self.known.update(zip(group, [raw[4 * s : 4 * e] for s, e in bounds]))
            else:
                self.known.update(zip(group, [self.store(ids[s:e]) for s, e in bounds]))
        else:  # not separable: each by itself
            self.known.update((c, self.store(self.whole(c))) for c in group)

    def batch(self, texts: list[str]) -> Iterator[Iterator]:
        """What is stored for the chunks of each text, in order."""
        if len(self.known) > self.remembered:
            self.known.clear()
        cut = [[self.chunks(s) for s in slices(t)] for t in texts]
        met: set[str] = set()
        for parts in cut:
            met.update(*filter(None, parts))
        self.learn(met.difference(self.known))
        get = self.known.__getitem__
        for t, parts in zip(texts, cut):
            if any(p is None for p in parts):
                yield iter([self.store(self.whole(t))])
            else:
                yield map(get, chain.from_iterable(parts))
