"""Token ids of whole texts by a public tokenizer, fast enough for a corpus.

The vocabulary files used here drop white space and never merge over it, so the ids of a text are
those of its space-separated words, one after the other. Words repeat: each distinct one is encoded
once per worker and looked up from then on. Words of plain letters skip the library's slow
normaliser (their lower case is the same by definition) and go to its merge model directly; all
others take the library's whole path.
"""

from __future__ import annotations

import gc
import os
import re
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd

from funnelworks.llm import wordscan

MAX_WORDS = 400_000  # distinct words a worker remembers before it starts anew; bounds its memory
# What normaliser and splitter of word-end BPE files do to words of these characters is known.
_PLAIN = re.compile(r"[\n\x21-\x7eÀ-ÖØ-öø-įĴ-ňŊ-ž]+")
_PARTS = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 as it is, the other bytes from U+0100 on."""
    same = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in same]
    return {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes UTF-8 texts; ids come as one uint32 array per batch with the ends of its texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.direct = self._is_known_kind()
        self._reset()

    def _is_known_kind(self) -> bool:
        """Whether the shortcut gives the library's ids; checked on words of every kind it takes."""
        probe = ["the", "THE", "don't", "it's", "a1b22", "x_y", "...", "été", "ÀÉÎ", "ñandú,", "Straße", "(a)-[b]", "naïve's", "ŒUVRE"]
        return all(self._shortcut(w) == self._library(w) for w in probe)

    def _reset(self) -> None:
        """Forgets all words."""
        self.index: dict[int, int] = {}  # hash of a word: its number
        self.parts: dict[str, list[int] | None] = {}
        self.flat, self.stops = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _library(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _merged(self, part: str) -> list[int]:
        seen = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(seen)]

    def _shortcut(self, word: str) -> list[int]:
        return [i for part in _PARTS.findall(word.lower()) for i in self._merged(part)]

    def _learn(self, keys: list[int], words: list[bytes]) -> None:
        """Encodes words that were not met before, all at once."""
        joined = b"\n".join(words).decode("utf-8", "replace")
        if not (self.direct and "<|" not in joined and _PLAIN.fullmatch(joined)):
            texts = joined.split("\n")
            plain = [self.direct and "<|" not in t and _PLAIN.fullmatch(t) is not None for t in texts]
            odd = [k for k, p in enumerate(plain) if not p]
            self._add([keys[k] for k in odd], [self._library(texts[k]) for k in odd])
            keys = [w for w, p in zip(keys, plain) if p]
            joined = "\n".join(t for t, p in zip(texts, plain) if p)
        if not keys:
            return
        parts, known = _PARTS.findall(joined.lower()), self.parts
        for part in set(parts).difference(known):
            known[part] = self._merged(part)
        known["\n"] = None
        found, ids = [], []
        for part in map(known.__getitem__, parts):
            if part is None:
                found.append(ids)
                ids = []
            else:
                ids = ids + part if ids else part
        found.append(ids)
        self._add(keys, found)

    def _add(self, keys: list[int], ids: list[list[int]]) -> None:
        self.index.update(zip(keys, range(len(self.index), len(self.index) + len(keys))))
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        self.stops = np.concatenate([self.stops, self.stops[-1] + np.cumsum(many)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, many.sum())])

    def encode(self, texts: list[bytes], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text k has ids[bounds[k]:bounds[k + 1]], with ``end`` as its last id if given."""
        gc.disable()  # a large dictionary and no cycles: each collection would walk all of it for nothing
        try:
            return self._encode(texts, end)
        finally:
            gc.enable()

    def _encode(self, texts: list[bytes], end: int | None) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > MAX_WORDS:
            self._reset()
        words = wordscan.scan(texts)
        code, distinct = pd.factorize(words.hash)
        number = np.fromiter(map(self.index.get, distinct.tolist(), repeat(-1)), np.int64, len(distinct))
        if len(new := np.flatnonzero(number < 0)):
            # Codes count up as words appear: a word is first met where the highest code so far rises.
            first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))[new]
            spans = zip(words.start[first].tolist(), words.stop[first].tolist())
            self._learn(distinct[new].tolist(), [words.data[a:b] for a, b in spans])
            number[new] = np.fromiter(map(self.index.__getitem__, distinct[new].tolist()), np.int64, len(new))
        at = number[code]
        begin, many = self.stops[at], self.stops[at + 1] - self.stops[at]
        ids = self.flat[wordscan.gather(begin, many)]
        ends = np.concatenate([[0], np.cumsum(many)])[words.bounds[1:]]
        if end is not None:
            ids = np.insert(ids, ends, np.uint32(end))
            ends = ends + np.arange(1, len(texts) + 1)
        return ids, np.concatenate([[0], ends]).astype(np.int64)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per worker process and vocabulary."""
    return WordEncoder(path)


def in_chunks(texts: list[bytes], most: int = 1_000_000):
    """Ranges of texts with some ``most`` bytes each; a longer text is a range by itself."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if k > start and held + len(t) > most:
            yield start, k
            start, held = k, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)


def text_chunks(column, most: int = 1_000_000):
    """(a, b, UTF-8 texts a..b) of an Arrow string column in pieces as ``in_chunks`` makes them, NULL as empty; only one
    piece at a time is copied out of the column."""
    import pyarrow as pa

    data = column.cast(pa.large_binary())
    ends = np.frombuffer(data.buffers()[1], np.int64)[data.offset:data.offset + len(data) + 1]
    start = 0
    while start < len(data):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield start, stop, [b or b"" for b in data.slice(start, stop - start).to_pylist()]
        start = stop


def raw(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column, NULL as empty."""
    import pyarrow as pa

    return [b or b"" for b in column.cast(pa.large_binary()).to_pylist()]
