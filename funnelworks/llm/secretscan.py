"""Secret scan with inferred grammars.

Plain patterns find credentials by their context or prefix. From a bounded sample of these labelled
credentials a probabilistic automaton is learnt per kind: the prefix tree of their character classes
is folded by merging states whose frequencies are statistically compatible. One more automaton is
learnt from ordinary words, tokens of all texts that are too short for a credential, so that bare keys
never teach it, however many there are. Every token of a text that could be a credential, of any
characters, is then scored by how much likelier a credential's format is than an ordinary word's, and
likely ones are added as spans.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.sources.storage import materialise

# Fixed values of the plain patterns: kinds in order, least lengths.
KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_WORDS = ("passw", "secret", "token", "api")  # one of them is in every text with an assignment
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
# Runs of credential characters. A dot joins parts, as in signed tokens; not at the end of a run, as in prose, and no part
# of less than four characters, as in network addresses.
_CANDIDATE = re.compile(r"(?=[A-Za-z0-9+/_.=-]{12})[A-Za-z0-9+/_=-]+(?:\.[A-Za-z0-9+/_=-]{4,})*")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]+")
_SHORTEST = 12  # characters of a credential and of a candidate


@dataclass(frozen=True)
class Settings:
    """``sample`` labelled strings per kind, those of the least hashes, train an automaton, each as a whole: their
    first ``tree`` characters as the tree that is folded, so that its size is bounded, and the others by following
    the folded states. ``alpha`` is the error of the compatibility test. A candidate counts if its log likelihood ratio
    is at least ``least`` in all and ``least_each`` per character."""

    sample: int = 400
    tree: int = 256
    alpha: float = 0.05
    least: float = 12.0
    least_each: float = 0.5


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, secret) of the plain patterns, per kind leftmost and not overlapping."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), m.end(), 0, m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2, m[0]) for m in _HEX.finditer(text)]
    return sorted(out)


def _outside(start: int, end: int, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a stretch that no span covers, if they are long enough."""
    out = []
    for a, b in [*sorted(x for x in spans if x[0] < end and start < x[1]), (end, end)]:
        if a - start >= _SHORTEST:
            out.append((start, a))
        start = max(start, b)
    return out


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(start, end, parts) of every run of credential characters that isn't all in plain spans. An assignment's
    value is whole, so a run ends there; hexadecimal or access keys may be the middle of a longer key, so such a
    run counts as a whole and ``parts`` are what lies outside of them."""
    for m in _CANDIDATE.finditer(text):
        if m.end() - m.start() < _SHORTEST:
            continue
        near = [x for x in taken if x[0] < m.end() and m.start() < x[1]]
        if not near:
            yield m.start(), m.end(), []
            continue
        inner = [(a, b) for a, b, k, _ in near if k]
        for a, b in _outside(m.start(), m.end(), [(a, b) for a, b, k, _ in near if not k]):
            if not any(x <= a and b <= y for x, y in inner):
                yield a, b, _outside(a, b, inner)


def ordinary(text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[str]:
    """Tokens that cannot be credentials: too short for one and outside of the plain spans."""
    for m in _TOKEN.finditer(text) if taken else ():
        if len(m[0]) < _SHORTEST and not any(a < m.end() and m.start() < b for a, b, _, _ in taken):
            yield m[0]
    if not taken:
        yield from (w for w in set(_TOKEN.findall(text)) if len(w) < _SHORTEST)


# Classes of characters and how many characters each has.
_CLASS = {c: "0" for c in "0123456789"} | {c: "f" for c in "abcdef"} | {c: "z" for c in "ghijklmnopqrstuvwxyz"} | {c: "A" for c in map(chr, range(65, 91))}
_MANY = {"0": 10, "f": 6, "z": 20, "A": 26}


def classes(s: str) -> str:
    return "".join(_CLASS.get(c, c) for c in s)


class Automaton:
    """States with counts of arrivals, of ends and of moves by class; folded from a prefix tree."""

    def __init__(self, strings: list[str], tree: int | None = None):
        """The tree of the first ``tree`` characters; an end counts where a string ends, not at that depth."""
        self.longer = [] if tree is None else [s for s in strings if len(s) > tree]
        self.tree = tree
        self.steps: dict[tuple[int, str], tuple[float, int]] = {}  # of states and candidate characters met so far
        self.moves: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [defaultdict(int)]
        self.ends = [0]
        for s in strings:
            at = 0
            for c in s[:tree]:
                self.count[at][c] += 1
                if c not in self.moves[at]:
                    self.moves[at][c] = len(self.moves)
                    self.moves.append({})
                    self.count.append(defaultdict(int))
                    self.ends.append(0)
                at = self.moves[at][c]
            if tree is None or len(s) <= tree:
                self.ends[at] += 1

    def seen(self, q: int) -> int:
        return self.ends[q] + sum(self.count[q].values())

    def _alike(self, f1: int, n1: int, f2: int, n2: int, bound: float) -> bool:
        """Whether two frequencies may come from one probability, by Hoeffding's bound."""
        return abs(f1 / n1 - f2 / n2) < bound * (n1 ** -0.5 + n2 ** -0.5) if n1 and n2 else True

    def compatible(self, a: int, b: int, bound: float) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = self.seen(a), self.seen(b)
            if not self._alike(self.ends[a], n, self.ends[b], m, bound):
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if not self._alike(self.count[a].get(c, 0), n, self.count[b].get(c, 0), m, bound):
                    return False
                if c in self.moves[a] and c in self.moves[b]:
                    todo.append((self.moves[a][c], self.moves[b][c]))
        return True

    def merge(self, a: int, b: int) -> None:
        """Folds the tree below ``b`` into ``a``."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
                if c in self.moves[a]:
                    todo.append((self.moves[a][c], self.moves[b][c]))
                else:
                    self.moves[a][c] = self.moves[b][c]

    def fold(self, alpha: float) -> Automaton:
        """Merges every state into the first compatible one that is settled, in order of depth."""
        bound = (0.5 * np.log(2 / alpha)) ** 0.5
        settled, fresh = [0], [(0, c) for c in sorted(self.moves[0])]
        while fresh:
            parent, c = fresh.pop(0)
            q = self.moves[parent][c]
            if q in settled:
                continue
            to = next((r for r in settled if self.compatible(r, q, bound)), None)
            if to is None:
                settled.append(q)
                fresh += [(q, x) for x in sorted(self.moves[q])]
            else:
                self.moves[parent][c] = to
                self.merge(to, q)
                fresh += [(to, x) for x in sorted(self.moves[to]) if (to, x) not in fresh and self.moves[to][x] not in settled]
        for s in self.longer:
            self.follow(s)
        return self

    def follow(self, s: str) -> None:
        """Counts what lies beyond the tree along the folded states; an unseen move leads to the first state."""
        at = 0
        for i, c in enumerate(s):
            if i >= self.tree:
                self.count[at][c] += 1
            at = self.moves[at].get(c, 0)
        self.ends[at] += 1

    def log_likelihood(self, s: str) -> float:
        """Natural log of the probability of a string; unseen moves get half a count each."""
        at, total = 0, 0.0
        for c in s:
            step = self.steps.get((at, c))
            if step is None:
                k = classes(c)
                gain = math.log((self.count[at].get(k, 0) + 0.5) / (self.seen(at) + 6)) - math.log(_MANY.get(k, 1))
                step = self.steps[at, c] = (gain, self.moves[at].get(k, 0))
            total += step[0]
            at = step[1]
        return total


@dataclass
class Model:
    kinds: list[Automaton]
    ordinary: Automaton
    settings: Settings

    def is_secret(self, s: str) -> bool:
        gain = max((a.log_likelihood(s) for a in self.kinds), default=-np.inf) - self.ordinary.log_likelihood(s)
        return gain >= self.settings.least and gain >= self.settings.least_each * len(s)

    def spans(self, text: str, taken: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int]]:
        """Candidates that are likely credentials; of one that isn't, its parts that are."""
        for a, b, parts in candidates(text, taken):
            if self.is_secret(text[a:b]):
                yield a, b
            else:
                yield from (x for x in parts if x != (a, b) and self.is_secret(text[x[0]:x[1]]))


def learn(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> Model:
    """Automata from the distinct credentials that the plain patterns label, at most ``sample`` a kind, and from as
    many distinct ordinary words: those of the least hashes in all texts, of which each task sends its own least."""

    def batches(it: Iterator) -> Iterator:
        words: dict[str, str] = {}
        top = ""  # once there are enough words, the greatest hash among them
        for batch in it:
            kind, secret, fresh = [], [], set()
            for t in batch.column("t").to_pylist():
                taken = base_spans(t or "")
                kind += [k for _, _, k, _ in taken]
                secret += [s for _, _, _, s in taken]
                fresh.update(ordinary(t or "", taken))
            words |= {w: h for w in fresh if (h := hashlib.md5(w.encode()).hexdigest()) < top or not top}
            words = dict(sorted(words.items(), key=lambda x: x[1])[:settings.sample])
            top = max(words.values()) if len(words) == settings.sample else ""
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(secret, pa.string())], ["kind", "secret"])
        yield pa.RecordBatch.from_arrays([pa.array([3] * len(words), pa.int32()), pa.array(list(words), pa.string())], ["kind", "secret"])

    found = docs.select(C.name(text).cast("string").alias("t")).mapInArrow(batches, "kind int, secret string")
    found = materialise(found.distinct(), "labelled")
    strings = []
    for k in range(4):  # the last are the ordinary words
        rows = found.filter(F.col("kind") == k).orderBy(F.md5("secret"), "secret").limit(settings.sample).collect()
        strings.append([classes(r["secret"]) for r in rows])
    words = strings.pop()
    return Model([Automaton(s, settings.tree).fold(settings.alpha) for s in strings if s], Automaton(words).fold(settings.alpha), settings)


def scan(docs: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, spans: kind, start, end in code points, by start and kind), one row per document row. NULL text has none."""
    kind = docs.schema[id_column].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # states are bounded by the sample

    def batches(it: Iterator) -> Iterator:
        model = shared.value
        for batch in it:
            out = []
            for t in batch.column("t").to_pylist():
                taken = base_spans(t or "")
                spans = [(a, k, b) for a, b, k, _ in taken]
                spans += [(a, 3, b) for a, b in model.spans(t or "", taken)]
                out.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(spans)])
            spans = pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), spans], ["id", "spans"])

    rows = docs.select(C.name(id_column).alias("id"), C.name(text).cast("string").alias("t"))
    return rows.mapInArrow(batches, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
