"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class). Classes are the most frequent words by
themselves, the end of a text, and the other words by a hash of their last two bytes. The class model is
log-linear over hashed features of the words before: their classes, the last word, the one before
it (a skip), and the last two together. P(word | class) is the smoothed relative frequency in the class.

Training is by rounds over disjoint parts of the training texts: each task takes the current weights,
updates them over its texts in small batches and returns the change per feature row; changes are added
up by row across the cluster and averaged. Weights start at the class frequencies, so an untrained model equals them.

Counts of all words stay in a table. Only the most frequent ones, a bounded number, go to the executors; all
others are looked up by a join on the word's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.llm import wordscan
from funnelworks.llm.tokens import in_chunks, raw
from funnelworks.sources.storage import materialise

END = np.uint64(0x5851F42D4C957F2D)  # stands for the end of a text
CHUNK = 1_000_000


@dataclass(frozen=True)
class Shape:
    own: int = 23  # words with a class of their own
    suffixes: int = 40  # classes of other words
    head: int = 1 << 17  # most frequent words, whose counts executors hold
    word_rows: int = 1 << 12
    pair_rows: int = 1 << 13
    rounds: int = 3
    batch: int = 8192
    rate: float = 0.7

    @property
    def classes(self) -> int:  # the end is class 0
        return 1 + self.own + self.suffixes

    @property
    def offsets(self) -> tuple[int, ...]:
        """First rows of the features: class before, class two before, both, word before, word two before, both words; bias last."""
        c = self.classes + 1  # one more for what lies before a text
        sizes = (c, c, c * c, self.word_rows, self.word_rows, self.pair_rows, 1)
        return tuple(int(x) for x in np.cumsum((0, *sizes)))


@dataclass
class Model:
    shape: Shape
    n: int  # training tokens
    v: int  # distinct ones
    head_hash: np.ndarray  # sorted
    head_count: np.ndarray
    own_hash: np.ndarray  # sorted
    own_class: np.ndarray
    log_class: np.ndarray  # log10 of each class's denominator
    weights: np.ndarray


def token_arrays(texts: list[bytes], shape: Shape) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, suffix class from 1 + own on, bounds per text) of the folded words, each text with its end."""
    words = wordscan.scan(texts, fold=True)
    data = np.frombuffer(words.data, np.uint8)
    last = data[words.stop - 1].astype(np.int64)
    before = np.where(words.stop - words.start > 1, data[np.maximum(words.stop - 2, 0)], 0).astype(np.int64)
    last, before = (np.where((x >= 65) & (x <= 90), x + 32, x) for x in (last, before))
    suffix = wordscan.mix((before * 256 + last).astype(np.uint64)) % np.uint64(shape.suffixes)
    at = words.bounds[1:]
    h = np.insert(words.hash, at, END)
    s = np.insert(suffix.astype(np.int64) + 1 + shape.own, at, 0)
    return h, s, words.bounds + np.arange(len(words.bounds))


def count_tokens(texts: DataFrame, shape: Shape) -> DataFrame:
    """(h, s, c): hash, suffix class and count of every token of column ``t``. Tasks add up before they send."""

    def flush(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).groupby(["h", "s"], sort=False, as_index=False)["c"].sum()

    def batches(it: Iterator) -> Iterator:
        held, size = [], 0
        for batch in it:
            texts = raw(batch.column("t"))
            for a, b in in_chunks(texts):
                h, s, _ = token_arrays(texts[a:b], shape)
                code, distinct = pd.factorize(h)
                first = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1))
                held.append(pd.DataFrame({"h": distinct.view(np.int64), "s": s[first], "c": np.bincount(code)}))
                size += len(distinct)
                if size > 1_500_000:
                    held = [flush(held)]
                    size = len(held[0])
                    if size > 1_000_000:
                        yield pa.RecordBatch.from_pandas(held[0], preserve_index=False)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pandas(flush(held), preserve_index=False)

    return texts.mapInArrow(batches, "h bigint, s bigint, c bigint").groupBy("h", "s").agg(F.sum("c").alias("c"))


def class_of(h: np.ndarray, suffix: np.ndarray, own_hash: np.ndarray, own_class: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(own_hash, h), len(own_hash) - 1)
    return np.where(own_hash[at] == h, own_class[at], suffix) if len(own_hash) else suffix


def features(h: np.ndarray, cls: np.ndarray, bounds: np.ndarray, shape: Shape) -> np.ndarray:
    """Rows of the weights that each token's context switches on, seven columns, bias last."""
    n, none = len(h), shape.classes
    place = np.arange(n) - np.repeat(bounds[:-1], np.diff(bounds))

    def back(x: np.ndarray, k: int, fill: int) -> np.ndarray:
        out = np.full(n, fill, x.dtype)
        out[k:] = x[:-k] if k <= n else out[k:]
        out[place < k] = fill
        return out

    c1, c2, h1, h2 = back(cls, 1, none), back(cls, 2, none), back(h, 1, 0), back(h, 2, 0)
    o = shape.offsets
    pair = wordscan.mix(h1 * np.uint64(3) + wordscan.mix(h2))
    rows = (c1, c2, c1 * (none + 1) + c2, (h1 >> np.uint64(7)) % np.uint64(shape.word_rows),
            (h2 >> np.uint64(7)) % np.uint64(shape.word_rows), pair % np.uint64(shape.pair_rows), np.zeros(n, np.int64))
    return np.stack([r.astype(np.int32) + np.int32(k) for r, k in zip(rows, o)], axis=1)


def class_probabilities(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Softmax of the summed weights; sums beyond +-80, which single precision could not hold as powers, count as that."""
    z = np.take(weights, rows[:, 0], axis=0)
    part = np.empty_like(z)
    for k in range(1, rows.shape[1]):
        z += np.take(weights, rows[:, k], axis=0, out=part, mode="clip")
    np.clip(z, -80, 80, out=z)
    np.exp(z, out=z)
    z *= (1 / np.einsum("ij->i", z))[:, None]  # no threads of a matrix library within a task
    return z


def sums_of(r: np.ndarray, g: np.ndarray, many: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct numbers, rows of ``g`` added up per number, how many each): ``r`` from 0, and short for a short table,
    since numpy sorts short numbers by counting."""
    order = np.argsort(r, kind="stable")
    r = r[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    n = np.diff(np.append(first, len(r))) if many is None else np.add.reduceat(many[order], first)
    return r[first].astype(np.int64), np.add.reduceat(np.take(g, order, axis=0), first, axis=0), n


def update(weights: np.ndarray, rows: np.ndarray, cls: np.ndarray, shape: Shape) -> None:
    """One step up the gradient of the log likelihood; each row moves by the mean over its occurrences, damped where few."""
    g = class_probabilities(weights, rows)
    np.negative(g, out=g)
    g[np.arange(len(cls)), cls] += 1
    o, step = shape.offsets, np.float32(8 * shape.rate / rows.shape[1])

    def move(k: int, r: np.ndarray, total: np.ndarray, many: np.ndarray) -> None:
        weights[r + o[k]] += total * (step / (many.astype(np.float32) + 20))[:, None]

    for k in range(2, rows.shape[1] - 1):
        r = rows[:, k] - o[k]
        r, total, many = sums_of(r.astype(np.uint16) if o[k + 1] - o[k] <= 1 << 16 else r, g)
        if k == 2:  # both classes: their sums add up to those of each class
            c1, c2 = np.divmod(r, shape.classes + 1)
            for j, c in enumerate((c1, c2)):
                move(j, *sums_of(c, total, many))
            every = total.sum(axis=0, keepdims=True)  # the bias is on everywhere
        move(k, r, total, many)
    move(rows.shape[1] - 1, np.zeros(1, np.int64), every, np.array([len(g)]))


def train_round(texts: DataFrame, model: Model) -> np.ndarray:
    """The weights after one round over ``texts`` (t)."""
    shape, spark = model.shape, texts.sparkSession
    shared = spark.sparkContext.broadcast((model.weights, model.own_hash, model.own_class))
    block = 256  # weight rows to a row of the result

    def local(it: Iterator) -> Iterator:
        start, own_hash, own_class = shared.value
        weights, tokens = start.copy(), 0
        for batch in it:
            texts = raw(batch.column("t"))
            for a, b in in_chunks(texts, CHUNK):
                h, s, bounds = token_arrays(texts[a:b], shape)
                cls = class_of(h, s, own_hash, own_class)
                rows = features(h, cls, bounds, shape)
                tokens += len(h)
                for k in range(0, len(h), shape.batch):
                    update(weights, rows[k:k + shape.batch], cls[k:k + shape.batch], shape)
        if tokens:
            change = (weights - start) * np.float32(tokens)
            for k in range(0, len(change), block):
                part = change[k:k + block]
                if part.any():
                    yield pa.RecordBatch.from_arrays([pa.array([k // block]), pa.array([tokens]), pa.array([part.tobytes()])], ["k", "n", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([tokens]), pa.array([b""])], ["k", "n", "c"])

    def add(it: Iterator) -> Iterator:
        sums: dict[int, np.ndarray] = {}
        tokens: dict[int, int] = {}
        for batch in it:
            for k, n, c in zip(*(batch.column(x).to_pylist() for x in ("k", "n", "c"))):
                tokens[k] = tokens.get(k, 0) + n
                sums[k] = sums.get(k, 0) + np.frombuffer(c, np.float32)
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array([tokens[k] for k in keys], pa.int64()),
            pa.array([np.asarray(sums[k], np.float32).tobytes() for k in keys], pa.binary())], ["k", "n", "c"])

    kind = "k bigint, n bigint, c binary"
    changes = texts.mapInArrow(local, kind).repartition("k").mapInArrow(add, kind).collect()  # one row per block of weights
    total = sum(r["n"] for r in changes if r["k"] == -1)
    weights = model.weights.copy()
    for r in changes:
        if r["k"] >= 0:
            c = np.frombuffer(r["c"], np.float32).reshape(-1, shape.classes)
            weights[r["k"] * block:r["k"] * block + len(c)] += c / np.float32(max(total, 1))
    return weights


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """(h, s, c) of the most frequent words, at most ``most``. Words of one count, and large counts within one part in 64 of a
    power of two, are all in or all out, so a histogram of some thousand rows finds the cut."""
    c = F.col("c")
    grade = F.when(c < 1024, c).otherwise(1024 + F.floor(F.log2(c / 1024) * 64)).cast("bigint")
    cut, held = 1, 0
    for r in sorted(counts.groupBy(grade.alias("g")).count().collect(), key=lambda r: -r["g"]):
        held += r["count"]
        if held > most:
            cut = r["g"] + 1
            break
    return counts.filter(grade >= cut).select("h", "s", "c")


def fit(texts: DataFrame, shape: Shape = Shape()) -> tuple[Model, DataFrame]:
    """The model of texts (t) and the table of all token counts (h, c)."""
    counts = materialise(count_tokens(texts, shape), "token-counts")
    sums = counts.groupBy("s").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect()  # a row per class
    per_class = np.zeros((shape.classes, 2))
    for r in sums:
        per_class[r["s"]] = r["c"], r["v"]
    n, v = (int(x) for x in per_class.sum(axis=0))
    head = pd.DataFrame(frequent(counts, shape.head).collect(), columns=["h", "s", "c"]).sort_values(["c", "h"], ascending=[False, True], ignore_index=True)
    own = head[head["s"] > 0].head(shape.own).reset_index(drop=True)
    for k, r in own.iterrows():
        per_class[r["s"]] -= r["c"], 1
        per_class[1 + k] = r["c"], 1
    head_hash, own_hash = (np.asarray(x["h"], np.int64).view(np.uint64) for x in (head, own))
    order, own_order = np.argsort(head_hash), np.argsort(own_hash)
    weights = np.zeros((shape.offsets[-1], shape.classes), np.float32)
    weights[-1] = np.log((per_class[:, 0] + 0.5) / (n + 0.5 * shape.classes))
    model = Model(shape, n, v, head_hash[order], np.asarray(head["c"], np.int64)[order], own_hash[own_order], (own_order + 1).astype(np.int64),
                  np.log10(per_class[:, 0] + 0.5 * (per_class[:, 1] + 1)), weights)
    for k in range(shape.rounds):
        part = texts.filter(F.pmod(F.xxhash64("t"), F.lit(shape.rounds)) == k)
        model.weights = train_round(part, model)
    return model, counts.select("h", "c")


def in_head(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(whether a word is among the frequent ones, log10 of its smoothed count there and 0 elsewhere)."""
    if not len(m.head_hash):
        return np.zeros(len(h), bool), np.zeros(len(h))
    at = np.minimum(np.searchsorted(m.head_hash, h), len(m.head_hash) - 1)
    known = m.head_hash[at] == h
    return known, np.where(known, np.log10(m.head_count[at] + 0.5), 0.0)


def score(docs: DataFrame, model: Model, counts: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score), one row per document row; NULL text is empty: the end alone.

    ``base_score`` is the smoothed unigram model's log10 probability, ``score`` the class-factored model's.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), C.name(id_column).alias("id"), C.name(text).cast("string").alias("t"))
    kind = docs.schema[id_column].dataType.simpleString()

    def batches(it: Iterator) -> Iterator:
        m = shared.value
        for batch in it:
            texts = raw(batch.column("t"))
            for a, b in in_chunks(texts, CHUNK):
                h, s, bounds = token_arrays(texts[a:b], m.shape)
                cls = class_of(h, s, m.own_hash, m.own_class)
                f = features(h, cls, bounds, m.shape)
                logp = np.empty(len(h))
                for k in range(0, len(h), m.shape.batch):
                    p = class_probabilities(m.weights, f[k:k + m.shape.batch])
                    logp[k:k + m.shape.batch] = np.log10(np.maximum(p[np.arange(len(p)), cls[k:k + m.shape.batch]], 1e-30))
                code, distinct = pd.factorize(h)  # each distinct word is looked up once
                known, frequency = in_head(m, distinct)
                known, frequency = known[code], frequency[code]
                begin = bounds[:-1]
                rest = np.flatnonzero(~known)
                cut = np.searchsorted(rest, bounds)
                yield pa.RecordBatch.from_arrays([
                    batch.column("row").slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(np.diff(bounds)),
                    pa.array(np.add.reduceat(known.astype(np.int64), begin)), pa.array(np.add.reduceat(frequency, begin)),
                    pa.array(np.add.reduceat(logp - m.log_class[cls], begin)),
                    pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[rest].view(np.int64)))],
                    ["row", "id", "n_tokens", "known", "frequency", "classes", "rest"])

    parts = materialise(rows.mapInArrow(batches, (
        f"row bigint, id {kind}, n_tokens bigint, known bigint, frequency double, classes double, rest array<bigint>")), "scored")
    rare = parts.select("row", F.explode("rest").alias("h"))
    found = rare.join(counts, "h", "left")
    c = F.coalesce("c", F.lit(0))
    found = found.groupBy("row").agg(F.sum(F.when(c > 0, 1).otherwise(0)).alias("more"), F.sum(F.log10(c + 0.5)).alias("add"))
    joined = parts.drop("rest").join(found, "row", "left")
    seen = F.col("frequency") + F.coalesce("add", F.lit(0.0))
    every = float(np.log10(model.n + 0.5 * (model.v + 1)))
    return joined.select("id", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                         (seen - F.col("n_tokens") * every).alias("base_score"), (seen + F.col("classes")).alias("score"))


def held_out(id_column: str) -> Column:
    """One fifth of the documents, by their ids."""
    return F.coalesce(F.crc32(C.name(id_column).cast("string")) % 5 == 1, F.lit(False))
