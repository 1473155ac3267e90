"""Removal of repeated passages: whether the longest previous factor of a start reaches the limit.

A byte goes if a string of ``limit`` bytes over it also starts earlier in the corpus. Only that is needed of a
longest previous factor, so no lengths, LCP or smaller-position arrays are computed: a start is settled by the smallest
position among the strings equal to it in ``limit`` bytes. To sort few suffixes instead of all:

1. Every window of ``limit`` bytes is dealt to its anchor, the least hash among its k-grams. Windows with one anchor
   lie side by side, and equal windows have equal anchors. One row per anchor, about one per 35 bytes, carries the hash
   of the k-gram, the hash of the whole stretch of its windows and the position.
2. Rows of one k-gram meet in order of position. A stretch that was there before is repeated whole; a k-gram that is
   nowhere else has no repeated window. What is left are k-grams with several stretches: edges of copies.
3. Only for those the bytes are fetched. Their windows are sorted as suffixes within the k-gram, and the smallest
   position of each run of equal windows gives the earlier matches. K-grams with very many stretches, such as
   an edge of a line of every page, take the same test by window hash with map-side minima instead, spread over all tasks.
4. The repeated stretches are merged per document and cut out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.llm import wordscan
from funnelworks.llm.decontaminate import bit_table, in_table
from funnelworks.llm.tokens import in_chunks, raw
from funnelworks.sources.storage import materialise

LIMIT, GRAM = 100, 32
CHUNK = 2_000_000
CROWD = 4096  # stretches of one k-gram from which on they are told apart by hashes over all tasks
NO_ID = -(1 << 63)
# A position within an id: 17 bits of the text's hash, 32 of the start, 7 each for anchor and length of a stretch.
# Rows of one id are texts in the order of those bits.
_TEXT, _START, _ANCHOR = 46, 14, 7


def stretches(texts: list[bytes], limit: int = LIMIT, gram: int = GRAM):
    """(text, first window, last window, anchor, k-gram hash, stretch hash) for all anchors; offsets within their text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(texts) + bytes(limit), np.uint8)
    sums = wordscan.prefix_sums(data)
    grams = (sums[gram:] - sums[:-gram]) * wordscan.powers(wordscan._INVERSE, len(sums))[:-gram]
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width, span = limit - gram + 1, 1
    while 2 * span <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < width:
        least = np.minimum(least[:span - width], least[width - span:])
    many = np.maximum(sizes - limit + 1, 0)
    window = wordscan.gather(begin, many)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    first, last = window[at], window[np.append(at[1:], len(window))[:len(at)] - 1]
    text = np.repeat(np.arange(len(texts)), many)[at]
    a = anchor[at]
    return (text, first - begin[text], last - begin[text], a - begin[text], wordscan.mix(grams[a]),
            wordscan.span_hashes(sums, first, last + limit))


def _rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, tk: the bits of the text in its positions, t)."""
    t = C.text_of(text)
    return docs.select(F.coalesce(C.name(id_column).cast("bigint"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(t).bitwiseAND(F.lit(0x1FFFF)).alias("tk"), t.alias("t"))


def _anchor_rows(rows: DataFrame) -> DataFrame:
    def batches(it: Iterator) -> Iterator:
        for batch in it:
            ids, tk, texts = batch.column("id").to_numpy(), batch.column("tk").to_numpy(), raw(batch.column("t"))
            for a, b in in_chunks(texts, CHUNK):
                text, first, last, anchor, gram, stretch = stretches(texts[a:b])
                sub = (tk[a:b][text] << _TEXT) | (first << _START) | ((anchor - first) << _ANCHOR) | (last - first)
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram.view(np.int64)), pa.array((stretch ^ wordscan.mix((sub & ((1 << _START) - 1)).astype(np.uint64))).view(np.int64)),
                    pa.array(ids[a:b][text]), pa.array(sub)], ["gram", "stretch", "id", "sub"])

    return rows.filter(F.octet_length("t") >= LIMIT).mapInArrow(batches, "gram bigint, stretch bigint, id bigint, sub bigint")


def _settled(anchors: DataFrame) -> DataFrame:
    """(id, sub, gram, m): stretches that were there before have m = 0; others whose k-gram has m > 1 stretches are open.

    Rows of a k-gram stream by in order of position; only its distinct stretches are remembered.
    """

    def batches(it: Iterator) -> Iterator:
        held = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("gram", "stretch", "id", "sub")})

        def opened(df):
            m = df.groupby("gram")["sub"].transform("size").to_numpy()
            df = df.assign(m=m)[m > 1]
            return pa.RecordBatch.from_arrays([pa.array(df[c].to_numpy()) for c in ("id", "sub", "gram", "m")], ["id", "sub", "gram", "m"])

        for batch in it:
            # Equal rows of a table have equal positions; they are one document, not a repeat of it.
            df = pd.concat([held, batch.to_pandas()], ignore_index=True).drop_duplicates()
            if df.empty:
                continue
            again = df.duplicated(["gram", "stretch"]).to_numpy()
            seen, df = df[again], df[~again]
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen[c].to_numpy()) for c in ("id", "sub", "gram")] + [pa.array(np.zeros(len(seen), np.int64))], ["id", "sub", "gram", "m"])
            more = (df["gram"] == df["gram"].iloc[-1]).to_numpy()  # this k-gram may go on in the next batch
            yield opened(df[~more])
            held = df[more]
        yield opened(held)

    return anchors.repartition("gram").sortWithinPartitions("gram", "id", "sub").mapInArrow(
        batches, "id bigint, sub bigint, gram bigint, m bigint")


def _near(rows: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose (id, tk) may be among ``wanted``, and the others, by a bit table of fixed size."""
    key = F.xxhash64("id", "tk")
    tested = rows.withColumn("bits", bit_table(wanted.select(key.alias("h")))).withColumn("hit", in_table(F.col("bits"), key)).drop("bits")
    return tested.filter("hit").drop("hit"), tested.filter("NOT hit").drop("hit")


def _open_bytes(rows: DataFrame, open_: DataFrame) -> DataFrame:
    """(gram, id, sub, m, bytes of the stretch) of the open stretches; a document's own stretches meet, at most one per 35 bytes."""
    per_doc = open_.groupBy("id", F.shiftrightunsigned("sub", _TEXT).alias("tk")).agg(F.collect_list(F.struct("gram", "sub", "m")).alias("xs"))
    per_doc = materialise(per_doc, "open-stretches")
    near, _ = _near(rows, per_doc)
    joined = near.join(per_doc, ["id", "tk"]).select("id", "xs", "t")

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            ids, texts, xs = batch.column("id").to_numpy(), raw(batch.column("t")), batch.column("xs")
            flat, ends = xs.flatten(), np.diff(np.asarray(xs.offsets))
            gram, sub, m = (np.asarray(flat.field(c)) for c in ("gram", "sub", "m"))
            row = np.repeat(np.arange(len(ids)), ends)
            start = (sub >> _START) & 0xFFFFFFFF
            stop = start + (sub & ((1 << _ANCHOR) - 1)) + LIMIT
            for k in range(0, len(row), 50_000):
                s = slice(k, k + 50_000)
                cut = [texts[r][a:b] for r, a, b in zip(row[s].tolist(), start[s].tolist(), stop[s].tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(gram[s]), pa.array(ids[row[s]]), pa.array(sub[s]), pa.array(m[s]), pa.array(cut, pa.binary())],
                    ["gram", "id", "sub", "m", "b"])

    return joined.mapInArrow(batches, "gram bigint, id bigint, sub bigint, m bigint, b binary").distinct()


def previous_factor(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Whether each suffix has an earlier one in common: positions ``order`` in suffix order, and
    ``common[k]``, whether suffixes k and k + 1 share the limit. A suffix has an earlier match if the smallest
    position of its run is not its own."""
    run = np.concatenate([[0], np.cumsum(~common)]) if len(order) else np.zeros(0, np.int64)
    starts = np.flatnonzero(np.diff(run, prepend=-1))
    return order > np.minimum.reduceat(order, starts)[run] if len(order) else np.zeros(0, bool)


def _repeats(start: np.ndarray, windows: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of side-by-side windows of one row: (row, first byte, end)."""
    new = np.ones(len(windows), bool)
    new[1:] = (row[1:] != row[:-1]) | (windows[1:] != windows[:-1] + 1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(windows))[:len(at)] - 1
    return row[at], start[row[at]] + windows[at], start[row[at]] + windows[last] + LIMIT


SPANS = "id bigint, tk bigint, start bigint, end bigint"


def _spans_batch(ids: np.ndarray, sub: np.ndarray, row: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(sub[row] >> _TEXT), pa.array(first), pa.array(end)], ["id", "tk", "start", "end"])


def _by_suffix_order(open_: DataFrame) -> DataFrame:
    """Repeated spans of stretches whose k-grams have few: their windows are sorted as suffixes."""

    def repeated(gram: np.ndarray, ids: np.ndarray, sub: np.ndarray, cut: list[bytes]) -> pa.RecordBatch:
        many = np.fromiter(map(len, cut), np.int64, len(cut)) - LIMIT + 1
        data = np.frombuffer(b"".join(cut), np.uint8)
        begin = np.cumsum(many + LIMIT - 1) - (many + LIMIT - 1)
        row = np.repeat(np.arange(len(cut)), many)
        at = wordscan.gather(begin, many)
        keyed = np.empty((len(at), 8 + LIMIT), np.uint8)
        keyed[:, :8] = gram.astype(">i8").view(np.uint8).reshape(-1, 8)[row]
        keyed[:, 8:] = np.lib.stride_tricks.sliding_window_view(data, LIMIT)[at]
        suffix = keyed.view(f"S{8 + LIMIT}").reshape(-1)
        order = np.argsort(suffix, kind="stable")  # windows are in order of position, and so their numbers are
        common = suffix[order[1:]] == suffix[order[:-1]]
        hit = np.sort(order[previous_factor(order, common)])
        return _spans_batch(ids, sub, *_repeats((sub >> _START) & 0xFFFFFFFF, (at - begin[row])[hit], row[hit]))

    def batches(it: Iterator) -> Iterator:
        held: list = [np.zeros(0, np.int64)] * 3 + [[]]
        for batch in it:
            now = [batch.column(c).to_numpy() for c in ("gram", "id", "sub")]
            gram, ids, sub = (np.concatenate([h, n]) for h, n in zip(held, now))
            cut = held[3] + batch.column("b").to_pylist()
            whole = int(np.searchsorted(gram, gram[-1]))  # the last k-gram may go on in the next batch
            edges = np.flatnonzero(np.diff(gram[:whole], prepend=gram[0] - 1)) if whole else []
            done = 0
            for e in [*(x for x in edges if x), whole]:  # some thousand stretches at a time, whole k-grams each
                if e - done >= 4000 or e == whole and e > done:
                    yield repeated(gram[done:e], ids[done:e], sub[done:e], cut[done:e])
                    done = e
            held = [gram[whole:], ids[whole:], sub[whole:], cut[whole:]]
        if len(held[0]):
            yield repeated(*held)

    return open_.repartition("gram").sortWithinPartitions("gram", "id", "sub").select("gram", "id", "sub", "b").mapInArrow(batches, SPANS)


def _by_window_hash(open_: DataFrame) -> DataFrame:
    """The same for crowded k-grams: every window's hash with its position, minima map-side, then the later ones."""

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            for k in range(0, batch.num_rows, 4000):
                part = batch.slice(k, 4000)
                cut, sub = part.column("b").to_pylist(), part.column("sub").to_numpy()
                many = np.fromiter(map(len, cut), np.int64, len(cut)) - LIMIT + 1
                begin = np.cumsum(many + LIMIT - 1) - (many + LIMIT - 1)
                sums = wordscan.prefix_sums(np.frombuffer(b"".join(cut), np.uint8))
                row, at = np.repeat(np.arange(len(cut)), many), wordscan.gather(begin, many)
                place = (sub >> _START)[row] + at - begin[row]  # text bits and start
                yield pa.RecordBatch.from_arrays([
                    pa.array(wordscan.span_hashes(sums, at, at + LIMIT).view(np.int64)), pa.array(part.column("id").to_numpy()[row]), pa.array(place)],
                    ["w", "id", "place"])

    windows = open_.select("id", "sub", "b").mapInArrow(batches, "w bigint, id bigint, place bigint")
    windows = materialise(windows, "crowded-windows")
    first = windows.groupBy("w").agg(F.min(F.struct("id", "place")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("w", "f")
    later = windows.join(first, "w").filter(F.struct("id", "place") > F.col("f"))
    start = F.col("place").bitwiseAND(F.lit(0xFFFFFFFF))
    return later.select("id", F.shiftright("place", 32).alias("tk"), start.alias("start"), (start + LIMIT).alias("end"))


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept: remaining bytes), one row per document row.

    NULL text is empty; texts of fewer bytes than the limit lose nothing. A NULL id is smaller than all others.
    Rows of one id come in the order of their texts' hashes; equal rows are one document and lose the same.
    """
    rows = _rows(docs, id_column, text)
    settled = materialise(_settled(_anchor_rows(rows)), "settled")
    start = F.shiftright("sub", _START).bitwiseAND(F.lit(0xFFFFFFFF))
    before = settled.filter("m = 0").select(
        "id", F.shiftright("sub", _TEXT).alias("tk"), start.alias("start"),
        (start + F.col("sub").bitwiseAND(F.lit((1 << _ANCHOR) - 1)) + LIMIT).alias("end"))
    own = settled.filter("m > 1").distinct()
    bytes_ = materialise(_open_bytes(rows, own), "open-bytes")
    spans = before.unionByName(_by_suffix_order(bytes_.filter(F.col("m") <= CROWD))).unionByName(_by_window_hash(bytes_.filter(F.col("m") > CROWD)))
    per_doc = materialise(spans.groupBy("id", "tk").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "spans")

    near, far = _near(rows, per_doc)
    near = near.join(per_doc, ["id", "tk"], "left")

    def cut(it: Iterator) -> Iterator:
        for batch in it:
            texts, spans = raw(batch.column("t")), batch.column("spans")
            for a, b in in_chunks(texts):
                out = [_without(texts[k], spans[k]) for k in range(a, b)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a)] + [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    kind = "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"
    zero = F.lit(0).cast("bigint")
    plain = far.select("id", F.octet_length("t").cast("bigint").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.col("t").cast("binary").alias("kept"))
    out = near.select("id", "t", "spans").mapInArrow(cut, kind).unionByName(plain)
    return out.withColumn("id", F.when(F.col("id") != NO_ID, F.col("id")))


def _without(text: bytes, spans: pa.ListScalar) -> tuple[int, int, int, bytes]:
    if not spans.is_valid or not len(spans.values):
        return len(text), 0, 0, text
    start, end = (np.asarray(spans.values.field(c)) for c in ("start", "end"))
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = start[new]
    last = end[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(end) - 1]])]
    kept, at = [], 0
    for a, b in zip(first.tolist(), last.tolist()):
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    out = b"".join(kept)
    return len(text), len(text) - len(out), len(first), out
