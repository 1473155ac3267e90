"""Canonical length-limited Huffman coding of token ids.

1. Documents are tokenised once into a table of 16- or 32-bit ids, and the ids are counted over all of them.
2. From the counts, one per id of the vocabulary at most, package-merge gives code lengths of at most
   ``limit`` bits; canonical codes follow from the lengths, so a code book is a list of lengths.
3. Documents are range-partitioned by id and encoded in independent blocks. A block carries a bit
   offset for every ``STEP``-th id, its documents and how many ids come before it in all.
4. A reader decodes any block by itself: the stretches between checkpoints are decoded side by side,
   one table lookup per id for all of them at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.llm.tokens import encoder, text_chunks
from funnelworks.sources.storage import materialise

STEP = 512  # ids between two checkpoints
BLOCK = 1 << 19  # ids after which a block is closed
LIMIT = 20


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols need codes of more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weight = counts[order].astype(np.float64)
    n, merged, sources = len(order), np.zeros(0), []
    for _ in range(limit):
        both = np.concatenate([weight, merged])
        at = np.argsort(both, kind="stable")
        sources.append(at)
        both = both[at]
        merged = both[:len(both) // 2 * 2].reshape(-1, 2).sum(1)
    # Walk back: of the last list the first 2n - 2 entries count, of each earlier one those its packages hold.
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for at in reversed(sources):
        chosen = at[:take]
        single = chosen < n
        depth[chosen[single]] += 1
        take = 2 * int((~single).sum())
    lengths[order] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    top = int(lengths.max())
    # In units of the longest code each code is the sum of those before it.
    spans = np.uint64(1) << (top - lengths[order].astype(np.int64)).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(spans)[:-1]]).astype(np.uint64)
    codes[order] = starts >> (top - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, bounds: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bits; first byte of each text and the end; bit offset of each id). Text k has ids[bounds[k]:bounds[k + 1]]
    and starts on a full byte, so that coded texts can be laid side by side."""
    size = lengths[ids].astype(np.int64)
    stop = np.concatenate([[0], np.cumsum(size)])
    bits = stop[bounds[1:]] - stop[bounds[:-1]]
    byte = np.concatenate([[0], np.cumsum((bits + 7) // 8)])
    begin = stop[:-1] + np.repeat(byte[:-1] * 8 - stop[bounds[:-1]], np.diff(bounds))
    words = np.zeros(byte[-1] // 8 + 2, np.uint64)
    word, bit = begin >> 6, begin & 63
    value = codes[ids]
    room = 64 - bit - size  # negative if a code goes on in the next word
    high = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    over = room < 0
    if len(ids):  # codes never overlap, so sums are unions
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        words[word[first]] = np.add.reduceat(high, first)
        words[word[over] + 1] += value[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes(), byte, begin


def decode_table(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(bits per lookup, id of each value, length of each value)."""
    top = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (top - lengths[order].astype(np.int64))
    ids, size = np.zeros(1 << top, np.uint32), np.ones(1 << top, np.uint8)
    ids[:spans.sum()], size[:spans.sum()] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return top, ids, size


def decode(bits: bytes, checkpoints: np.ndarray, sizes: np.ndarray, table: tuple[int, np.ndarray, np.ndarray]) -> np.ndarray:
    """The ids of a block of texts of ``sizes`` ids; all stretches between checkpoints advance together."""
    top, ids, size = table
    words = np.frombuffer(bits + bytes(-len(bits) % 8 + 16), ">u8").astype(np.uint64)
    whole, rest = np.divmod(np.asarray(sizes, np.int64), STEP)
    lanes = whole + (rest > 0)
    many = np.full(lanes.sum(), STEP)
    many[(np.cumsum(lanes) - 1)[rest > 0]] = rest[rest > 0]
    order = np.argsort(-many, kind="stable")  # the longest first, so that those still running are a prefix
    running = np.searchsorted(-many[order], -np.arange(many.max(initial=0)), side="left")
    at = np.asarray(checkpoints, np.int64)[order]
    out = np.zeros((len(many), STEP), np.uint32)
    for k, n in enumerate(running):
        at = at[:n]
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        window = (words[word] << bit) | ((words[word + 1] >> (np.uint64(63) - bit)) >> np.uint64(1))
        value = (window >> np.uint64(64 - top)).astype(np.int64)
        out[:n, k] = ids[value]
        at += size[value]
    back = np.empty_like(out)
    back[order] = out
    return back[np.arange(STEP) < many[:, None]]


def tokenised(docs: DataFrame, path: str, id_column: str, text: str, end: int, vocabulary: int) -> DataFrame:
    """(id, ids: little-endian, 2 bytes each if the vocabulary allows); NULL text is empty."""
    import pyarrow as pa

    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    rows = docs.select(C.name(id_column).cast("bigint").alias("id"), C.name(text).cast("string").alias("t"))

    def batches(it: Iterator) -> Iterator:
        for batch in it:
            names = batch.column("id")
            for a, b, texts in text_chunks(batch.column("t")):
                ids, bounds = encoder(path).encode(texts, end)
                small = ids.astype(kind)
                out = [small[s:e].tobytes() for s, e in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays([names.slice(a, b - a), pa.array(out, pa.binary())], ["id", "ids"])

    return rows.mapInArrow(batches, "id bigint, ids binary")


def count_ids(table: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in the table; one row per id at most comes to the driver."""
    import pyarrow as pa

    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"

    def batches(it: Iterator) -> Iterator:
        n = np.zeros(vocabulary, np.int64)
        for batch in it:
            for _, _, texts in text_chunks(batch.column("ids")):
                n += np.bincount(np.frombuffer(b"".join(texts), kind), minlength=vocabulary)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for r in table.select("ids").mapInArrow(batches, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r["token"]] = r["n"]
    return counts


def coded_texts(it: Iterator, lengths: np.ndarray, vocabulary: int) -> Iterator[tuple]:
    """(id, number of token ids, checkpoints: bit offsets in the text's own bits, bits) of rows (id, ids), one by one."""
    kind = "<u2" if vocabulary <= 1 << 16 else "<u4"
    codes = canonical(lengths)
    for batch in it:
        docs = batch.column("id").to_pylist()
        for a, b, texts in text_chunks(batch.column("ids")):
            ids = np.frombuffer(b"".join(texts), kind)
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]) // np.dtype(kind).itemsize
            bits, byte, begin = encode(ids, bounds, lengths, codes)
            for doc, s, e, x, y in zip(docs[a:b], bounds, bounds[1:], byte, byte[1:]):
                yield doc, int(e - s), begin[s:e:STEP] - 8 * x, bits[x:y]


def write_coded(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", end: int = 1,
                vocabulary: int = 49_408) -> tuple[DataFrame, np.ndarray]:
    """Blocks as a written table (file, block, first: ids before it in the file, docs, sizes, checkpoints, bits)
    and the code book.

    Blocks lie in ascending order of document ids, NULL ids first; rows of equal id come in order of their
    token ids' bytes. Documents are put in order before they are coded, so that each is coded once. An empty table
    gives no blocks. A block holds whole documents, so its size is bounded by ``BLOCK`` ids and one document.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    tokens = tokenised(docs, path, id_column, text, end, vocabulary)
    table = materialise(tokens, "token-ids")
    lengths = code_lengths(count_ids(table, vocabulary))
    ranged = table.repartitionByRange("id").sortWithinPartitions("id", "ids")
    book = table.sparkSession.sparkContext.broadcast(lengths)  # one byte per id of the vocabulary
    types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
    names = ["file", "block", "first", "docs", "sizes", "checkpoints", "bits"]

    def batches(it: Iterator) -> Iterator:
        file, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def close():
            docs, sizes, marks, bits = zip(*held)
            bytes_before = np.cumsum([0, *map(len, bits)])
            checkpoints = np.concatenate([m + 8 * o for m, o in zip(marks, bytes_before)])
            row = (file, block, first, docs, np.array(sizes), checkpoints, b"".join(bits))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        size = 0
        for x in coded_texts(it, book.value, vocabulary):
            held.append(x)
            size += x[1]
            if size >= BLOCK:
                yield close()
                block, first, size, held = block + 1, first + size, 0, []
        if held:
            yield close()

    coded = materialise(ranged.mapInArrow(batches, (
        "file int, block int, first bigint, docs array<bigint>, sizes array<bigint>, checkpoints array<bigint>, bits binary")), "coded-ids")
    return coded, lengths


def read_coded(coded: DataFrame, lengths: np.ndarray) -> DataFrame:
    """(id, start: ids of all documents before, n, ids: little-endian uint32), decoded block by block."""
    import pyarrow as pa

    spark = coded.sparkSession
    # One row per file; files are as many as the partitions of the range sort.
    size = F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, n: a + n)
    sums = {r["file"]: r["n"] for r in coded.groupBy("file").agg(F.sum(size).alias("n")).collect()}
    before, total = {}, 0
    for f in sorted(sums):
        before[f], total = total, total + sums[f]
    shared = spark.sparkContext.broadcast((lengths, before))

    def batches(it: Iterator) -> Iterator:
        lengths, before = shared.value
        table = decode_table(lengths)
        for batch in it:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k] for c in batch.schema.names}
                sizes = np.asarray(r["sizes"].values)
                ids = decode(r["bits"].as_py(), np.asarray(r["checkpoints"].values), sizes, table).astype("<u4")
                ends = np.cumsum(sizes)
                yield pa.RecordBatch.from_arrays([
                    r["docs"].values, pa.array(ends - sizes + r["first"].as_py() + before[r["file"].as_py()]), pa.array(sizes),
                    pa.array([ids[e - n:e].tobytes() for e, n in zip(ends, sizes)], pa.binary())], ["id", "start", "n", "ids"])

    return coded.mapInArrow(batches, "id bigint, start bigint, n bigint, ids binary")
