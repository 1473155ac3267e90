"""Hierarchical multi-length packing.

Every document is tokenised and cut: full windows of the longest size leave at once, and the rest is
routed to the tier of the shortest context size that holds it. Tiers are packed longest first: a
window takes the longest rest that is waiting and its gap is filled from the same and the shorter tiers,
largest first, the last filler being cut to fit. What is left at the end of a partition goes to
windows of the shorter sizes, which need no padding, and only the very last few ids are padded.

Each Spark partition packs its own documents in one pass, with a bounded number waiting, so there is
no shuffle, no order to wait for and no global state; a lost task repeats with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from funnelworks.llm import columns as C
from funnelworks.llm.tokens import encoder, text_chunks

TIERS = (4096, 2048, 1024, 512, 256, 128, 64)  # powers of two, longest first
PIECES = ("id {id}, row bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, sequence_length bigint, tier int, step_group bigint")


@dataclass
class Rest:
    doc: object
    row: int
    start: int
    ids: np.ndarray
    total: int


class Packer:
    """Packs one partition. ``waiting`` holds at most ``hold`` rests, each shorter than the longest tier."""

    def __init__(self, partition: int, tiers: tuple[int, ...], hold: int, step_tokens: int):
        self.tiers, self.hold, self.step_tokens = tiers, hold, step_tokens
        self.next_id = partition << 33
        self.waiting: dict[int, list[Rest]] = {t: [] for t in tiers}
        self.n_waiting = 0
        self.filled: dict[int, int] = dict.fromkeys(tiers, 0)  # tokens of each tier so far, for the step groups
        self.out: list[tuple] = []

    def tier_of(self, n: int) -> int:
        return min((t for t in self.tiers if t >= n), default=self.tiers[0])

    def wait(self, rest: Rest) -> None:
        """Keeps a copy: a view would hold the ids of a whole chunk of texts for as long as it waits."""
        rest.ids = rest.ids.copy()
        self.waiting[self.tier_of(len(rest.ids))].append(rest)
        self.n_waiting += 1

    def emit(self, parts: list[Rest], size: int) -> None:
        """One sequence. Sequences of one tier form step groups of equal token counts."""
        group = self.filled[size] // self.step_tokens
        self.filled[size] += size
        at = 0
        for p in parts:
            self.out.append((p.doc, p.row, p.start, len(p.ids), p.ids.astype("<u4").tobytes(), p.total, self.next_id, at, size, size, group))
            at += len(p.ids)
        self.next_id += 1

    def add(self, doc: object, row: int, ids: np.ndarray) -> None:
        longest, n = self.tiers[0], len(ids)
        for s in range(0, n - n % longest, longest):
            self.emit([Rest(doc, row, s, ids[s:s + longest], n)], longest)
        if n % longest:
            self.wait(Rest(doc, row, n - n % longest, ids[n - n % longest:], n))
        if self.n_waiting >= self.hold:
            self.pack(self.hold // 2)

    def take(self, at_most: int) -> Rest | None:
        """The longest waiting rest of at most so many ids."""
        for t in self.tiers:
            if t // 2 >= at_most and t != self.tiers[-1]:
                continue
            fits = [k for k, r in enumerate(self.waiting[t]) if len(r.ids) <= at_most]
            if fits:
                k = max(fits, key=lambda k: len(self.waiting[t][k].ids))
                self.n_waiting -= 1
                return self.waiting[t].pop(k)
        return None

    def cut(self, n: int) -> Rest | None:
        """The first ``n`` ids of the shortest rest that has more; its remainder keeps waiting."""
        for t in reversed(self.tiers):
            for k, r in enumerate(self.waiting[t]):
                if len(r.ids) > n:
                    self.waiting[t].pop(k)
                    self.n_waiting -= 1
                    self.wait(Rest(r.doc, r.row, r.start + n, r.ids[n:], r.total))
                    return Rest(r.doc, r.row, r.start, r.ids[:n], r.total)
        return None

    def window(self, size: int) -> list[Rest]:
        parts, left = [], size
        while left and (r := self.take(left) or self.cut(left)):
            parts.append(r)
            left -= len(r.ids)
        return parts

    def pack(self, keep: int) -> None:
        while self.n_waiting > keep:
            if sum(len(r.ids) for rs in self.waiting.values() for r in rs) < self.tiers[0]:
                return
            self.emit(self.window(self.tiers[0]), self.tiers[0])

    def finish(self) -> None:
        self.pack(0)
        left = sum(len(r.ids) for rs in self.waiting.values() for r in rs)
        for t in self.tiers[1:]:
            while left >= t:
                self.emit(self.window(t), t)
                left -= t
        if left:
            self.emit(self.window(left), self.tiers[0])

    def drain(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", end: int = 2,
         tiers: tuple[int, ...] = TIERS, hold: int = 512, step_tokens: int = 1 << 19) -> DataFrame:
    """One row per piece: id, row (number of the document's row in its partition), start, length, ids
    (little-endian uint32), doc_tokens, sequence_id, offset, sequence_length, tier, step_group.

    NULL and empty texts are the end id alone. Repeated rows are documents of their own; ``row`` tells
    them apart. Very long texts leave as full windows at once. An empty table gives no pieces.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(C.name(id_column).alias("id"), C.name(text).cast("string").alias("t"))
    schema = PIECES.format(id=kind)
    out_schema = to_arrow_schema(StructType.fromDDL(schema))

    def batches(it: Iterator) -> Iterator:
        packer = Packer(TaskContext.get().partitionId(), tiers, hold, step_tokens)

        def done(least: int):
            while len(packer.out) >= least and packer.out:
                got, packer.out = packer.out[:4096], packer.out[4096:]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got), out_schema)], schema=out_schema)

        row = 0
        for batch in it:
            names = batch.column("id").to_pylist()
            for a, b, texts in text_chunks(batch.column("t")):
                ids, bounds = encoder(path).encode(texts, end)
                for k in range(a, b):
                    packer.add(names[k], row, ids[bounds[k - a]:bounds[k - a + 1]])
                    row += 1
                yield from done(4096)
        packer.finish()
        yield from done(1)

    return rows.mapInArrow(batches, schema)
