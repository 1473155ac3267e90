"""Ranked lexical search by scanning the documents with an Aho-Corasick automaton of all item terms.

There is no index of documents. Every item term becomes a pattern with a guard on both sides; a text is
folded byte by byte so that all that is not part of a term becomes the guard, and one pass over it
finds every whole-word occurrence of every term at once. The texts are scanned twice: the first scan counts
in how many documents each term occurs and how long documents are, the second one scores. A match
leads to its term's items through a table of postings, so a document is scored for all items together.

What tasks hold is bounded: the automaton by ``block_bytes`` of item terms (more items are searched in
blocks, each with scans of its own), a text by pieces of ``PIECE`` bytes cut at guards, scores by
``CELLS`` cells, candidates by the ``k`` best a task and item. Only those candidates are shuffled, first ranked
per item and a few dozen groups of tasks, then per item.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from funnelworks.llm import columns as C
from funnelworks.llm.tokens import in_chunks, raw
from funnelworks.llm.wordscan import gather
from funnelworks.sources.storage import materialise

GUARD = b" "
BLOCK_BYTES = 4_000_000  # of item terms in one automaton; some 50 bytes of memory each
PIECE = 1_000_000
CELLS = 2_000_000  # scores held at once, 8 bytes each
GROUPS = 64  # of tasks, in the first ranking
_TERM = np.zeros(256, bool)
_TERM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = bytes((b + 32 if 65 <= b < 91 else b) if _TERM[b] else GUARD[0] for b in range(256))


class Block(NamedTuple):
    """What the tasks of one block get: terms by number, the items of each term, item ids by number."""

    name: str
    terms: list[str]
    starts: np.ndarray
    items: np.ndarray
    ids: list


def item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """Distinct (item, term). Rows of one item id are one item; items without terms do not appear."""
    words = F.array_distinct(C.words(C.fold(C.text_of(text)), C.NOT_WORD))
    return items.select(C.name(item).alias("item"), F.explode(words).alias("term")).distinct()


def blocks(terms: DataFrame, block_bytes: int) -> Iterator[Block]:
    """Items dealt by hash into so many blocks that each holds at most ``block_bytes`` of terms, or one item."""
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 2).alias("bytes"))
    hashed = F.xxhash64("item")
    n = 1
    while True:
        held = sizes.groupBy(F.pmod(hashed, F.lit(n)).alias("b")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        if held.filter((F.col("bytes") > block_bytes) & (F.col("n") > 1)).isEmpty():
            break
        n *= 2
    for b in range(n):
        rows = terms.filter(F.pmod(hashed, F.lit(n)) == b).collect()
        if not rows:
            continue
        number: dict = {}
        ids: dict = {}
        pairs = [(number.setdefault(r["term"], len(number)), ids.setdefault(r["item"], len(ids))) for r in rows]
        by_term = np.array(sorted(pairs), np.int64)
        starts = np.searchsorted(by_term[:, 0], np.arange(len(number) + 1))
        yield Block(uuid.uuid4().hex, list(number), starts, by_term[:, 1].copy(), list(ids))


_automata: dict = {}  # the last one a worker built


def automaton(block: Block):
    if block.name not in _automata:
        import ahocorasick

        built = ahocorasick.Automaton()
        for k, term in enumerate(block.terms):
            built.add_word((GUARD + term.encode() + GUARD).decode("latin-1"), k)
        built.make_automaton()
        _automata.clear()
        _automata[block.name] = built
    return _automata[block.name]


def _matches(built, folded: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(end of each match, its term), overlapping ones included: neighbours share their guard."""
    found = np.fromiter(chain.from_iterable(built.iter(folded.decode("latin-1"))), np.int64)
    return found[::2], found[1::2]


def _term_starts(folded: bytes) -> np.ndarray:
    data = np.frombuffer(folded, np.uint8) != GUARD[0]
    return np.flatnonzero(data[1:] & ~data[:-1]) + 1  # the first byte is a guard


def _pieces(folded: bytes) -> Iterator[bytes]:
    """A long folded text cut at guards, each piece with a guard at both ends."""
    at = 0
    while at < len(folded):
        to = folded.find(GUARD, min(at + PIECE, len(folded)))
        to = len(folded) if to < 0 else to
        yield GUARD + folded[at:to] + GUARD
        at = to + 1


def term_counts(built, n_terms: int, texts: list[bytes]) -> Iterator[tuple]:
    """For ranges a..b of texts: (a, b, terms of each text, and per text and term: text - a, term, occurrences)."""
    for a, b in in_chunks(texts, PIECE):
        if b == a + 1 and len(texts[a]) > PIECE:
            counts, n = np.zeros(n_terms, np.int64), 0
            for piece in _pieces(texts[a].translate(_FOLD)):
                counts += np.bincount(_matches(built, piece)[1], minlength=n_terms)
                n += len(_term_starts(piece))
            term = np.flatnonzero(counts)
            yield a, b, np.array([n]), np.zeros(len(term), np.int64), term, counts[term]
            continue
        folded = GUARD + GUARD.join(texts[a:b]).translate(_FOLD) + GUARD
        ends, term = _matches(built, folded)
        stops = np.cumsum(np.fromiter(map(len, texts[a:b]), np.int64, b - a) + 1)  # the guard after each text
        n = np.diff(np.searchsorted(_term_starts(folded), stops), prepend=0)
        key, tf = np.unique(np.searchsorted(stops, ends) * n_terms + term, return_counts=True)
        yield a, b, n, key // n_terms, key % n_terms, tf


def document_frequencies(texts: DataFrame, block) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms of all documents, documents holding each item term)."""
    import pyarrow as pa

    def count(it: Iterator) -> Iterator:
        terms = block.value.terms
        built = automaton(block.value)
        df, n_docs, n_terms = np.zeros(len(terms), np.int64), 0, 0
        for batch in it:
            for _, _, n, _, term, _ in term_counts(built, len(terms), raw(batch.column("t"))):
                df += np.bincount(term, minlength=len(terms))
                n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(met, [-1, -2])), pa.array(np.append(df[met], [n_docs, n_terms]))], names=["term", "n"])

    parts = texts.select("t").mapInArrow(count, "term bigint, n bigint")
    got = {r["term"]: r["n"] for r in parts.groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row per term of the block
    df = np.array([got.get(k, 0) for k in range(len(block.value.terms))], np.int64)
    return got.get(-1, 0), got.get(-2, 0), df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)


def length_factors(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)


class Best:
    """The ``k`` best documents of each item so far, by score and then by id, NULL ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)  # a lower score is out
        self.most = max(4 * k * n_items, 100_000)
        self.parts: list = []
        self.held = 0

    def add(self, scores: np.ndarray, ids) -> None:
        """``scores``: items x documents; ``ids``: the documents' ids, an Arrow array."""
        import pyarrow as pa

        floor, d = self.floor, scores.shape[1]
        if d > self.k:
            floor = np.maximum(floor, np.partition(scores, d - self.k, axis=1)[:, d - self.k])
        item, doc = np.nonzero(scores >= floor[:, None])
        if len(item):
            self.parts.append(pa.table({"item": item, "id": ids.take(pa.array(doc)), "score": scores[item, doc]}))
            self.held += len(item)
        if self.held > self.most:
            self.prune()

    def prune(self):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = pa.concat_tables(self.parts)
        order = pc.sort_indices(table, [("item", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_end")
        item = table["item"].to_numpy()[order.to_numpy()]
        first = np.flatnonzero(np.diff(item, prepend=-1))
        place = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        table = table.take(order.filter(pa.array(place < self.k)))
        last = place == self.k - 1
        self.floor[item[last]] = np.maximum(1, table["score"].to_numpy()[place[place < self.k] == self.k - 1])
        self.parts, self.held = [table], len(table)
        return table


def _candidates(texts: DataFrame, block, df: np.ndarray, n_docs: int, n_terms: int, k: int, out: StructType) -> DataFrame:
    import pyarrow as pa
    from pyspark import TaskContext

    weight = weights(n_docs, df)
    schema = to_arrow_schema(out)

    def search(it: Iterator) -> Iterator:
        b: Block = block.value
        built, n_items = automaton(b), len(b.ids)
        best = Best(n_items, k)
        step = max(1, CELLS // n_items)
        many = np.diff(b.starts)
        for batch in it:
            for first, last, n, doc, term, tf in term_counts(built, len(b.terms), raw(batch.column("t"))):
                m = length_factors(n, n_docs, n_terms)
                part = weight[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
                for d in range(0, last - first, step):
                    x, y = np.searchsorted(doc, [d, d + step])
                    width = min(step, last - first - d)
                    scores = np.zeros(n_items * width, np.int64)
                    reach = many[term[x:y]]
                    item = b.items[gather(b.starts[term[x:y]], reach)]
                    np.add.at(scores, item * width + np.repeat(doc[x:y] - d, reach), np.repeat(part[x:y], reach))
                    best.add(scores.reshape(n_items, width), batch.column("id").slice(first + d, width))
        if best.parts:
            table = best.prune()
            task = pa.array(np.full(len(table), TaskContext.get().partitionId() % GROUPS, np.int32))
            ids = pa.array(b.ids, schema.field("item").type).take(table["item"].combine_chunks())
            table = pa.table([ids, table["id"].cast(schema.field("id").type), table["score"], task], schema=schema)
            yield from table.to_batches(max_chunksize=50_000)

    return texts.mapInArrow(search, out)


def rank(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text: str = "text", item: str = "item_id",
         item_text: str = "text", k: int = 50, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank from 1, id, score): the ``k`` best documents of each item with a score above 0.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, A-Z in lower case. NULL and empty
    texts have none. Rows of one item id, NULL included, are one item; repeated documents are
    ranked one by one, NULL ids after others of the same score. Empty tables give no rows. Only the four columns
    named here are read, so other columns cannot clash.
    """
    spark = docs.sparkSession
    texts = docs.select(C.name(id_column).alias("id"), C.name(text).cast("string").alias("t"))
    terms = materialise(item_terms(items, item, item_text), "item-terms")
    out = StructType().add("item", terms.schema["item"].dataType).add("id", texts.schema["id"].dataType).add("score", "long").add("task", "integer")
    found = [spark.createDataFrame([], out)]
    for b in blocks(terms, block_bytes):
        block = spark.sparkContext.broadcast(b)
        n_docs, n_terms, df = document_frequencies(texts, block)
        if n_docs:
            found.append(_candidates(texts, block, df, n_docs, n_terms, k, out))
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    some = F.row_number().over(Window.partitionBy("item", "task").orderBy(*order))
    best = F.row_number().over(Window.partitionBy("item").orderBy(*order))
    all_found = reduce(DataFrame.unionByName, found)
    return (
        all_found.withColumn("rank", some).filter(F.col("rank") <= k)
        .withColumn("rank", best).filter(F.col("rank") <= k).select("item", "rank", "id", "score")
    )
