"""Benchmark decontamination as a prefix-filtered set join.

Every item is cut into windows of consecutive words. The shingles of a window are ordered by how
rare they are in the documents, and since a document must contain a window whole, the rarest shingle
alone is a necessary prefix: only places of documents with a prefix shingle are joined. Position
gives the one start a window can have there, length bounds drop starts outside of the document, and
the words that travel with the place verify the window exactly.

Documents are scanned twice and never shuffled whole. What the scans test against is a bit table of
fixed size, so nothing that is sent to all executors grows with the benchmark or the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.sources.storage import materialise

SHINGLE = 3
BITS = 22  # the bit table has 2**BITS bits, 512 KiB


def folded_words(text: Column) -> Column:
    return C.words(C.fold(text), C.NOT_WORD)


def bit_table(hashes: DataFrame) -> Column:
    """A scalar array of longs with a bit set for every ``h``; other hashes may hit it too."""
    slot = F.pmod("h", F.lit(1 << BITS))
    words = hashes.select(F.shiftright(slot, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(h, {1 << BITS}L) % 64 as int))").alias("b"))
    words = words.groupBy("w").agg(F.bit_or("b").alias("b"))
    every = hashes.sparkSession.range(1 << (BITS - 6)).withColumnRenamed("id", "w").join(words, "w", "left")
    table = every.agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("b", F.lit(0)).alias("b")))).alias("t"))
    return table.select(F.col("t.b")).scalar()  # select it as a column first: lambdas may not hold subqueries


def in_table(table: Column, h: Column) -> Column:
    slot = F.pmod(h, F.lit(1 << BITS))
    bits = F.get(table, F.shiftright(slot, 6).cast("int"))
    return F.getbit(bits, (slot % 64).cast("int")) == 1


def windows(benchmark: DataFrame, item: str, text: str, size: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (win: words, len), and (win, item as a string). An item without words has none."""
    ws = benchmark.select(C.name(item).cast("string").alias("item"), folded_words(C.text_of(text)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - size + 1, F.lit(1)))
    cut = ws.select(F.coalesce("item", F.lit("")).alias("item"), F.explode(F.transform(starts, lambda i: F.slice("ws", i, size))).alias("win"))
    of_item = materialise(cut.distinct(), "windows")
    return of_item.select("win", F.size("win").alias("len")).distinct(), of_item


def window_shingles(wins: DataFrame) -> DataFrame:
    """(win, len, n: words of a shingle, j: its place in the window from 0, h)."""
    n = F.least(F.col("len"), F.lit(SHINGLE))
    hashes = F.when(F.col("len") >= 3, C.grams(F.col("win"), 3)).when(F.col("len") == 2, C.grams(F.col("win"), 2)).otherwise(C.grams(F.col("win"), 1))
    return wins.select("win", "len", n.alias("n"), F.posexplode(hashes).alias("j", "h"))


def _places(ws: Column, sizes: list[int], table: Column, body) -> Column:
    """body(i, h) for each place ``i`` whose shingle ``h``, of any of the sizes in use, hits the table."""
    def of_size(n: int) -> Column:
        return C.let(C.grams(ws, n), lambda g: F.filter(
            F.transform(g, lambda h, i: F.when(in_table(table, h), body(i, h))), lambda x: x.isNotNull()))
    return F.concat(*(of_size(n) for n in sizes))


def find_windows(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """(id, th: hash of the text, n_words, n_hit, items: sorted item ids as strings), one row per document row.

    NULL and empty texts have no words. Rows of equal id and text get equal results. An item shorter
    than ``size`` words is one window; NULL item ids count as ''. An empty benchmark hits nothing.
    """
    wins, of_item = windows(benchmark, item, item_text, size)
    sh = materialise(window_shingles(wins), "window-shingles")
    sizes = sorted(r["n"] for r in sh.select("n").distinct().collect()) or [SHINGLE]  # at most 1, 2, 3
    base = docs.select(C.name(id_column).alias("id"), C.text_of(text).alias("t"))

    # How often each shingle of a window occurs in the documents.
    tested = base.withColumn("bits", bit_table(sh.select("h")))
    seen = tested.select(F.explode(C.let(folded_words(F.col("t")), lambda w: _places(w, sizes, F.col("bits"), lambda i, h: h))).alias("h"))
    seen = seen.groupBy("h").agg(F.count("*").alias("often"))
    rare = sh.join(seen, "h").groupBy("win", "len").agg(F.min(F.struct("often", "h", "j")).alias("p"), F.count_distinct("j").alias("met"))
    # A window with a shingle that occurs nowhere cannot occur.
    whole = F.col("met") == F.greatest(F.col("len") - SHINGLE + 1, F.lit(1))
    prefix = materialise(rare.filter(whole).select("win", "len", F.col("p.h").alias("h"), F.col("p.j").alias("j")), "prefixes")

    def place(w: Column) -> Column:
        def context(i: Column, h: Column) -> Column:
            first = F.greatest(i - size + 2, F.lit(1))  # from 1
            return F.struct((i + 1).alias("at"), h.alias("h"), first.alias("first"), F.slice(w, first, 2 * size).alias("near"))
        return F.struct(F.size(w).cast("bigint").alias("n_words"), _places(w, sizes, F.col("bits"), context).alias("places"))

    tested = base.withColumn("bits", bit_table(prefix.select("h")))
    scanned = materialise(tested.select("id", F.xxhash64("t").alias("th"), C.let(folded_words(F.col("t")), place).alias("p"))
                          .select("id", "th", "p.*"), "places")
    found = scanned.select("id", "th", "n_words", F.explode("places").alias("x")).select("id", "th", "n_words", "x.*")
    start = F.col("at") - F.col("j")
    hits = found.join(prefix, "h").filter(
        (start >= 1) & (start + F.col("len") - 1 <= F.col("n_words"))
        & (F.slice("near", start - F.col("first") + 1, F.col("len")) == F.col("win"))
    ).select("id", "th", start.alias("start"), (start + F.col("len")).alias("end"), "win")
    hits = materialise(hits, "window-hits")

    ends = F.array_sort(F.collect_set(F.struct("start", "end")))
    acc = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("to"))
    covered = F.aggregate(ends, acc, lambda a, x: F.struct(
        (a["n"] + F.greatest(x["end"] - F.greatest(a["to"], x["start"]), F.lit(0))).alias("n"),
        F.greatest(a["to"], x["end"]).alias("to")), lambda a: a["n"])
    spans = hits.groupBy("id", "th").agg(covered.alias("n_hit"))
    items = hits.select("id", "th", "win").distinct().join(of_item, "win").groupBy("id", "th").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    per_doc = spans.join(items, (spans.id.eqNullSafe(items.id)) & (spans.th == items.th)).select(
        spans.id.alias("of"), spans.th.alias("ofh"), "n_hit", "items")
    return scanned.select("id", "th", "n_words").join(
        per_doc, F.col("id").eqNullSafe(F.col("of")) & (F.col("th") == F.col("ofh")), "left",
    ).select("id", "th", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
             F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = 10) -> DataFrame:
    """The rows of documents in which no window of an item occurs, with their own columns."""
    hit = find_windows(docs, benchmark, id_column, text, size=size).filter("n_hit > 0").select("id", "th").distinct()
    return docs.join(hit, C.name(id_column).eqNullSafe(hit.id) & (F.xxhash64(C.text_of(text)) == hit.th), "left_anti")
