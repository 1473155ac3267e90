"""Quality rules with a cross-document line frequency.

Normalised lines are hashed and the distinct documents that hold them are counted per host. Lines
over the host's limit are removed, and documents that lose most of their text that way are rejected,
as are those that fail the plain rules on words and repetition.

Copies of one document count once: documents are told apart by a digest of their whole normalised
text, so a text with a thousand copies doesn't make its own lines boilerplate, while pages that
share some lines count one by one. A document without any line that isn't blank is not counted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.sources.storage import materialise


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50  # of words that lie in repeated windows
    window: int = 3
    min_line_documents: int = 20  # a line in fewer distinct documents of a host is never removed
    max_line_percent: int = 10  # of the host's distinct documents
    min_left_percent: int = 20  # characters of a document that must outlast the removal


def normalised(line: Column) -> Column:
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(C.SPACE_CHARS)), C.SPACE, " "))


def repeated_words(tokens: Column, n: int) -> Column:
    """Words inside of runs of ``n`` words that occur twice or more: the sorted hashes show in one
    cheap pass whether any run repeats; only then are they sorted with their places."""

    def places(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return C.let(ordered, lambda s: F.sort_array(F.transform(
            F.filter(s, lambda x, k: F.get(s, k - 1)["h"].eqNullSafe(x["h"]) | F.get(s, k + 1)["h"].eqNullSafe(x["h"])),
            lambda x: x["i"])))

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, k: F.least(F.lit(n), F.coalesce(p - F.get(at, k - 1), F.lit(n))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            C.let(places(hashes), covered))

    return C.let(C.grams(tokens, n), count)


def measures(text: Column, n: int) -> Column:
    """The plain measures of a text as a struct of longs."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeated_words(w, n).cast("bigint").alias("n_repeat_words"))

    def of_lines(ls: Column) -> Column:
        return (F.size(ls) - F.size(F.array_distinct(ls))).cast("bigint")

    wordy = F.filter(C.lines(text), lambda x: F.length(F.btrim(x, F.lit(C.SPACE_CHARS))) > 0)
    return F.struct(
        C.let(C.words(text), of_words).alias("words"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        C.let(wordy, of_lines).alias("n_dup_lines"))


def frequent_lines(docs: DataFrame, text: str, host: str, rules: Rules = Rules()) -> DataFrame:
    """Per host the hashes of its lines over the limit: (host, frequent). At most
    100 / max_line_percent times the mean number of lines of a document, so the array is short.

    The shuffle carries three numbers per distinct (host, line, document): counting is in two steps,
    so neither a hot host nor a line of every document meets in one task.
    """
    hashed = F.transform(F.filter(F.transform(C.lines(C.text_of(text)), normalised), lambda x: x != ""), C.hex_long)
    digest = C.let(hashed, lambda hs: F.when(F.size(hs) > 0, F.xxhash64(hs)))  # of the lines in order, with repeats
    both = C.let(hashed, lambda hs: F.struct(F.xxhash64(hs).alias("of"), F.array_distinct(hs).alias("hs")))
    per_doc = docs.select(C.name(host).alias("host"), digest.alias("of"))
    hosts = per_doc.groupBy("host").agg(F.count_distinct("of").alias("n_docs"))
    held = docs.select(C.name(host).alias("host"), both.alias("d")).select("host", "d.of", F.explode("d.hs").alias("h"))
    counts = held.distinct().groupBy("host", "h").agg(F.count("*").alias("n")).filter(F.col("n") >= rules.min_line_documents)
    hosts = hosts.withColumnRenamed("host", "of_host")
    over = counts.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).filter(
        F.col("n") * 100 > F.col("n_docs") * rules.max_line_percent)
    return over.groupBy("host").agg(F.collect_set("h").alias("frequent"))


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """(row: the input row as a struct, clean: text without frequent lines, kept, base_failed, measures...).

    NULL or empty text has no words and fails. NULL is a host like others. Every input row gives one
    row; repeated rows get equal verdicts. Extra columns only travel in ``row``, so no name can clash.
    """
    # Written first, so that its size is known before the texts are moved: Spark sends it out if it is
    # under its threshold and else joins by shuffle.
    frequent = materialise(frequent_lines(docs, text, host, rules), "frequent-lines")
    base = docs.select(F.struct(*map(C.name, docs.columns)).alias("row"), C.name(host).alias("of"), C.text_of(text).alias("t"))
    joined = base.join(frequent, F.col("of").eqNullSafe(F.col("host")), "left")
    kept_lines = F.filter(C.lines(F.col("t")), lambda x: ~F.array_contains(F.col("frequent"), C.hex_long(normalised(x))))
    clean = F.when(F.col("frequent").isNull(), F.col("t")).otherwise(F.array_join(kept_lines, "\n"))
    m = joined.select("row", "t", clean.alias("clean"), measures(F.col("t"), rules.window).alias("m"))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    left = 100 * F.length("clean") >= rules.min_left_percent * F.length("t")
    return m.select(
        "row", "clean", left.alias("left"), "m.words.*", "m.n_symbols", "m.n_dup_lines",
    ).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("left")).drop("left")
