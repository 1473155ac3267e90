"""License scan by diagonal voting.

All rolling word k-grams of the documents are joined with the k-grams of license texts, by hash and then by
their words. Every match votes for the diagonal "place in the document minus place in the template", that is, for
a start of the template there. Votes are counted per diagonal, and since an inserted or a dropped word moves
what follows to a neighbouring diagonal, those within ``BAND`` words are merged. A span is verified by the share of
its template's k-grams that it holds: all of a short phrase, ``SHARE`` of a longer notice.

The templates are a short list, so they are sent to all executors, and their hashes stand in the plan as a set: all
rolling hashes are tested against it where the text is read, and those that meet a template are joined with its
positions before anything is shuffled. Each document is read once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.operators.events import null_safe_join
from funnelworks.sources.storage import materialise


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # to be found word by word

    @property
    def words(self) -> list[str]:
        return re.findall("[0-9a-z]+", self.text.lower())

    @property
    def k(self) -> int:
        """Words of a k-gram: pairs of words would vote by chance all over the place for a long text."""
        return min(len(self.words), 2 if self.phrase else 3)


# Phrases and labels of the contract, then public license notices.
TEMPLATES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
             "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
             "any later version"),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("mit-notice", "Released under the MIT License"),
    Template("mit-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the Software), to deal in the Software without restriction, including without limitation the rights "
             "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)
BAND = 6  # words that may be inserted or dropped within a notice
SHARE = 0.7  # of a notice's k-grams
MAX_GRAMS = 126  # of a template; two longs hold its votes
MAX_WORDS = 10_000  # of all templates, which are sent to every executor
DOCUMENT = -1  # the template number of rows that stand for documents


def template_grams(spark, templates: Sequence[Template]) -> DataFrame:
    """(template, at: place of the k-gram, k, g: its words, h: their hash)."""
    rows = []
    for n, t in enumerate(templates):
        words = t.words
        if not words or len(words) - t.k + 1 > MAX_GRAMS:
            raise ValueError(f"a template has 1 to {MAX_GRAMS + 2} words of letters and digits: {t.label}")
        rows += [(n, at, words[at:at + t.k]) for at in range(len(words) - t.k + 1)]
    if len(rows) > MAX_WORDS:
        raise ValueError(f"templates of more than {MAX_WORDS} words are not sent to every executor")
    frame = spark.createDataFrame(rows, "template int, at int, g array<string>")
    hashes = {k: F.xxhash64(*(F.get("g", F.lit(n)) for n in range(k))) for k in sorted({t.k for t in templates})}
    return frame.withColumn("h", reduce(lambda a, k: a.when(F.size("g") == k, hashes[k]), hashes, F))


def _grams(words: Column, k: int, known: Sequence[int]) -> Column:
    """(pos, h, g) of the runs of ``k`` words whose hash is ``known``; words are copied for those alone."""
    met = F.transform(C.grams(words, k), lambda h, i: F.when(
        h.isin(list(known)), F.struct(i.alias("pos"), h.alias("h"), F.slice(words, i + 1, k).alias("g"))))
    return F.filter(met, lambda x: x.isNotNull())


def _bits(word: int) -> Column:
    """Votes of k-grams word * 63 ... word * 63 + 62 as bits; repeated rows set the same ones."""
    at = F.col("at") - 63 * word
    return F.bit_or(F.when(at.between(0, 62), F.expr(f"shiftleft(1L, cast(at - {63 * word} as int))")).otherwise(0))


def votes(docs: DataFrame, id_column: str, text: str, templates: Sequence[Template]) -> DataFrame:
    """(id, th: hash of the text, n_words, template, diagonal, rows, low, high, first, last): counted votes.

    A row of template -1 stands for each distinct (id, text), with the number of its rows.
    """
    words = C.words(C.fold(F.col("t")), C.NOT_WORD)
    grams = template_grams(docs.sparkSession, templates)
    hashes: dict[int, list[int]] = {}
    for r in grams.select(F.size("g").alias("k"), "h").distinct().collect():
        hashes.setdefault(r["k"], []).append(r["h"])
    mark = F.array(F.struct(F.lit(0).alias("pos"), F.lit(None).cast("bigint").alias("h"), F.lit(None).cast("array<string>").alias("g")))
    read = C.let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), F.concat(mark, *(_grams(w, k, known) for k, known in hashes.items())).alias("xs")))
    base = docs.select(C.name(id_column).alias("id"), C.text_of(text).alias("t"))
    every = base.select("id", F.xxhash64("t").alias("th"), read.alias("r")).select("id", "th", "r.n_words", F.inline("r.xs"))
    known = F.broadcast(grams.withColumnsRenamed({"h": "of", "g": "words"}))
    met = every.join(known, (F.col("h") == F.col("of")) & (F.col("g") == F.col("words")), "left")
    met = met.filter(F.col("h").isNull() | F.col("of").isNotNull())
    return met.groupBy("id", "th", "n_words", F.coalesce("template", F.lit(DOCUMENT)).alias("template"),
                       F.coalesce(F.col("pos") - F.col("at"), F.lit(0)).alias("diagonal")).agg(
        F.count("*").alias("rows"), _bits(0).alias("low"), _bits(1).alias("high"), F.min("pos").alias("first"), F.max("pos").alias("last"))


def _share(low: Column, high: Column) -> Column:
    return (F.bit_count(low) + F.bit_count(high)).cast("double") / F.col("grams")


def spans(voted: DataFrame, templates: Sequence[Template], band: int = BAND, share: float = SHARE) -> DataFrame:
    """Verified spans (id, th, label, phrase, start, stop: words from 0, share).

    Neighbouring diagonals of a notice are merged by a window of ``band`` diagonals to both sides, so a span is never
    longer than its template and twice the band; of the spans around one place the best one stays, the first among equals.
    """
    facts = voted.sparkSession.createDataFrame(
        [(n, t.label, t.phrase, t.k, len(t.words) - t.k + 1) for n, t in enumerate(templates)],
        "template int, label string, phrase boolean, k int, grams int")
    known = voted.join(F.broadcast(facts), "template")
    kept = ["id", "th", "label", "phrase", "start", "stop", "share"]
    whole = known.filter("phrase").withColumns({"share": _share(F.col("low"), F.col("high")), "start": F.col("first"), "stop": F.col("last") + F.col("k")})
    near = Window.partitionBy("id", "th", "template").orderBy("diagonal").rangeBetween(-band, band)
    merged = known.filter("NOT phrase").withColumns({
        "share": _share(F.bit_or("low").over(near), F.bit_or("high").over(near)),
        "start": F.min("first").over(near), "stop": F.max("last").over(near) + F.col("k"),
    }).filter(F.col("share") >= share)
    rank = F.struct("share", -F.col("diagonal"))
    best = merged.withColumn("top", F.max(rank).over(near)).filter(F.col("top") == rank)
    return whole.filter("share = 1").select(kept).unionByName(best.select(kept))


def scan(docs: DataFrame, id_column: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES,
         band: int = BAND, share: float = SHARE) -> DataFrame:
    """(id, th: hash of the text, n_words, spans: label, phrase, start, stop, share; in order), one row per input row.

    NULL and empty texts have no words and no spans. Rows of equal id and text get equal results. A
    document holds no more spans than words, so its spans are bounded by it. An empty table gives no rows. Only id and
    text are read, so other columns cannot clash.
    """
    voted = materialise(votes(docs, id_column, text, templates), "license-votes")
    found = spans(voted.filter(F.col("template") != DOCUMENT), templates, band, share)
    per_doc = found.groupBy("id", "th").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "label", "phrase", "share"))).alias("spans"))
    rows = voted.filter(F.col("template") == DOCUMENT).select("id", "th", "n_words", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))).alias("copy"))
    none = F.array().cast(per_doc.schema["spans"].dataType)
    return null_safe_join(rows, per_doc, ["id", "th"]).select("id", "th", "n_words", F.coalesce("spans", none).alias("spans"))
