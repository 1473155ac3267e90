"""A corpus from raw documents to packed training sequences, stage by stage.

Every stage takes what its predecessor kept and returns rows with the columns of ``documents``; the last
returns packed pieces. ``run`` writes each stage's result to the checkpoint folder and reads it again, so a
lost executor costs no more than one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm.decontaminate import decontaminated
from funnelworks.llm.linededup import dedup_lines
from funnelworks.llm.ngramjoin import jaccard_join
from funnelworks.llm.packing import pack
from funnelworks.llm.quality import quality_rules
from funnelworks.llm.ship import ship
from funnelworks.sources.storage import materialise

ID, TEXT, HOST, CHARS = "doc_id", "text", "source", "n_chars"


def _rows_with(df: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The rows in ``row`` with their text replaced where it changed, and its length brought up to date."""
    old = F.col("row").getField(TEXT)
    changed = F.coalesce(old, F.lit("")) != F.col(text)
    columns = []
    for field in docs.schema.fields:
        c = F.col("row").getField(field.name)
        if field.name == TEXT:
            c = F.when(changed, F.col(text)).otherwise(c)
        elif field.name == CHARS:
            c = F.when(changed, F.length(text).cast(field.dataType)).otherwise(c)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def stage_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents, and lines over their host's limit from the others."""
    return _rows_with(quality_rules(docs, TEXT, HOST).filter("kept"), docs, "clean")


def stage_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops repeated lines; documents stay, if need be with an empty text."""
    return _rows_with(dedup_lines(docs, ID, TEXT), docs, "kept")


def stage_ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group of near copies; rows of one id are one document, and
    rows without an id stay."""
    ship(spark)
    copies = jaccard_join(docs, ID, TEXT).filter("id <> component_id").select(F.col("id").alias(ID)).distinct()
    return docs.join(materialise(copies, "near-copies"), ID, "left_anti").select(*docs.columns)


def stage_benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminated(docs, benchmark, ID, TEXT)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces with their token ids."""
    ship(spark)
    pieces = pack(docs, public_tokenizers.path("word_bpe_49k.json"), ID, TEXT)
    return pieces.withColumnRenamed("id", ID).drop("row")


STAGES = [
    ("quality_rules", stage_quality_rules),
    ("line_dedup", stage_line_dedup),
    ("ngram_jaccard_join", stage_ngram_jaccard_join),
    ("benchmark_decontamination", stage_benchmark_decontamination),
    ("packing", stage_packing),
]

ORACLE_SQL = None  # token ids are not SQL's; the tests hold every stage against SQL or brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
