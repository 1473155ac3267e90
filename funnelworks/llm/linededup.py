"""Line dedup over levelled sorted runs.

Batches of documents come in descending order of their ids. Each batch is reduced to one row per
line key and anti-joined with the sorted runs that earlier batches left: keys not seen before get
their holder, the largest document id, from this batch. The batch then adds its own run. When a
level has ``fanout`` runs they are compacted into one run of the next level, so a batch meets only
a few runs however many came before. Runs are bucketed and sorted by key, so these are merge joins
that move the batch and not the runs.

Keys are two 64-bit hashes, so that distinct lines do not meet even among trillions.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.llm import columns as C
from funnelworks.sources.storage import checkpoint_root, materialise

KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return C.fold(F.btrim(line, F.lit(C.SPACE_CHARS)))


class Runs:
    """Levels of sorted runs (h1, h2, n: documents, holder: largest id or NULL if an older run has it)."""

    def __init__(self, spark: SparkSession, fanout: int, buckets: int):
        self.spark, self.fanout, self.buckets = spark, fanout, buckets
        self.levels: list[list[str]] = [[]]
        self.root = f"{checkpoint_root(spark).rstrip('/')}/line-runs-{uuid.uuid4().hex}"
        self.made: list[str] = []

    def _write(self, run: DataFrame) -> str:
        table = f"line_run_{uuid.uuid4().hex}"
        (run.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", f"{self.root}/{table}").saveAsTable(table))
        self.made.append(table)
        return table

    def all(self) -> list[DataFrame]:
        return [self.spark.table(t) for level in self.levels for t in level]

    def files(self, tables: list[str]) -> list[DataFrame]:
        """The runs without their buckets: Spark 4.1 takes a union of bucketed scans for co-located and
        would group each scan by itself."""
        return [self.spark.read.schema(self.spark.table(t).schema).parquet(f"{self.root}/{t}") for t in tables]

    def add(self, batch: DataFrame) -> None:
        """``batch``: (h1, h2, n, holder), one row per key."""
        known = [r.select(*KEY, F.lit(True).alias(f"in{k}")) for k, r in enumerate(
            r.filter(F.col("holder_known")) for r in self.all())]
        joined = reduce(lambda b, r: b.join(r, KEY, "left"), known, batch)
        seen = reduce(lambda a, b: a | b, [F.col(f"in{k}").isNotNull() for k in range(len(known))], F.lit(False))
        self.levels[0].append(self._write(joined.select(
            *KEY, "n", F.when(~seen, F.col("holder")).alias("holder"), (~seen).alias("holder_known"))))
        self._compact(0)

    def _compact(self, level: int) -> None:
        if len(self.levels[level]) < self.fanout:
            return
        merged = merge(self.files(self.levels[level]))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged))
        self.levels[level] = []
        self._compact(level + 1)

    def forget(self) -> None:
        """Takes the tables off the catalog; their files stay in the checkpoint folder as they are still read."""
        for t in self.made:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def merge(runs: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, runs).groupBy(*KEY).agg(
        F.sum("n").alias("n"), F.max("holder").alias("holder"), F.max("holder_known").alias("holder_known"))


def _batch_bounds(docs: DataFrame, id_column: str, n: int) -> list:
    """Upper ends of ``n`` ranges of ids, from one column. They steer only the batch sizes."""
    shares = [k / n for k in range(1, n)]
    got = docs.agg(F.percentile_approx(C.name(id_column), F.lit(shares)).alias("b")).first()["b"]
    return sorted(set(got or []))


def repeated_lines(docs: DataFrame, id_column: str, text: str, min_chars: int, min_docs: int,
                   batches: int, fanout: int) -> DataFrame:
    """(id, drops): hashes of the keys whose lines a document loses. NULL ids count as one document,
    smaller than all others."""
    spark = docs.sparkSession
    bounds = _batch_bounds(docs, id_column, batches)
    batch = reduce(lambda a, b: a + F.when(F.col("id") > b, 0).otherwise(1), bounds, F.lit(0)).alias("batch")
    keys = F.array_distinct(F.filter(F.transform(C.lines(C.text_of(text)), line_key), lambda k: F.length(k) >= min_chars))
    rows = docs.select(C.name(id_column).alias("id"), F.explode(keys).alias("key"))
    # One row per document and key; distinct() spreads a line of every document by the document.
    held = materialise(rows.select(
        batch, "id", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2")).distinct(), "line-keys")
    runs = Runs(spark, fanout, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for b in range(len(bounds) + 1):
        runs.add(held.filter(F.col("batch") == b).groupBy(*KEY).agg(F.count("*").alias("n"), F.max("id").alias("holder")))
    often = materialise(merge(runs.files([t for level in runs.levels for t in level])).filter(F.col("n") >= min_docs).select(*KEY, "holder"), "line-often")
    runs.forget()
    lost = held.join(often, KEY).filter(~F.col("id").eqNullSafe(F.col("holder")))
    return lost.groupBy("id").agg(F.collect_set("h1").alias("drops"))


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", min_chars: int = 40,
                min_docs: int = 5, batches: int = 8, fanout: int = 4) -> DataFrame:
    """(row: the input row, kept: remaining text, n_lines, n_dropped), one row per input row.

    NULL text counts as empty, one line. Rows with one id are one document: all of them keep the
    lines that this id holds. A document loses at most its own lines, so ``drops`` is bounded by it.
    """
    drops = repeated_lines(docs, id_column, text, min_chars, min_docs, batches, fanout)
    rows = docs.select(
        F.struct(*map(C.name, docs.columns)).alias("row"), C.name(id_column).alias("of"), C.text_of(text).alias("t"))
    joined = rows.join(drops, F.col("of").eqNullSafe(F.col("id")), "left")

    def stays(line: Column) -> Column:
        return C.let(line_key(line), lambda k: (F.length(k) < min_chars) | ~F.array_contains(F.col("drops"), F.xxhash64(k)))

    some = F.col("drops").isNotNull()
    kept = F.when(some, F.filter(C.lines(F.col("t")), stays)).otherwise(C.lines(F.col("t")))
    return joined.select("row", "t", kept.alias("ls")).select(
        "row", F.array_join("ls", "\n").alias("kept"),
        F.size(C.lines(F.col("t"))).cast("bigint").alias("n_lines"),
        (F.size(C.lines(F.col("t"))) - F.size("ls")).cast("bigint").alias("n_dropped"))
