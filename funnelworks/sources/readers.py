"""Table scans. CSV columns are matched to the file's header by name; values that do not parse are set aside."""

from __future__ import annotations

from typing import Literal, NamedTuple, get_args

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.functions.time import parse_timestamp
from funnelworks.sources.schemas import SCHEMAS


class Tables(NamedTuple):
    app_events: DataFrame
    marketing_spend: DataFrame
    user_profiles: DataFrame
    user_transactions: DataFrame
    skan_attribution_ios: DataFrame


REJECTED = "_rejected"  # the column of values that did not parse
OnBad = Literal["report", "raise"]


def _parsed(field: T.StructField, timestamp_format: str | None) -> Column:
    raw = F.col(field.name)
    if isinstance(field.dataType, T.TimestampNTZType):
        return parse_timestamp(raw, timestamp_format)
    if field.name == "user_id":
        return raw  # any key type; text in CSV files
    if isinstance(field.dataType, T.IntegralType):
        # Writers put "5.0" where a column of whole numbers has gaps.
        number = raw.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number).try_cast(field.dataType)
    return raw.try_cast(field.dataType)


def _typed(raw: DataFrame, schema: T.StructType, timestamp_format: str | None, on_bad: OnBad) -> DataFrame:
    """Project to the declared schema; columns the file does not have are left out.

    A value that is there but does not parse becomes NULL and goes into ``REJECTED``, or raises.
    """
    fields = [f for f in schema.fields if f.name in raw.columns]
    parsed = {f.name: _parsed(f, timestamp_format) for f in fields}
    bad = {n: parsed[n].isNull() & F.col(n).isNotNull() & (F.trim(F.col(n).cast("string")) != "") for n in parsed}
    rest = [c for c in raw.columns if c not in parsed and c != REJECTED]
    if on_bad == "raise":
        def told(n: str) -> Column:
            return F.raise_error(F.concat(F.lit(f"{n} cannot hold "), F.col(n).cast("string"))).cast(raw.select(parsed[n]).schema[0].dataType)

        return raw.select(*[F.when(bad[n], told(n)).otherwise(c).alias(n) for n, c in parsed.items()], *rest)
    found = F.filter(F.array(*[
        F.when(bad[n], F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value"))) for n in parsed
    ]), lambda x: x.isNotNull())
    return raw.select(*[c.alias(n) for n, c in parsed.items()], *rest, F.when(F.size(found) > 0, found).alias(REJECTED))


def read_table(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    fmt: str = "csv",
    timestamp_format: str | None = None,
    file_order: str | None = None,
    on_bad: OnBad = "report",
) -> DataFrame:
    """Scan one table as CSV (header row) or Parquet and cast it to ``schema``.

    A value that does not parse is NULL. The column ``_rejected`` lists a row's (column, value) pairs of that kind, NULL where
    there are none, and ``table_profile`` counts them; with ``on_bad="raise"`` the first one read is an error instead.
    ``file_order`` names an extra column that sorts rows as they stand in the files. It is the
    tie-breaker for tables without a row id, where rows of one instant count in file order.
    """
    if fmt == "csv":
        # Every column is read as text, so no inference pass over the data runs; a part file whose
        # header differs from the first one's is refused instead of read by position.
        raw = spark.read.options(header=True, inferSchema=False, enforceSchema=False).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"format must be csv or parquet, not {fmt!r}")
    if on_bad not in get_args(OnBad):
        raise ValueError(f"on_bad must be report or raise, not {on_bad!r}")
    if file_order is None:
        return _typed(raw, schema, timestamp_format, on_bad)
    # A split lies in one task, so the running id orders its rows; the block start orders the splits.
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return _typed(raw.select("*", position.alias(file_order)), schema, timestamp_format, on_bad)


def read_tables(
    spark: SparkSession, folder: str, fmt: str = "csv", timestamp_format: str | None = None, on_bad: OnBad = "report"
) -> Tables:
    """Scan all five tables from ``<folder>/<table>.<fmt>``; ``on_bad`` as in ``read_table``.

    Events and transactions get their tie-breakers ``event_id`` and ``tx_id`` from file order
    when the files have no such column.
    """
    frames = {}
    for name, schema in SCHEMAS.items():
        path = f"{folder.rstrip('/')}/{name}.{fmt}"
        row_id = {"app_events": "event_id", "user_transactions": "tx_id"}.get(name)
        df = read_table(spark, path, schema, fmt, timestamp_format, on_bad=on_bad)
        if row_id is not None:
            if row_id in df.columns:
                # Numeric ids keep their order; any other id still gives a fixed, non-null order.
                text = F.col(row_id)
                df = df.withColumn(row_id, F.coalesce(text.try_cast("bigint"), F.xxhash64(text)))
            else:
                df = read_table(spark, path, schema, fmt, timestamp_format, row_id, on_bad)
        frames[name] = df
    return Tables(**frames)
