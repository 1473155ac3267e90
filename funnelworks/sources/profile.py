"""Column profile of a table: type, non-null, rejected and row count, in one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.sources.readers import REJECTED


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column. ``rejected`` counts values that the scan could not parse, 0 for tables that were not scanned here."""
    dtypes = [(name, dtype) for name, dtype in df.dtypes if name != REJECTED]

    def lost(name: str) -> Column:
        if REJECTED not in df.columns:
            return F.lit(0).cast("bigint")
        return F.count_if(F.exists(REJECTED, lambda x: x["column"] == name))

    counts = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, (c, _) in enumerate(dtypes)],
        *[lost(c).alias(f"bad{i}") for i, (c, _) in enumerate(dtypes)],
    )
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            F.col(f"n{i}").alias("non_null"),
            F.col(f"bad{i}").alias("rejected"),
        )
        for i, (name, dtype) in enumerate(dtypes)
    ])
    return counts.select(F.explode(rows).alias("r"), "row_count").select("r.*", "row_count")
