"""Row filters on lineage and text (inventory F6-F9).

Plain ``filter`` expressions, so Catalyst pushes them into the Parquet
scan (and prunes ``ingestion_date`` partitions) where it can.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Marks left when UTF-8 text is decoded as Latin-1 (a
# Latin-1 lead byte 0xC2/0xC3 read as a character followed by a
# continuation byte 0x80-0xBF), and the Unicode replacement character.
MOJIBAKE_PATTERN = "[ÂÃ][\u0080-¿]|�"


def of_batch(df: DataFrame, batch_id: str) -> DataFrame:
    """rows of one ingest batch."""
    return df.filter(F.col("batch_id") == F.lit(batch_id))


def from_file(df: DataFrame, name: str) -> DataFrame:
    """rows that came from one source file (lineage lookup)."""
    return df.filter(F.col("source_file") == F.lit(name))


def contains_any(df: DataFrame, column: str, texts: Sequence[str]) -> DataFrame:
    """F8: rows whose text contains any of the given substrings (accents kept)."""
    cond: Column | None = None
    for t in texts:
        c = F.col(f"`{column}`").contains(t)
        cond = c if cond is None else cond | c
    return df.filter(cond) if cond is not None else df


def like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """F8: SQL ``LIKE`` filter."""
    return df.filter(F.col(f"`{column}`").like(pattern))


def mojibake_mask(column: str | Column) -> Column:
    """true where a text value shows Latin-1/UTF-8 confusion."""
    c = F.col(f"`{column}`") if isinstance(column, str) else column
    return c.rlike(MOJIBAKE_PATTERN)


def mojibake(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """per string column, how many values look double-decoded (one scan)."""
    cols = list(columns) if columns is not None else [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, suspect long")
    wide = df.agg(*[F.count_if(mojibake_mask(c)).alias(c) for c in cols])
    return wide.unpivot([], [F.col(f"`{c}`").alias(c) for c in cols], "column", "suspect")
