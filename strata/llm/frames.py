"""Frame helpers: carry a table's own columns through an Arrow task."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def kept_columns(df: DataFrame, added: tuple[str, ...]) -> list[str]:
    """The columns that none of ``added`` replaces (names compare as in SQL)."""
    gone = {a.lower() for a in added}
    return [c for c in df.columns if c.lower() not in gone]


def only(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in names])


def with_types(schema: StructType, ddl: str) -> StructType:
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


# Rows of one Arrow batch; whole texts travel, so a batch is a few MB.
BATCH_ROWS = 500


def text_batches(spark: SparkSession) -> None:
    """Set the session's Arrow batches to ``BATCH_ROWS`` rows (Spark's default
    is 10,000), which bounds what a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def release_memory() -> None:
    """At the end of a task, hand freed memory back to the system: Spark keeps
    its Python workers for later tasks, and idle ones count as well."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
