"""Exact distinct counts that roll up (inventory A2, A6, A8).

A count of distinct ids per day can't be added up to a month. Here each group
keeps the ids themselves as bitmaps: an id falls into a bucket of 32,768
neighbouring ids, and a group has one bitmap of 4 kB per bucket that it has
ids in. Bitmaps of days or batches are merged by ``OR`` into those of coarser
groups, exactly and without reading the rows again, all in built-in
aggregates that Spark combines map-side. A bucket holds one bitmap whatever
the number of rows, so a hot group or id is no hot task.

Ids are whole numbers (of any sign). The table is small where ids of a group lie
close together (row numbers, dense keys); widely scattered ids cost up to
4 kB each, for which plain ``count(DISTINCT)`` is cheaper.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "_bucket"
BITS = "_bits"
BATCH = "_batch"


def id_bitmaps(df: DataFrame, by: Sequence[str | Column], id_column: str) -> DataFrame:
    """(by.., _bucket, _bits). Groups with null ids only keep a row with an
    empty bitmap (null bucket), so that they count 0 and don't vanish."""
    if not isinstance(df.schema[id_column].dataType, T.IntegralType):
        raise ValueError(f"{id_column}: bitmaps need whole numbers; number the values first")
    x = F.col(f"`{id_column}`").cast("long")
    return df.groupBy(*by, F.bitmap_bucket_number(x).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(x)).alias(BITS))


def append_bitmaps(df: DataFrame, path: str, batch_id: str, by: Sequence[str | Column], id_column: str) -> None:
    """Store a batch's bitmaps; a batch delivered again replaces its own."""
    d = id_bitmaps(df, by, id_column).withColumn(BATCH, F.lit(batch_id))
    d.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(path)


def roll_up(bitmaps: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Bitmaps of coarser groups (and of all batches): ``OR`` per bucket."""
    return bitmaps.groupBy(*by, BUCKET).agg(F.bitmap_or_agg(BITS).alias(BITS))


def distinct_per(bitmaps: DataFrame, by: Sequence[str | Column], alias: str = "n") -> DataFrame:
    """(by.., alias): exact distinct ids per group of stored bitmaps."""
    rolled = roll_up(bitmaps, by)
    names = [c for c in rolled.columns if c not in (BUCKET, BITS)]
    return rolled.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.sum(F.bitmap_count(BITS)).alias(alias))


def stored_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    """Bitmaps of all batches; fails when no batch had a row."""
    return spark.read.parquet(path)
