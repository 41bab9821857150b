"""Row-level reconciliation by additive fingerprints (inventory W9, Q11).

``exceptAll`` shuffles every row of both tables. Here each table is stored by
hash range of its keys, with one small row per range beside it: the number of
rows and the sums of four 32-bit words of a 128-bit hash of each row. Sums
don't depend on the order of rows and count copies, so two ranges hold the same
multiset of rows when count and sums agree (but for a chance of about 2^-128).
Only ranges that differ are read again and compared row by row.

A sum of 32-bit words stays in 63 bits up to 2^31 rows of a range; beyond that
Spark's checked addition fails the job rather than wrap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE = "_range"
FINGERPRINTS_DIR = "_fingerprints"
SCHEMA_DIR = "_schema"  # a file without rows: an empty table has no other that tells its columns
MAX_RANGES = 4096
_WORDS = ("w0", "w1", "w2", "w3")


def _hash(columns: Sequence[str], seed: int) -> Column:
    """64-bit hash of the columns; a null is told from a missing neighbour."""
    parts = [p for c in columns for p in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))]
    return F.xxhash64(F.lit(seed), *parts)


def _check(df: DataFrame, columns: Sequence[str]) -> None:
    for c in columns:
        if isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)):
            raise ValueError(f"column {c}: maps and variants have no stable hash; compare their entries or JSON text")


def hash_range(keys: Sequence[str], ranges: int) -> Column:
    return F.pmod(_hash(keys, 0), F.lit(ranges)).cast("int")


def fingerprints(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (RANGE,)) -> DataFrame:
    """(by.., n, w0..w3): rows and word sums per range, combined map-side."""
    _check(df, columns)
    low = F.lit(0xFFFFFFFF).cast("long")
    d = df.select(*by, _hash(columns, 1).alias("h"), _hash(columns, 2).alias("g"))
    words = [F.col("h").bitwiseAND(low), F.shiftrightunsigned("h", 32), F.col("g").bitwiseAND(low), F.shiftrightunsigned("g", 32)]
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(w).alias(name) for w, name in zip(words, _WORDS)])


def write_by_range(df: DataFrame, path: str, keys: Sequence[str], ranges: int = 256) -> None:
    """Store ``df`` by hash range of ``keys`` with its fingerprints beside it.

    The rebalance hint splits a range that a hot key fills and joins small
    ones. Tables to be compared need the same keys and number of ranges.
    """
    if not 1 <= ranges <= MAX_RANGES:
        raise ValueError(f"ranges must be 1 to {MAX_RANGES}")
    columns = sorted(df.columns)
    _check(df, columns)
    d = df.withColumn(RANGE, hash_range(keys, ranges))
    d.hint("rebalance", F.col(RANGE)).write.mode("overwrite").partitionBy(RANGE).parquet(path)
    df.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/{SCHEMA_DIR}")
    # from the stored rows, so that rows lost on the way are seen
    stored = _stored(df.sparkSession, path)
    fingerprints(stored, columns).write.mode("overwrite").parquet(f"{path}/{FINGERPRINTS_DIR}")


def _stored(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{SCHEMA_DIR}").schema
    return spark.read.schema(T.StructType([*schema.fields, T.StructField(RANGE, T.IntegerType())])).parquet(path)


def differing_ranges(spark: SparkSession, source: str, output: str) -> DataFrame:
    """(_range, source_rows, output_rows) of the ranges that are not equal:
    a join of two tables of at most ``MAX_RANGES`` rows."""
    a = spark.read.parquet(f"{source}/{FINGERPRINTS_DIR}").alias("a")
    b = spark.read.parquet(f"{output}/{FINGERPRINTS_DIR}").alias("b")
    same = F.lit(True)
    for c in ("n", *_WORDS):
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return a.join(b, RANGE, "full").where(~same).select(
        RANGE, F.coalesce("a.n", F.lit(0)).alias("source_rows"), F.coalesce("b.n", F.lit(0)).alias("output_rows")
    )


def reconcile_rows(spark: SparkSession, source: str, output: str, keys: Sequence[str]) -> DataFrame:
    """W9, row level: keys whose rows differ between two stored tables.

    Returns the keys, ``kind``, ``missing`` (source rows that the output
    lacks) and ``surplus`` (output rows that the source lacks). Kinds: ``lost``
    (only missing), ``doubled`` (surplus of rows that the source has), ``added``
    (surplus of a key that the source lacks), ``altered`` (all else). Only
    unequal ranges are read (partition filter); their rows are counted per
    content, combined map-side.
    """
    a, b = _stored(spark, source), _stored(spark, output)
    if sorted(a.columns) != sorted(b.columns):
        raise ValueError("the tables have different columns")
    columns = sorted(c for c in a.columns if c != RANGE)
    unequal = [r[RANGE] for r in differing_ranges(spark, source, output).select(RANGE).collect()]  # at most MAX_RANGES numbers

    def side(df: DataFrame, s: int, o: int) -> DataFrame:
        rows = df.where(F.col(RANGE).isin(unequal)) if unequal else df.limit(0)
        return rows.select(
            *[F.col(f"`{k}`") for k in keys], _hash(columns, 1).alias("_h"), _hash(columns, 2).alias("_g"),
            F.lit(s).alias("_s"), F.lit(o).alias("_o"),
        )

    q = [F.col(f"`{k}`") for k in keys]
    rows = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*q, "_h", "_g").agg(F.sum("_s").alias("s"), F.sum("_o").alias("o"))
    gone, more = F.greatest(F.col("s") - F.col("o"), F.lit(0)), F.greatest(F.col("o") - F.col("s"), F.lit(0))
    per_key = rows.groupBy(*q).agg(
        F.sum(gone).alias("missing"), F.sum(more).alias("surplus"), F.sum("s").alias("_s"),
        F.sum(F.when(F.col("s") == 0, more).otherwise(0)).alias("_unknown"),
    )
    kind = (
        F.when(F.col("surplus") == 0, "lost")
        .when((F.col("missing") == 0) & (F.col("_s") == 0), "added")
        .when((F.col("missing") == 0) & (F.col("_unknown") == 0), "doubled")
        .otherwise("altered")
    )
    return per_key.where((F.col("missing") > 0) | (F.col("surplus") > 0)).select(*q, kind.alias("kind"), "missing", "surplus")
