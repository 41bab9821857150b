"""Row hash used as a deterministic tie-breaker.

How hot keys are treated, everywhere in the library: keyed operators
reduce each key with an aggregate, which Spark combines map-side (a hot
key is one row per task before the shuffle), and join the result back.
The joins are null-safe, so both sides get an exchange of their own below
the sort, the form in which adaptive execution splits a skewed partition.
Whether a side is broadcast is left to Spark, which goes by bytes. There
are no row thresholds, and no job runs while a plan is built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_hash(df: DataFrame, exclude: tuple[str, ...] = ()) -> Column:
    """Deterministic 64-bit hash of a row's columns."""
    cols = [F.col(f"`{c}`") for c in df.columns if c not in exclude]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def null_safe_on(pairs: list[tuple[Column, Column]]) -> Column:
    """Null-safe equality over (left, right) pairs of columns."""
    cond = pairs[0][0].eqNullSafe(pairs[0][1])
    for left, right in pairs[1:]:
        cond = cond & left.eqNullSafe(right)
    return cond
