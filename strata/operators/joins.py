"""Joins against reference tables (inventory J1-J6, P13, A14).

All are one plain left join on distinct or unique keys. Whether the
reference is broadcast is Spark's choice, by its size in bytes; otherwise
adaptive execution splits the skewed partitions of the big side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.operators.skew import null_safe_on


def key_set(ref: DataFrame, column: str, alias: str = "_ref_key") -> DataFrame:
    """Distinct non-null keys of a reference column."""
    return ref.select(F.col(f"`{column}`").alias(alias)).where(F.col(alias).isNotNull()).distinct()


def lookup_hit(df: DataFrame, column: str, ref: DataFrame, ref_column: str, hit: str = "_ref_hit") -> DataFrame:
    """Add boolean ``hit``: does ``df[column]`` occur in ``ref[ref_column]``?

    Single pass; every input row comes out once (the key side is distinct),
    and a null never hits.
    """
    keys = key_set(ref, ref_column, "_ref_key")
    j = df.join(keys, null_safe_on([(df[f"`{column}`"], keys["_ref_key"])]), "left")
    return j.withColumn(hit, F.col("_ref_key").isNotNull()).drop("_ref_key")


# A lookup with one row per input file is broadcast up to so many files
# (some tens of MB); the number comes from the scan's own listing.
MAX_BROADCAST_FILES = 100_000


def file_lookup(big: DataFrame, per_file: DataFrame, on: str, how: str, files: int) -> DataFrame:
    """Join rows read from files to a frame with one row per file.

    Broadcast within ``MAX_BROADCAST_FILES``, so the rows are not shuffled;
    beyond it a plain join, whose skewed partitions (large files) adaptive
    execution splits.
    """
    return big.join(F.broadcast(per_file) if files <= MAX_BROADCAST_FILES else per_file, on, how)


def fk_orphans(df: DataFrame, column: str, ref: DataFrame, ref_column: str | None = None) -> DataFrame:
    """Rows whose key is not in the reference (null keys included)."""
    return (
        lookup_hit(df, column, ref, ref_column or column, "_ref_hit")
        .filter(~F.col("_ref_hit"))
        .drop("_ref_hit")
    )


def fk_valid(df: DataFrame, column: str, ref: DataFrame, ref_column: str | None = None) -> DataFrame:
    """Rows whose key is in the reference."""
    return (
        lookup_hit(df, column, ref, ref_column or column, "_ref_hit")
        .filter(F.col("_ref_hit"))
        .drop("_ref_hit")
    )


def check_unique(ref: DataFrame, on: Sequence[str]) -> DataFrame:
    """Reference keys that occur more than once (empty = join cannot fan out)."""
    return ref.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def denormalise(
    df: DataFrame,
    ref: DataFrame,
    on: str | Sequence[str] | Column,
    columns: Sequence[str] | None = None,
    how: str = "left",
    *,
    ref_on: str | Sequence[str] | None = None,
) -> DataFrame:
    """Left join a reference table, keeping ``columns`` of it.

    ``on`` names the key on ``df``; ``ref_on`` the key on ``ref`` when it
    is named differently. Null keys match nothing.
    """
    left_keys = [on] if isinstance(on, str) else list(on)  # type: ignore[arg-type]
    right_keys = left_keys if ref_on is None else ([ref_on] if isinstance(ref_on, str) else list(ref_on))
    keep = list(columns) if columns is not None else [c for c in ref.columns if c not in right_keys]
    r = ref.select(*[F.col(f"`{k}`").alias(f"_jk{i}") for i, k in enumerate(right_keys)], *[F.col(f"`{c}`") for c in keep])
    r = r.dropna(subset=[f"_jk{i}" for i in range(len(right_keys))])
    cond = null_safe_on([(df[f"`{k}`"], r[f"_jk{i}"]) for i, k in enumerate(left_keys)])
    return df.join(r, cond, how).drop(*[f"_jk{i}" for i in range(len(right_keys))])


def star(df: DataFrame, dims: Sequence[tuple[DataFrame, str | Sequence[str], Sequence[str] | None] | tuple[DataFrame, str, Sequence[str] | None, str]]) -> DataFrame:
    """Chain of left joins to dimension tables.

    Each item is ``(ref, on, columns)`` or ``(ref, on, columns, ref_on)``.
    """
    out = df
    for item in dims:
        ref, on, cols = item[0], item[1], item[2]
        ref_on = item[3] if len(item) > 3 else None  # type: ignore[misc]
        out = denormalise(out, ref, on, cols, ref_on=ref_on)
    return out


def checked_denormalise(df: DataFrame, ref: DataFrame, on: str | Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """J3 + J4: refuse to join when a reference key is duplicated.

    The check is a bounded action over the reference only.
    """
    keys = [on] if isinstance(on, str) else list(on)
    dup = check_unique(ref, keys).limit(1).count()
    if dup:
        raise ValueError(f"reference key {keys} is not unique; the join would duplicate rows")
    return denormalise(df, ref, keys, columns)
