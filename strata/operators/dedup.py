"""Keep-first deduplication (inventory W1, Q3) that survives hot keys.

One plan for every size: ``min(struct(order, tie-break, row id))`` per key
is an aggregate that Spark combines map-side, so a key with a third of all
rows, identical ones included, is one row per task before the shuffle. The
winners are joined back and a row is first when it equals its key's
winner. The join is null-safe; adaptive execution splits its skewed
partitions. No count, cap or salt decides anything, and no job runs while
the plan is built.

The row id tells identical rows apart. Rows of stored Parquet have one:
file path and row index. Frames without one are first counted by their
whole content (again combined map-side), so each distinct row is there
once; copies come back from the count, in blocks spread over all tasks,
and only the first of them is first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import resolves
from strata.operators.skew import null_safe_on, row_hash

# Copies of a row that one task writes out at a time.
COPY_BLOCK = 4096

OrderSpec = Sequence[str | tuple[str, str]]


def _normalised_order(df: DataFrame, order: OrderSpec) -> list[Column]:
    """Order fields that sort ascending in both a window and ``min(struct)``.

    ``(col, "desc")`` becomes (is-null flag, negated value) so nulls stay
    last, as in a descending window; only numeric and temporal columns can
    be descending.
    """
    out: list[Column] = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        if name not in df.columns:
            raise ValueError(f"order column {name!r} is not in the frame")
        c = F.col(f"`{name}`")
        if direction.lower() == "asc":
            out.append(c)
            continue
        dt = df.schema[name].dataType
        if isinstance(dt, T.NumericType):
            neg = -c
        elif isinstance(dt, T.DateType):
            neg = -F.unix_date(c)
        elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            neg = -F.unix_micros(c.cast("timestamp"))
        else:
            raise ValueError(f"descending order is supported on numeric and temporal columns, not {name!r}")
        out += [c.isNull(), neg]
    return out


def default_order(df: DataFrame) -> list[str]:
    """Oldest ingestion first, where the frame has that column."""
    return ["ingestion_date"] if "ingestion_date" in df.columns else []


def tie_break_hash(df: DataFrame, keys: Sequence[str], order: OrderSpec, tie_break: str | Sequence[str]) -> Column:
    """The last sort field of keep-first.

    ``"row"`` hashes the whole row (which of two rows tied on key and
    order is kept never changes between runs); ``"order"`` hashes only key
    and order columns, so a scan reads no other column — use it when the
    order is already total; a list hashes the named columns.
    """
    if tie_break == "row":
        return row_hash(df)
    if tie_break == "order":
        names = list(keys) + [o if isinstance(o, str) else o[0] for o in order]
    else:
        names = list(tie_break)
    cols = [F.col(f"`{c}`") for c in dict.fromkeys(names) if c in df.columns]
    return F.xxhash64(*cols) if cols else F.lit(0).cast("long")


def _row_id(df: DataFrame) -> Column | None:
    """File path and row index, where the frame still knows them."""
    if "_metadata" in df.columns:
        return None  # a column of the data, not the scan's
    if not resolves(df, "_metadata.file_path", "_metadata.row_index"):
        return None
    return F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))


def flag_first(
    df: DataFrame,
    keys: Sequence[str],
    order: OrderSpec = (),
    *,
    alive: Column | None = None,
    out: str = "_is_first",
    tie_break: str | Sequence[str] = "row",
    clustered: bool = False,
) -> DataFrame:
    """Add boolean ``out``: true on the one row kept per key, false on the others.

    ``order`` sorts rows inside a key (first wins); a hash (see
    ``tie_break_hash``) breaks remaining ties, so the choice is
    deterministic. Rows where ``alive`` is false take no part and get null.
    Null key values count as equal. Exactly one living row per key is first
    whatever the tie-break.

    ``clustered``: the frame lies bucketed by ``keys`` (see
    ``write_bronze_bucketed``), so a window ranks it in place, unshuffled.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("dedup needs at least one key column")
    ordf = _normalised_order(df, order)
    if clustered:
        return _ranked_in_place(df, keys, ordf, alive, out, tie_break_hash(df, keys, order, tie_break))
    names = df.columns
    rid = _row_id(df)
    b = df.withColumn("_tb", tie_break_hash(df, keys, order, tie_break))
    live = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    b = b.withColumn("_alive", live)
    if rid is not None:
        b = b.withColumn("_rid", rid)
    else:
        # identical rows become one row with a count
        b = b.groupBy(*[F.col(f"`{c}`") for c in names], "_tb", "_alive").agg(F.count(F.lit(1)).alias("_copies"))
        b = b.withColumn("_rid", F.struct(*[F.col(f"`{c}`") for c in names]))
    place = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(ordf)], F.col("_tb").alias("_otb"), F.col("_rid").alias("_orid"))
    winners = (
        b.where("_alive")
        .groupBy(*[F.col(f"`{k}`").alias(f"_wk{i}") for i, k in enumerate(keys)])
        .agg(F.min(place)["_orid"].alias("_win"))
    )
    # the row id alone tells the winner, so order and hash stay out of the join
    on = null_safe_on([(b[f"`{k}`"], winners[f"_wk{i}"]) for i, k in enumerate(keys)])
    first = F.when(F.col("_alive"), F.col("_rid") == F.col("_win"))
    joined = b.join(winners, on, "left").withColumn(out, first)
    own = [F.col(f"`{c}`") for c in names]
    if rid is not None:
        return joined.select(*own, out)
    # one of each, and the other copies apart: a row with very many of them is
    # cut into blocks, which are spread over tasks before they are written out
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = joined.where("_copies > 1").select(*own, out, (F.col("_copies") - 1).alias("_more"))
    last = F.floor((F.col("_more") - 1) / COPY_BLOCK)
    blocks = more.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition(spread)
    size = F.least(F.lit(COPY_BLOCK).cast("bigint"), F.col("_more") - F.col("_block") * COPY_BLOCK)
    copies = blocks.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), size)))
    return joined.select(*own, out).unionByName(copies.select(*own, F.when(F.col(out).isNotNull(), F.lit(False)).alias(out)))


def _ranked_in_place(df: DataFrame, keys: list[str], ordf: list[Column], alive: Column | None, out: str, tie: Column) -> DataFrame:
    live = F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))
    # the dead sort behind the living, so the first living row is number one
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(F.col("_dead"), *ordf, F.col("_tb"))
    b = df.withColumn("_tb", tie).withColumn("_dead", ~live)
    return b.withColumn(out, F.when(~F.col("_dead"), F.row_number().over(w) == 1)).drop("_tb", "_dead")


def window_flag_first(
    df: DataFrame, keys: Sequence[str], order: OrderSpec = (), out: str = "_is_first", tie_break: str | Sequence[str] = "row"
) -> DataFrame:
    """The plain one-shuffle form, for keys known to be free of skew."""
    ordf = _normalised_order(df, order)
    b = df.withColumn("_tb", tie_break_hash(df, keys, order, tie_break))
    w = Window.partitionBy(*[F.col(f"`{k}`") for k in keys]).orderBy(*ordf, F.col("_tb"))
    return b.withColumn(out, F.row_number().over(w) == 1).drop("_tb")


def dedup(
    df: DataFrame,
    keys: Sequence[str],
    order: OrderSpec | None = None,
    *,
    tie_break: str | Sequence[str] = "row",
) -> tuple[DataFrame, DataFrame]:
    """(kept, duplicates) — first row per key kept, the rest returned apart.

    Both frames come from one flagged plan; write the flagged frame once
    (``strata.sinks.write_split``) when both are materialised, so the
    shuffle runs once.
    """
    flagged = flag_first(df, keys, default_order(df) if order is None else order, tie_break=tie_break)
    kept = flagged.filter(F.col("_is_first")).drop("_is_first")
    dups = flagged.filter(~F.col("_is_first")).drop("_is_first").withColumn(
        "_dq_failure_reason", F.lit("duplicate")
    )
    return kept, dups


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """J4 helper: keys that occur more than once, with their counts.

    A partial aggregate: hot keys collapse map-side before the shuffle.
    """
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
    )
