"""Rankings, top-N, gaps, unions and reconciliation (inventory W2-W9).

Global orderings never run as a single-partition window over unbounded
data: ``rank_all`` is a range-partitioned sort plus per-partition offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.session import scratch_dir

OrderSpec = Sequence[str | tuple[str, str]]


def _order_cols(order: OrderSpec) -> list[Column]:
    out = []
    for item in order:
        name, direction = (item, "asc") if isinstance(item, str) else item
        c = F.col(f"`{name}`")
        out.append(c.desc() if direction.lower() == "desc" else c.asc())
    return out


def rank_all(df: DataFrame, order: OrderSpec, rank_col: str = "rank", *, partitions: int | None = None) -> DataFrame:
    """Dense 1..N numbering in a total order (``order`` must break ties).

    One plan for any size: a range-partitioned sort, rows counted per
    partition, offsets summed over those few counts, and the offset table
    (one row per partition) broadcast back, so no task ever holds more than
    one range of the data. The sorted frame is written to the shared
    checkpoint folder first, so both uses see the same boundaries.
    """
    cols = _order_cols(order)
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    sorted_df = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols)
    sorted_df = sorted_df.withColumns({"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    path = scratch_dir(spark, "rank")
    sorted_df.write.parquet(path)
    staged = spark.read.parquet(path)
    per_part = staged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"), F.min("_mid").alias("_m0"))
    offsets = per_part.withColumn(
        "_off", F.coalesce(F.sum("_cnt").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_pid", "_off", "_m0")
    return (
        staged.join(F.broadcast(offsets), "_pid")
        .withColumn(rank_col, (F.col("_off") + F.col("_mid") - F.col("_m0") + 1).cast("bigint"))
        .drop("_pid", "_mid", "_off", "_m0")
    )


def top_n(df: DataFrame, order: OrderSpec, n: int) -> DataFrame:
    """First ``n`` rows in a total order (TakeOrderedAndProject: each
    task keeps its own top ``n``, so nothing large moves)."""
    return df.orderBy(*_order_cols(order)).limit(n)


def top_n_per_group(df: DataFrame, groups: Sequence[str], order: OrderSpec, n: int, rank_col: str | None = None) -> DataFrame:
    """Q21 helper: first ``n`` rows per group.

    ``row_number() <= n`` lets Spark insert a partial WindowGroupLimit
    before the shuffle, so a hot group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*groups).orderBy(*_order_cols(order))
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_col).withColumn(rank_col, F.col(rank_col).cast("bigint")) if rank_col else out.drop("_rn")


def gaps(
    df: DataFrame,
    date_col: str,
    series: Sequence[str] = (),
    step_days: int = 1,
    start_col: str = "gap_start",
    end_col: str = "gap_end",
) -> DataFrame:
    """Holes in a daily series, reported as (last date before, next date after).

    Works on distinct dates per series (at most one row per calendar day,
    so each window partition is bounded by the calendar span).
    """
    d = df.select(*series, F.to_date(F.col(date_col)).alias("_d")).where(F.col("_d").isNotNull()).distinct()
    w = Window.partitionBy(*series).orderBy("_d")
    nxt = d.withColumn("_n", F.lead("_d").over(w))
    return nxt.filter(F.datediff("_n", "_d") > step_days).select(*series, F.col("_d").alias(start_col), F.col("_n").alias(end_col))


def top_reasons(quarantine: DataFrame, n: int = 10, reason: str = "_dq_failure_reason") -> DataFrame:
    """Most frequent failure reasons, ties broken by reason text."""
    return (
        quarantine.groupBy(F.col(reason).alias("reason"))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), F.asc("reason"))
        .limit(n)
    )


def head(df: DataFrame, n: int = 20) -> DataFrame:
    """First ``n`` rows (a preview; not ordered)."""
    return df.limit(n)


def union_all(*dfs: DataFrame) -> DataFrame:
    """Union by column name; columns missing on one side become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def schema_diff(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Columns only in one frame, or with different types.

    Works on the two schemas (metadata), not on data.
    """
    spark = a.sparkSession
    sa = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    sb = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    rows = []
    for name in list(sa) + [n for n in sb if n not in sa]:
        ta, tb = sa.get(name), sb.get(name)
        if ta == tb:
            continue
        status = f"only_{left}" if tb is None else f"only_{right}" if ta is None else "type_changed"
        rows.append((name, ta, tb, status))
    return spark.createDataFrame(rows, f"column string, {left}_type string, {right}_type string, status string")


def reconcile(source: DataFrame, kept: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Row counts of source, kept and quarantined, and whether they add up."""
    tagged = (
        source.select(F.lit("s").alias("_t"))
        .unionByName(kept.select(F.lit("k").alias("_t")))
        .unionByName(quarantined.select(F.lit("q").alias("_t")))
    )
    cnt = tagged.agg(
        F.count_if(F.col("_t") == "s").alias("source_rows"),
        F.count_if(F.col("_t") == "k").alias("kept_rows"),
        F.count_if(F.col("_t") == "q").alias("quarantined_rows"),
    )
    return cnt.withColumn("ok", F.col("source_rows") == F.col("kept_rows") + F.col("quarantined_rows"))


def missing_rows(source: DataFrame, kept: DataFrame, quarantined: DataFrame, columns: Sequence[str]) -> DataFrame:
    """W9, row level: source rows (as multisets over ``columns``) in neither output."""
    cols = list(columns)
    both = kept.select(*cols).unionByName(quarantined.select(*cols))
    return source.select(*cols).exceptAll(both)
