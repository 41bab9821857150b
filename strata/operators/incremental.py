"""Incremental keep-first (inventory W1, K2): a batch is merged into the
stored winners instead of ranking all of Bronze again.

The winners lie in a table that is bucketed by the dedup keys and
partitioned by batch. A batch is ranked by itself (``flag_first``); its
first rows meet the stored ones in a join that reads the buckets as they
lie, so only the batch is shuffled. A row that comes before the stored one
takes its place, which demotes the former winner to a duplicate; nothing
stored is rewritten: the table keeps both, and ``winners`` takes the least
of each key, again bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.dedup import OrderSpec, _normalised_order, flag_first
from strata.operators.quality import REASON
from strata.operators.skew import row_hash
from strata.sinks.layout import delete_path

BATCH = "_merge_batch"
PLACE = "_place"


def _place(df: DataFrame, order: OrderSpec) -> Column:
    """What rows of one key are sorted by: the order, then a row hash."""
    own = [c for c in df.columns if c != BATCH]
    fields = [o.alias(f"o{i}") for i, o in enumerate(_normalised_order(df, order))]
    return F.struct(*fields, row_hash(df.select(*[F.col(f"`{c}`") for c in own])).alias("h"))


def _least(df: DataFrame, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """(key columns, _place, _row) of the least row per key."""
    whole = F.struct(_place(df, order).alias("place"), F.struct(*[F.col(f"`{c}`") for c in df.columns if c != BATCH]).alias("row"))
    best = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(whole).alias("_best"))
    return best.select(*[F.col(f"`{k}`") for k in keys], F.col("_best.place").alias(PLACE), F.col("_best.row").alias("_row"))


def winners(spark: SparkSession, table: str, keys: Sequence[str], order: OrderSpec) -> DataFrame:
    """The kept rows: the least stored row of every key, with no shuffle."""
    stored = spark.table(table)
    best = _least(stored, keys, order)
    return best.select(*[F.col(f"_row.`{c}`").alias(c) for c in stored.columns if c != BATCH])


def judge_batch(
    batch: DataFrame, keys: Sequence[str], order: OrderSpec, stored: DataFrame | None = None
) -> DataFrame:
    """Rows of ``batch``, and the stored rows that they demote, with ``_wins``
    (true for the rows that are their key's first from now on).

    Keys must not be null: such rows fail as required columns do, before
    duplicates are ranked."""
    return _judge_ranked(flag_first(batch, keys, order), keys, order, stored)


def _judge_ranked(flagged: DataFrame, keys: Sequence[str], order: OrderSpec, stored: DataFrame | None) -> DataFrame:
    """``judge_batch`` for a batch that ``flag_first`` has ranked."""
    names = [c for c in flagged.columns if c != "_is_first"]
    if stored is None:
        return flagged.withColumnRenamed("_is_first", "_wins")
    first = flagged.where("_is_first").drop("_is_first")
    later = flagged.where("not _is_first").select(*[F.col(f"`{c}`") for c in names], F.lit(False).alias("_wins"))
    known = _least(stored, keys, order)
    known = known.select(*[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)], F.col(PLACE).alias("_old"), F.col("_row").alias("_old_row"))
    on = [first[f"`{k}`"] == known[f"_k{i}"] for i, k in enumerate(keys)]
    met = first.join(known, on, "left")
    # the batch row's place is worked out after the join, so it isn't shuffled
    wins = F.col("_old").isNull() | (_place(first, order) < F.col("_old"))
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    # a batch row, and after it the stored row whose place it takes
    own = F.struct(row.alias("row"), wins.alias("wins"))
    demoted = F.struct(F.struct(*[F.col(f"_old_row.`{c}`").alias(c) for c in names]).alias("row"), F.lit(False).alias("wins"))
    both = met.select(F.explode(F.when(wins & F.col("_old").isNotNull(), F.array(own, demoted)).otherwise(F.array(own))).alias("r"))
    judged = both.select(*[F.col(f"r.row.`{c}`").alias(c) for c in names], F.col("r.wins").alias("_wins"))
    return judged.unionByName(later)


def merge_first(
    batch: DataFrame,
    batch_name: str,
    table: str,
    path: str,
    quarantine: str,
    keys: Sequence[str],
    order: OrderSpec,
    scratch: str,
    buckets: int | None = None,
) -> DataFrame:
    """Merge a batch into the winners in ``table`` (an external table at
    ``path``, made by the first batch) and write the rows that lose, with
    their reason, to ``quarantine/_merge_batch=<name>``.

    Returns the judged rows, stored once under ``scratch``. A batch that is
    merged again replaces what it wrote. ``buckets`` (by default the
    session's shuffle partitions) should be the shuffle width; Spark reads
    buckets in place only where they are at least as many.
    """
    spark = batch.sparkSession
    exists = spark.catalog.tableExists(table)
    stored = spark.table(table).where(F.col(BATCH) != batch_name) if exists else None
    if stored is None:
        judge_batch(batch, keys, order).write.mode("overwrite").parquet(scratch)
    else:
        # ranked once and stored: first rows and later ones are judged apart,
        # and would else shuffle the batch twice
        ranked = f"{scratch.rstrip('/')}-ranked"
        flag_first(batch, keys, order).write.mode("overwrite").parquet(ranked)
        _judge_ranked(spark.read.parquet(ranked), keys, order, stored).write.mode("overwrite").parquet(scratch)
        delete_path(spark, ranked)
    judged = spark.read.parquet(scratch)
    lost = judged.where("not _wins").drop("_wins").withColumns({REASON: F.lit("duplicate"), BATCH: F.lit(batch_name)})
    lost.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BATCH).parquet(quarantine)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    won = judged.where("_wins").drop("_wins").withColumn(BATCH, F.lit(batch_name)).repartition(n, *[F.col(f"`{k}`") for k in keys])
    if exists:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({BATCH} = '{batch_name}')")
        delete_path(spark, f"{path.rstrip('/')}/{BATCH}={batch_name}")  # the table is external
    won.write.mode("append").partitionBy(BATCH).bucketBy(n, *keys).sortBy(*keys).option("path", path).format("parquet").saveAsTable(table)
    return judged
