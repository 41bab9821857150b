"""Incremental file ingest and streaming Silver (inventory S21, T1-T3).

* ``stream_bronze`` (T1/S21): a file-source stream with a fixed schema,
  lineage columns, written by the file sink (exactly once through its
  commit log), triggered ``availableNow`` so each run picks up only new
  files and stops.
* ``stream_silver`` (T2/T3): ``foreachBatch`` runs the batch classifier
  on every epoch. Each epoch overwrites its own folder ``epoch=<id>``,
  so a replayed epoch replaces rather than duplicates its output. Keys
  whose first row came in an earlier epoch count as duplicates, which
  makes deduplication hold across epochs with the batch rule order (rank
  first, then rules). Which keys those are comes from the earlier epochs'
  key files, or, with ``seen="state"``, from keyed state (``state.py``):
  the epoch's distinct living keys go to ``out/_keys``, a stateful query
  passes the known ones on to ``out/_again``, and the epoch reads back its
  own part of these, so no epoch reads earlier epochs' keys. State costs a
  Python call per distinct key of an epoch, key files a read of all keys
  so far: prefer state for streams that run for long.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.contract import Contract
from strata.functions.columns import LINEAGE_COLUMNS
from strata.operators.quality import REASON, classify, living_keys
from strata.sinks.layout import path_exists
from strata.sources.dialect import Dialect
from strata.streaming.state import EPOCH, keys_seen_before, rocksdb_state

FIRST = "_dq_first"
# the epochs' keys, the state and the keys known before; a leading "_" keeps
# these folders out of reads of ``out``
KEYS_DIR = "_keys"
STATE_DIR = "_state"
AGAIN_DIR = "_again"


def bronze_stream(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    dialect: Dialect = Dialect(),
    fmt: str = "csv",
    batch_id: str = "stream",
    max_files_per_trigger: int | None = None,
) -> DataFrame:
    """Streaming scan of a folder with lineage columns (schema must be given)."""
    data_schema = T.StructType([f for f in schema.fields if f.name not in LINEAGE_COLUMNS])
    reader = spark.readStream.format(fmt).schema(data_schema)
    if fmt == "csv":
        if dialect.preamble not in (0, None):
            raise ValueError("a CSV stream can't skip title lines: ingest such files in batches (run_bronze), which reads new files only")
        reader = reader.options(**dialect.options())
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.load(source_dir)
    return df.withColumns(
        {
            "ingestion_date": F.current_date(),
            "source_file": F.col("_metadata.file_path"),
            "batch_id": F.lit(batch_id),
        }
    )


def stream_bronze(
    spark: SparkSession,
    source_dir: str,
    schema: T.StructType,
    out: str,
    checkpoint: str,
    dialect: Dialect = Dialect(),
    fmt: str = "csv",
    batch_id: str = "stream",
    wait: bool = True,
) -> StreamingQuery:
    """Append new files to Bronze (Parquet, partitioned by date)."""
    q = (
        bronze_stream(spark, source_dir, schema, dialect, fmt, batch_id)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("ingestion_date")
        .trigger(availableNow=True)
        .start(out)
    )
    if wait:
        q.awaitTermination()
    return q


def silver_epoch_writer(
    contract: Contract,
    out: str,
    *,
    check_time: _dt.datetime | None = None,
    fmt: str = "parquet",
    seen: str = "files",
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of ``stream_silver`` (usable on its own)."""

    if seen not in ("files", "state"):
        raise ValueError(f"seen is 'files' or 'state', not {seen!r}")
    root = out.rstrip("/")
    keys_dir = f"{root}/{KEYS_DIR}"

    def in_earlier_files(spark: SparkSession, epoch_id: int) -> DataFrame | None:
        if not path_exists(spark, keys_dir):
            return None
        earlier = spark.read.format(fmt).load(keys_dir)
        return earlier.filter(F.col(EPOCH) < epoch_id).select(*contract.dedup_keys) if EPOCH in earlier.columns else None

    def seen_before(batch: DataFrame, epoch_id: int) -> DataFrame:
        """Dedup keys of this epoch that earlier epochs had."""
        spark = batch.sparkSession
        names = list(contract.dedup_keys)
        keys = living_keys(batch, contract).withColumn(EPOCH, F.lit(epoch_id).cast("bigint"))
        own = f"{keys_dir}/batch-{epoch_id}"
        # a replayed epoch has the same keys; the stateful query may be half-way through these files
        if not path_exists(spark, f"{own}/_SUCCESS"):
            keys.write.format(fmt).mode("overwrite").save(own)
        source = spark.readStream.format(fmt).schema(keys.schema).load(f"{keys_dir}/*")
        with rocksdb_state(spark):
            query = (
                keys_seen_before(source, names)
                .writeStream.format(fmt)
                .option("checkpointLocation", f"{root}/{STATE_DIR}")
                .partitionBy(EPOCH)
                .trigger(availableNow=True)
                .start(f"{root}/{AGAIN_DIR}")
            )
        query.awaitTermination()
        again = f"{root}/{AGAIN_DIR}/{EPOCH}={epoch_id}"
        key_columns = [F.col(f"`{k}`") for k in names]
        if not path_exists(spark, again):
            return keys.select(*key_columns).limit(0)
        # only this epoch's folder: files of a failed attempt hold the same keys
        return spark.read.format(fmt).load(again).select(*key_columns)

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        # the batch is read for its keys and by the write: keep it once
        # (memory and disk; a lost block is recomputed from the same files)
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            known = None
            if contract.dedup_keys:
                known = seen_before(batch, epoch_id) if seen == "state" else in_earlier_files(batch.sparkSession, epoch_id)
            flagged = classify(batch, contract, check_time=check_time, seen_keys=known, first_flag=FIRST)
            epoch_path = f"{root}/{EPOCH}={epoch_id}"
            flagged.write.format(fmt).mode("overwrite").save(epoch_path)
        finally:
            batch.unpersist()
        if contract.dedup_keys and seen == "files":
            # this epoch's first-row keys, narrow and distinct, for later epochs
            firsts = batch.sparkSession.read.format(fmt).load(epoch_path).filter(F.col(FIRST)).select(*contract.dedup_keys).distinct()
            firsts.write.format(fmt).mode("overwrite").save(f"{keys_dir}/{EPOCH}={epoch_id}")

    return write_epoch


def stream_silver(
    bronze: DataFrame,
    contract: Contract,
    out: str,
    checkpoint: str,
    *,
    check_time: _dt.datetime | None = None,
    wait: bool = True,
    seen: str = "files",
) -> StreamingQuery:
    """Classify each epoch of a Bronze stream into ``out/epoch=<id>``.

    ``seen`` says where keys of earlier epochs are looked up: in their key
    ``"files"`` or in keyed ``"state"``; a stream stays with its choice.
    Read the result with ``silver_outputs(spark, out)``.
    """
    q = (
        bronze.writeStream.foreachBatch(silver_epoch_writer(contract, out, check_time=check_time, seen=seen))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    if wait:
        q.awaitTermination()
    return q


def stream_silver_rules(
    bronze: DataFrame,
    contract: Contract,
    out: str,
    checkpoint: str,
    *,
    check_time: _dt.datetime | None = None,
    wait: bool = True,
) -> StreamingQuery:
    """T2 for contracts without dedup keys: a plain streaming query.

    Coercion, required, range, custom and foreign-key rules are a
    projection plus stream-static joins, so the classifier runs inside
    the stream itself; the file sink writes each row under
    ``_dq_outcome=kept|quarantined`` exactly once (its commit log), and
    no ``foreachBatch`` is needed. Contracts with dedup keys need state
    across epochs: use ``stream_silver``.
    """
    if contract.dedup_keys:
        raise ValueError("contracts with dedup keys need stream_silver (cross-epoch state)")
    flagged = classify(bronze, contract, check_time=check_time)
    outcome = F.when(F.col(REASON).isNull(), F.lit("kept")).otherwise(F.lit("quarantined"))
    q = (
        flagged.withColumn("_dq_outcome", outcome)
        .writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .partitionBy("_dq_outcome")
        .trigger(availableNow=True)
        .start(out)
    )
    if wait:
        q.awaitTermination()
    return q


def silver_outputs(spark: SparkSession, out: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) across all epochs of a streaming Silver folder."""
    flagged = spark.read.format(fmt).load(out)
    kept = flagged.filter(F.col(REASON).isNull()).drop("_dq_failure_value", "_dq_check_time", REASON, FIRST)
    quarantined = flagged.filter(F.col(REASON).isNotNull()).drop(FIRST)
    return kept, quarantined
