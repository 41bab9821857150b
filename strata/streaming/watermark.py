"""Streaming Silver with bounded state (inventory T3).

``stream_silver_within`` classifies every epoch of a stream as
``stream_silver`` does, under a watermark: the latest event time that a key of
an earlier epoch first came with, less ``delay``. Rows at or below it are
quarantined as ``late arrival``; the others are ranked inside their epoch, and keys that an
earlier epoch had are found by ``dropDuplicatesWithinWatermark``, whose state
forgets a key once the watermark has passed its event time plus ``delay``.
State therefore holds the keys of a time span, however long the stream runs.

Rule order (first failure wins): coercion, required columns (the event time is
one), late arrival, duplicate, range, foreign key, custom. Copies of a key
within ``delay`` of its first row are always duplicates. A key that comes
again later, with a newer event time, counts as new once it is forgotten.

An epoch's rows go to ``out/epoch=<id>``; a replayed epoch replaces them. Its
watermark comes from the mark that the epoch before it left, so it is the same
in every attempt. One event time far in the future makes all rows after it
late: they are kept in the quarantine, not lost.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strata.contract import Contract, Rule
from strata.functions.columns import rename_present
from strata.operators.quality import REASON, VALUE, classify, living_keys
from strata.sinks.layout import path_exists
from strata.streaming.files import FIRST, KEYS_DIR, STATE_DIR
from strata.streaming.state import EPOCH, rocksdb_state

REASON_LATE = "late arrival"
# the epochs' first keys and their marks; "_" keeps them out of reads of ``out``
FIRSTS_DIR = "_firsts"
MARKS_DIR = "_marks"
MARK_SCHEMA = "high long, state_rows long"


def _with_event_time(contract: Contract, event_time: str) -> Contract:
    if any(r.kind == "required" and r.column == event_time for r in contract.all_rules()):
        return contract
    return replace(contract, rules=[Rule.required(event_time), *contract.rules])


def _late_rows(late: DataFrame, contract: Contract, event_time: str, check_time: _dt.datetime | None) -> DataFrame:
    """Flagged late rows: coercion and required failures keep their reason."""
    needed = [r for r in contract.all_rules() if r.kind == "required"]
    named = {r.column for r in needed}
    needed += [Rule.required(k) for k in contract.dedup_keys if k not in named]
    # the order's columns stay, as in the frame of the other rows
    early = replace(contract, dedup_keys=[], required_columns=[], rules=needed)
    flagged = classify(late, early, check_time=check_time)
    ok = F.col(REASON).isNull()
    return flagged.withColumns(
        {
            VALUE: F.when(ok, F.col(f"`{event_time}`").cast("string")).otherwise(F.col(VALUE)),
            REASON: F.when(ok, F.lit(REASON_LATE)).otherwise(F.col(REASON)),
            FIRST: F.lit(False),
        }
    )


def watermark_epoch_writer(
    contract: Contract,
    out: str,
    *,
    event_time: str,
    delay: _dt.timedelta,
    check_time: _dt.datetime | None = None,
    fmt: str = "parquet",
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function of ``stream_silver_within``."""
    if not contract.dedup_keys:
        raise ValueError("a contract without dedup keys needs no state: use stream_silver_rules")
    if contract.dedup_before_required:
        raise ValueError("rows without a key or event time leave before duplicates are ranked")
    if delay < _dt.timedelta(0):
        raise ValueError("delay is negative")
    root = out.rstrip("/")
    keys_dir, marks_dir = f"{root}/{KEYS_DIR}", f"{root}/{MARKS_DIR}"
    names = list(contract.dedup_keys)
    contract = _with_event_time(contract, event_time)
    micros = int(delay / _dt.timedelta(microseconds=1))
    instant = F.col(f"`{event_time}`").cast("timestamp")  # a time without zone is one of the session's zone

    def high_before(spark: SparkSession, epoch_id: int) -> int | None:
        """Latest event time (in microseconds) of all earlier epochs: one row."""
        path = f"{marks_dir}/{EPOCH}={epoch_id - 1}"
        if not path_exists(spark, path):
            return None
        row = spark.read.format(fmt).schema(MARK_SCHEMA).load(path).first()
        return row["high"] if row is not None else None

    def seen_before(on_time: DataFrame, epoch_id: int) -> tuple[DataFrame, int]:
        """Keys of this epoch that the state knows, and the state's rows."""
        spark = on_time.sparkSession
        own = f"{keys_dir}/batch-{epoch_id}"
        if not path_exists(spark, f"{own}/_SUCCESS"):
            keys = living_keys(on_time, contract, earliest=event_time)
            keys = keys.withColumns({event_time: instant, EPOCH: F.lit(epoch_id).cast("bigint")})
            keys.write.format(fmt).mode("overwrite").save(own)
        keys = spark.read.format(fmt).load(own)
        source = spark.readStream.format(fmt).schema(keys.schema).load(f"{keys_dir}/*")
        firsts = source.withWatermark(event_time, f"{micros} microseconds").dropDuplicatesWithinWatermark(names)
        with rocksdb_state(spark):
            query = (
                firsts.writeStream.format(fmt)
                .option("checkpointLocation", f"{root}/{STATE_DIR}")
                .partitionBy(EPOCH)
                .trigger(availableNow=True)
                .start(f"{root}/{FIRSTS_DIR}")
            )
        query.awaitTermination()
        progress = query.lastProgress
        rows = progress["stateOperators"][0]["numRowsTotal"] if progress and progress["stateOperators"] else 0
        keys = keys.select(*[F.col(f"`{k}`") for k in names])
        mine = f"{root}/{FIRSTS_DIR}/{EPOCH}={epoch_id}"
        if path_exists(spark, mine):
            # only this epoch's folder: files of a failed attempt hold the same keys
            keys = keys.join(spark.read.format(fmt).load(mine).select(*names), names, "left_anti")
        return keys, rows

    def write_epoch(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        batch = rename_present(batch, contract.rename)
        if not isinstance(batch.schema[event_time].dataType, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"{event_time} must be a timestamp column of the stream")
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            before = high_before(spark, epoch_id)
            at = F.unix_micros(instant)
            is_late = F.lit(False) if before is None else F.coalesce(at <= F.lit(before - micros), F.lit(False))
            on_time = batch.where(~is_late)
            known, state_rows = seen_before(on_time, epoch_id)
            flagged = classify(on_time, contract, check_time=check_time, seen_keys=known, first_flag=FIRST)
            if before is not None:
                flagged = flagged.unionByName(_late_rows(batch.where(is_late), contract, event_time, check_time))
            flagged.write.format(fmt).mode("overwrite").save(f"{root}/{EPOCH}={epoch_id}")
            # from the key files, as the watermark of the state is
            own = f"{keys_dir}/batch-{epoch_id}"
            high = F.greatest(F.max(F.unix_micros(instant)), F.lit(before).cast("long"))
            mark = spark.read.format(fmt).load(own).agg(high.alias("high")).withColumn("state_rows", F.lit(state_rows).cast("long"))
            mark.write.format(fmt).mode("overwrite").save(f"{marks_dir}/{EPOCH}={epoch_id}")
        finally:
            batch.unpersist()

    return write_epoch


def stream_silver_within(
    bronze: DataFrame,
    contract: Contract,
    out: str,
    checkpoint: str,
    *,
    event_time: str,
    delay: _dt.timedelta,
    check_time: _dt.datetime | None = None,
    wait: bool = True,
) -> StreamingQuery:
    """Classify each epoch under a watermark, with bounded state.

    ``event_time`` names a timestamp column (after renaming). Read the result
    with ``silver_outputs``, and each epoch's watermark with ``marks``.
    """
    write = watermark_epoch_writer(contract, out, event_time=event_time, delay=delay, check_time=check_time)
    q = bronze.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if wait:
        q.awaitTermination()
    return q


def marks(spark: SparkSession, out: str, fmt: str = "parquet") -> DataFrame:
    """(epoch, high, state_rows): latest event time so far, in microseconds,
    and the keys held in state after each epoch."""
    return spark.read.format(fmt).load(f"{out.rstrip('/')}/{MARKS_DIR}")
