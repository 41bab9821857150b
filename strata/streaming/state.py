"""Keyed state of the streaming Silver stage (inventory T3).

``SeenKeys`` remembers, per dedup key, the epoch in which the key was
first ranked. The state lives in RocksDB stores, partitioned by key and
kept in the query's checkpoint, so an epoch touches the keys it brings and
nothing else; its time does not grow with the stream's history. Rows do
not pass through it: Spark first reduces an epoch to its distinct keys
(combined map-side, so a hot key is one row), and only these reach the
Python worker.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

EPOCH = "epoch"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class SeenKeys(StatefulProcessor):
    """Passes on the (key, epoch) rows whose key an earlier epoch had.

    An epoch that is replayed finds its own number and passes nothing on
    that it did not pass on the first time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._first = handle.getValueState("first_epoch", T.StructType([T.StructField(EPOCH, T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        known = self._first.get()
        first = known[0] if known is not None else None
        for row in rows:
            if first is None or row[EPOCH] < first:
                first = row[EPOCH]
                self._first.update((first,))
            elif first < row[EPOCH]:
                yield row

    def close(self) -> None:
        pass


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def keys_seen_before(keys: DataFrame, key_names: list[str]) -> DataFrame:
    """A stream of (key columns, epoch) reduced to the rows whose key came in
    an earlier epoch. Key columns must not be null."""
    fields = [*[keys.schema[k] for k in key_names], T.StructField(EPOCH, T.LongType())]
    return keys.groupBy(*[F.col(f"`{k}`") for k in key_names]).transformWithState(
        statefulProcessor=SeenKeys(), outputStructType=T.StructType(fields), outputMode="Append", timeMode="None"
    )
