"""Streaming Silver under a watermark: late rows, bounded state, replay."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strata.contract import Contract, Rule
from strata.operators.quality import REASON
from strata.streaming.files import bronze_stream, silver_outputs
from strata.streaming.watermark import marks, stream_silver_within, watermark_epoch_writer

ROWS = "k string, ts timestamp, v int"
DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


def at(days: float) -> dt.datetime:
    return START + days * DAY


@pytest.fixture(autouse=True)
def few_state_stores(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def reasons(spark, out):
    kept, quarantined = silver_outputs(spark, out)
    both = kept.select("k", "ts", F.lit("kept").alias("r")).unionByName(quarantined.select("k", "ts", F.col(REASON).alias("r")))
    return sorted(((r["k"] or ""), (r["ts"] - START).total_seconds() / 86400 if r["ts"] else None, r["r"]) for r in both.collect())


CONTRACT = Contract("w", dedup_keys=["k"], dedup_order=["ts", "v"], rules=[Rule.range("v", "0..9")])


def test_late_duplicate_and_failed_rows_keep_their_reason(spark, tmp_dir):
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    epochs = [
        [("a", at(0), 1), ("a", at(0.5), 1), ("b", at(1), 99), ("", at(10), 1)],
        [("a", at(0), 1), ("", at(10), 1), ("c", at(8), 1), ("c", at(8), 1), ("d", None, 1), (None, at(1), 1), ("e", at(7), 1)],
        [],
        [("e", at(7.5), 2), ("f", at(7.5), 2)],
    ]
    for rows in epochs:
        spark.createDataFrame(rows, ROWS).write.mode("append").parquet(src)
        b = bronze_stream(spark, src, spark.createDataFrame([], ROWS).schema, fmt="parquet")
        stream_silver_within(b, CONTRACT, out, ck, event_time="ts", delay=3 * DAY)
    got = reasons(spark, out)
    want = [
        ("a", 0, "kept"), ("a", 0.5, "duplicate"), ("b", 1, "v failed validation"), ("", 10, "kept"),
        ("a", 0, "late arrival"), ("", 10, "duplicate"), ("c", 8, "kept"), ("c", 8, "duplicate"),
        ("d", None, "required"), ("", 1, "required"), ("e", 7, "late arrival"),  # at the line itself
        ("e", 7.5, "kept"), ("f", 7.5, "kept"),
    ]
    fixed = [(k, t, "required" if "null" in r.lower() or "required" in r.lower() else r) for k, t, r in got]
    assert sorted(fixed, key=repr) == sorted([(k, float(t) if t is not None else None, r) for k, t, r in want], key=repr)


def test_state_does_not_grow_and_a_replayed_epoch_is_equal(spark, tmp_dir):
    src, out, ck = f"{tmp_dir}/src", f"{tmp_dir}/out", f"{tmp_dir}/ck"
    schema = spark.createDataFrame([], ROWS).schema
    for day in range(20):
        rows = [(f"{day}-{i}", at(day + i / 50), 1) for i in range(50)]
        rows += [(f"{day - 1}-{i}", at(day - 1 + i / 50), 1) for i in range(50)] if day else []
        spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(src)
        b = bronze_stream(spark, src, schema, fmt="parquet")
        stream_silver_within(b, CONTRACT, out, ck, event_time="ts", delay=2 * DAY)
    held = [r["state_rows"] for r in marks(spark, out).orderBy("epoch").collect()]
    assert len(held) == 20
    assert max(held) <= 200 and max(held[10:]) <= max(held[:10])  # three days of keys and no more
    kept, quarantined = silver_outputs(spark, out)
    assert kept.count() == 1000 and kept.select("k").distinct().count() == 1000
    assert {r[0] for r in quarantined.select(REASON).distinct().collect()} == {"duplicate"}

    before = sorted(map(str, spark.read.parquet(f"{out}/epoch=19").select("k", "ts", REASON).collect()))
    last = spark.createDataFrame(rows, ROWS)
    last = last.withColumns({"ingestion_date": F.current_date(), "source_file": F.lit("f"), "batch_id": F.lit("stream")})
    watermark_epoch_writer(CONTRACT, out, event_time="ts", delay=2 * DAY)(last, 19)
    assert sorted(map(str, spark.read.parquet(f"{out}/epoch=19").select("k", "ts", REASON).collect())) == before


def test_refused_settings(spark, tmp_dir):
    with pytest.raises(ValueError, match="dedup keys"):
        watermark_epoch_writer(Contract("w"), tmp_dir, event_time="ts", delay=DAY)
    with pytest.raises(ValueError, match="negative"):
        watermark_epoch_writer(CONTRACT, tmp_dir, event_time="ts", delay=-DAY)
    with pytest.raises(ValueError, match="timestamp"):
        df = spark.createDataFrame([("a", "x", 1)], "k string, ts string, v int")
        watermark_epoch_writer(CONTRACT, f"{tmp_dir}/o", event_time="ts", delay=DAY)(df, 0)
