import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.functions.columns import with_lineage
from strata.operators.quality import REASON, classify, outcome_counts
from strata.sinks import layout as K
from strata.sources.dialect import Dialect
from strata.streaming import files as ST


def test_bronze_append_verify_manifest(spark, tmp_dir):
    df = spark.range(10).withColumn("v", F.col("id") * 2)
    K.write_bronze(with_lineage(df, "b1", "2024-01-01", "src.csv"), f"{tmp_dir}/bronze")
    K.write_bronze(with_lineage(df, "b2", "2024-01-02", "src.csv"), f"{tmp_dir}/bronze")
    r = K.verify_write(spark, f"{tmp_dir}/bronze", "b2").first()
    assert (r.total_rows, r.batches, r.batch_rows, r.partitions) == (20, 2, 10, 2)
    stored = spark.read.parquet(f"{tmp_dir}/bronze")
    assert dict(stored.dtypes)["ingestion_date"] == "date"
    m = K.append_manifest(stored, f"{tmp_dir}/manifest")
    assert sorted((x.batch_id, x.row_count) for x in m.collect()) == [("b1", 10), ("b2", 10)]
    dropped = K.drop_partitions(spark, f"{tmp_dir}/bronze", "2024-01-02")
    assert dropped == ["ingestion_date=2024-01-01"]
    assert spark.read.parquet(f"{tmp_dir}/bronze").count() == 10


def test_write_split_and_quarantine_by_date(spark, tmp_dir):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 50)], "k string, q int")
    f = classify(df, Contract("t", dedup_keys=["k"], dedup_order=["q"], rules=[Rule.range("q", "0..10")]), check_time=dt.datetime(2024, 3, 1, 8))
    kept, quarantined = K.write_split(f, f"{tmp_dir}/flagged")
    assert kept.count() == 1 and quarantined.count() == 2
    K.append_quarantine(quarantined, f"{tmp_dir}/q")
    assert os.listdir(f"{tmp_dir}/q").count("_dq_check_date=2024-03-01") == 1  # D9: one folder per day
    # an empty quarantine still has a schema
    empty = quarantined.limit(0)
    K.append_quarantine(empty, f"{tmp_dir}/q2")
    assert REASON in spark.read.parquet(f"{tmp_dir}/q2").columns


def test_overwrite_of_a_path_being_read(spark, tmp_dir):
    p = f"{tmp_dir}/silver"
    spark.range(5).write.parquet(p)
    df = spark.read.parquet(p).filter("id < 3")
    K.write_silver(df, p)
    assert spark.read.parquet(p).count() == 3


def test_zorder_compact_and_spans(spark, tmp_dir):
    df = spark.range(0, 20000).select((F.col("id") % 1000).alias("a"), (F.col("id") * 7 % 997).alias("b"), "id")
    K.zorder_write(df, f"{tmp_dir}/z", ["a", "b"], files=8)
    z = spark.read.parquet(f"{tmp_dir}/z")
    assert z.count() == 20000
    spans = K.file_spans(spark, f"{tmp_dir}/z", "a").collect()
    assert len(spans) == 8
    assert sum(r.hi - r.lo for r in spans) / len(spans) < 999  # files cover less than the whole range
    with pytest.raises(ValueError):
        K.zorder_write(df, f"{tmp_dir}/z2", ["a", "b", "id", "a", "b"])
    df.repartition(20).write.parquet(f"{tmp_dir}/many")
    assert K.compact(spark, f"{tmp_dir}/many", target_mb=128) == 1
    assert spark.read.parquet(f"{tmp_dir}/many").count() == 20000


def test_catalog_register_comment_rebuild(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/g")
    K.register(spark, "strata_gold_g", f"{tmp_dir}/g")
    K.comment_columns(spark, "strata_gold_g", {"id": "row id, it's unique"})
    from strata.operators.audits import check_comments

    assert {r.status for r in check_comments(spark, "strata_gold_g").collect()} == {"pass"}
    t = K.rebuild_table(spark, "strata_rebuilt", spark.range(4))
    t = K.rebuild_table(spark, "strata_rebuilt", spark.range(2))
    assert t.count() == 2
    for n in ("strata_gold_g", "strata_rebuilt"):
        spark.sql(f"DROP TABLE IF EXISTS {n}")


def test_partition_guard_and_csv_sink(spark, tmp_dir):
    df = spark.range(50)
    assert K.check_partition_column(df, "id", 100) <= 60
    with pytest.raises(ValueError):
        K.check_partition_column(df, "id", 10)
    K.write_csv(spark.createDataFrame([("São", 1)], "s string, n int"), f"{tmp_dir}/c", Dialect(sep=";", encoding="latin-1"))
    raw = b"".join(open(os.path.join(f"{tmp_dir}/c", f), "rb").read() for f in sorted(os.listdir(f"{tmp_dir}/c")) if f.endswith(".csv"))
    assert "São".encode("iso-8859-1") in raw and b";" in raw


LINES = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.IntegerType()), T.StructField("q", T.IntegerType())])


def test_streaming_bronze_then_silver_equals_batch(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    files = [
        "k,v,q\na,1,5\nb,1,99\n",
        "k,v,q\na,2,5\nc,1,5\nb,2,5\n",
        "k,v,q\na,3,5\nd,1,5\n",
    ]
    for i, body in enumerate(files):
        with open(f"{src}/f{i}.csv", "w") as fh:
            fh.write(body)
        os.utime(f"{src}/f{i}.csv", (1_700_000_000 + i * 60, 1_700_000_000 + i * 60))  # arrival order
    ST.stream_bronze(spark, src, LINES, f"{tmp_dir}/bronze", f"{tmp_dir}/ck1")
    bronze = spark.read.parquet(f"{tmp_dir}/bronze")
    assert bronze.count() == 7 and bronze.filter(F.col("source_file").isNull()).count() == 0
    c = Contract("t", dedup_keys=["k"], dedup_order=["v"], rules=[Rule.range("q", "0..10")])
    stream = ST.bronze_stream(spark, src, LINES, max_files_per_trigger=1)
    ST.stream_silver(stream, c, f"{tmp_dir}/silver", f"{tmp_dir}/ck2")
    kept, q = ST.silver_outputs(spark, f"{tmp_dir}/silver")
    # files arrive in order, so the earliest epoch holds each key's first row
    batch = classify(bronze.drop("ingestion_date", "source_file", "batch_id"), c)
    assert sorted(tuple(r) for r in outcome_counts(batch).collect()) == sorted(
        tuple(r) for r in outcome_counts(q.unionByName(kept.withColumn(REASON, F.lit(None).cast("string")), allowMissingColumns=True)).collect()
    )
    assert kept.groupBy("k").count().filter("count > 1").count() == 0


def test_replayed_epoch_is_not_duplicated(spark, tmp_dir):
    c = Contract("t", dedup_keys=["k"], dedup_order=["v"])
    w = ST.silver_epoch_writer(c, f"{tmp_dir}/out")
    e0 = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, q int")
    e1 = spark.createDataFrame([("a", 2, 1), ("c", 1, 1)], "k string, v int, q int")
    w(e0, 0)
    w(e1, 1)
    w(e1, 1)  # replay
    kept, q = ST.silver_outputs(spark, f"{tmp_dir}/out")
    assert sorted(r.k for r in kept.collect()) == ["a", "b", "c"]
    assert [(r.k, r[REASON]) for r in q.collect()] == [("a", "duplicate")]


def test_seen_keys_count_as_duplicates(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1), ("c", 1)], "k string, v int")
    seen = spark.createDataFrame([("a",), (None,)], "k string")
    c = Contract("t", dedup_keys=["k"], dedup_order=["v"])
    got = sorted(((r.k, r.v, r[REASON]) for r in classify(df, c, seen_keys=seen).collect()), key=repr)
    # a null dedup key leaves before ranking
    want = [("a", 1, "duplicate"), ("a", 2, "duplicate"), ("b", 1, None), (None, 1, "required_column_null:k"), ("c", 1, None)]
    assert got == sorted(want, key=repr)


def test_zorder_on_dates_and_timestamps(spark, tmp_dir):
    o = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    K.zorder_write(o.withColumn("d", F.to_date("o_orderdate")), f"{tmp_dir}/zt", ["o_orderdate", "d", "o_totalprice"], files=4)
    assert spark.read.parquet(f"{tmp_dir}/zt").count() == o.count()
    with pytest.raises(ValueError):
        K.zorder_write(o.withColumn("b", F.array("o_orderkey")), f"{tmp_dir}/zs", ["b"])


def test_hilbert_key_visits_neighbours(spark):
    for k in (2, 3):
        side, bits = 4, 2
        cells = spark.range(side**k).select(*[(F.floor(F.col("id") / side**i) % side).cast("long").alias(f"c{i}") for i in range(k)])
        rows = sorted((r["h"], tuple(r[f"c{i}"] for i in range(k))) for r in cells.withColumn("h", K._hilbert([F.col(f"c{i}") for i in range(k)], bits)).collect())
        assert [h for h, _ in rows] == list(range(side**k))
        assert all(sum(abs(x - y) for x, y in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(rows, rows[1:]))


def test_text_columns_keep_their_order(spark, tmp_dir):
    words = ["", "a", "aa", "b", "é", "z" * 100, None] + [f"w{k:03d}" for k in range(300)] + ["hot"] * 500
    df = spark.createDataFrame([(w, k) for k, w in enumerate(words)], "t string, n int")
    got = K.zorder_key(df, ["t"], bits=4).collect()
    order = sorted((r for r in got if r.t is not None), key=lambda r: r.t.encode())
    assert [r["_zkey"] for r in order] == sorted(r["_zkey"] for r in order) and len({r["_zkey"] for r in order}) > 8
    for curve in ("z", "hilbert"):
        K.zorder_write(df, f"{tmp_dir}/{curve}", ["t", "n"], files=4, curve=curve)
        assert spark.read.parquet(f"{tmp_dir}/{curve}").exceptAll(df).count() == 0


def test_bucketed_bronze_feeds_dedup_without_shuffle(spark, tmp_dir):
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    b = with_lineage(li, "b1", "2024-01-01", "li.csv")
    t = K.write_bronze_bucketed(b, "strata_bronze_li_b", f"{tmp_dir}/bb", ["l_orderkey", "l_linenumber"], 8)
    c = Contract("li", dedup_keys=["l_orderkey", "l_linenumber"], dedup_order=["l_shipdate", "l_partkey", "l_suppkey"])
    f = classify(t, c, clustered=True)
    plan = f._jdf.queryExecution().executedPlan().toString()
    window_part = plan.split("Window [row_number()")[1]
    assert "Exchange" not in window_part.split("FileScan")[0]  # no shuffle between scan and window
    assert sorted(tuple(r) for r in outcome_counts(f).collect()) == sorted(tuple(r) for r in outcome_counts(classify(li, c)).collect())
    spark.sql("DROP TABLE IF EXISTS strata_bronze_li_b")


def test_reruns_are_idempotent(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (20,)], "v int")
    c = Contract("t", rules=[Rule.range("v", "5..9")])
    t1, t2 = dt.datetime(2024, 3, 1, 8), dt.datetime(2024, 3, 1, 9)
    for t in (t1, t1, t2):  # run 1 twice (a retry), then run 2
        K.append_quarantine(classify(df, c, check_time=t), f"{tmp_dir}/q")
    q = spark.read.parquet(f"{tmp_dir}/q")
    assert q.filter(F.col(REASON).isNotNull()).count() == 4  # 2 rows x 2 runs, not 3 runs
    b = with_lineage(spark.range(5), "b1", "2024-01-01", "f.csv")
    K.write_bronze(b, f"{tmp_dir}/b", by_batch=True)
    K.write_bronze(b, f"{tmp_dir}/b", by_batch=True)  # the same batch again
    K.write_bronze(with_lineage(spark.range(3), "b2", "2024-01-01", "g.csv"), f"{tmp_dir}/b", by_batch=True)
    assert spark.read.parquet(f"{tmp_dir}/b").count() == 8


def test_every_epoch_replayed_once_equals_batch(spark, tmp_dir):
    rows = [("a", 1, 5), ("b", 1, 99), ("a", 2, 5), ("c", 1, 5), ("b", 2, 5), ("a", 3, 5), ("d", 1, 5), ("c", 0, 5)]
    epochs = [rows[0:2], rows[2:5], rows[5:8]]
    c = Contract("t", dedup_keys=["k"], dedup_order=["v"], rules=[Rule.range("q", "0..10")])
    w = ST.silver_epoch_writer(c, f"{tmp_dir}/out")
    for i, part in enumerate(epochs):
        batch = spark.createDataFrame(part, "k string, v int, q int")
        w(batch, i)
        w(batch, i)  # each epoch delivered twice
    kept, q = ST.silver_outputs(spark, f"{tmp_dir}/out")
    assert kept.count() + q.count() == len(rows)
    got = sorted((r.k, r.v, r[REASON]) for r in q.select("k", "v", REASON).collect())
    # first row per key is the one of the earliest epoch (c,0 arrives after c,1)
    assert got == [("a", 2, "duplicate"), ("a", 3, "duplicate"), ("b", 1, "q failed validation"), ("b", 2, "duplicate"), ("c", 0, "duplicate")]


def test_rules_only_silver_runs_as_a_plain_stream(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    os.makedirs(src)
    bodies = ["k,v,q\na,1,5\nb,1,99\n", "k,v,q\nzz,2,5\nc,1,\n"]
    for i, body in enumerate(bodies):
        with open(f"{src}/f{i}.csv", "w") as fh:
            fh.write(body)
    ref = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    c = Contract("t", required_columns=["k"], rules=[Rule.range("q", "0..10"), Rule.foreign_key("k", ref)])
    ST.stream_silver_rules(ST.bronze_stream(spark, src, LINES), c, f"{tmp_dir}/out", f"{tmp_dir}/ck")
    got = spark.read.parquet(f"{tmp_dir}/out")
    assert sorted((r.k, r._dq_outcome, r[REASON]) for r in got.collect()) == [
        ("a", "kept", None), ("b", "quarantined", "q failed validation"), ("c", "kept", None), ("zz", "quarantined", "k not in reference")
    ]
    with pytest.raises(ValueError):
        ST.stream_silver_rules(ST.bronze_stream(spark, src, LINES), Contract("t", dedup_keys=["k"]), f"{tmp_dir}/o2", f"{tmp_dir}/c2")


def _fail_rename(monkeypatch, nth):
    """Make the nth rename of the next swap say that it failed."""
    real, seen = K.rename_path, []

    def rename(spark, src, dst):
        seen.append((src, dst))
        return False if len(seen) == nth else real(spark, src, dst)

    monkeypatch.setattr(K, "rename_path", rename)


@pytest.mark.parametrize("nth", [1, 2])
def test_failed_swap_keeps_the_table(spark, tmp_dir, monkeypatch, nth):
    path = f"{tmp_dir}/t"
    K.write_overwrite(spark.range(5), path)
    _fail_rename(monkeypatch, nth)
    with pytest.raises(OSError):
        K.write_overwrite(spark.range(9), path)
    monkeypatch.undo()
    assert spark.read.parquet(path).count() == 5
    K.write_overwrite(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7


def test_swap_that_died_half_way_is_undone(spark, tmp_dir):
    path = f"{tmp_dir}/t"
    K.write_overwrite(spark.range(5), path)
    K.rename_path(spark, path, f"{path}.__old_deadbeef")
    assert not K.path_exists(spark, path)
    assert K.recover(spark, path) and spark.read.parquet(path).count() == 5


def test_quarantine_runs_of_two_contracts_at_one_time(spark, tmp_dir):
    t = dt.datetime(2024, 3, 1, 8)
    for slug, limit in (("a", "5..9"), ("b", "5..30")):
        c = Contract(slug, rules=[Rule.range("v", limit)])
        df = spark.createDataFrame([(1,), (20,)], "v int")
        for _ in range(2):  # each repeated: replaced, not added
            K.append_quarantine(classify(df, c, check_time=t).filter(F.col(REASON).isNotNull()), f"{tmp_dir}/q", run=f"{slug}-run")
    q = spark.read.parquet(f"{tmp_dir}/q")
    assert {r["_dq_run"]: r["count"] for r in q.groupBy("_dq_run").count().collect()} == {"a-run": 2, "b-run": 1}


def test_compaction_keeps_partitions_and_splits_large_ones(spark, tmp_dir):
    df = spark.range(60_000).select(F.when(F.col("id") % 100 == 0, "small").otherwise("large").alias("day"), F.md5(F.col("id").cast("string")).alias("x"))
    df.repartition(20).write.partitionBy("day").parquet(f"{tmp_dir}/c")
    assert K.compact(spark, f"{tmp_dir}/c", target_mb=1) < 40
    assert K.partition_columns(spark, f"{tmp_dir}/c") == ["day"]
    files = spark.read.parquet(f"{tmp_dir}/c").groupBy("day", F.col("_metadata.file_path").alias("f")).count()
    per = {r["day"]: r["n"] for r in files.groupBy("day").agg(F.count("f").alias("n")).collect()}
    assert per["small"] == 1 and 1 < per["large"] <= 8
    assert spark.read.parquet(f"{tmp_dir}/c").count() == 60_000


def test_partition_guard_is_exact_near_its_limit(spark):
    df = spark.range(1000).select(F.col("id"))
    assert K.check_partition_column(df, "id", 1000) == 1000
    with pytest.raises(ValueError):
        K.check_partition_column(df, "id", 999)


def test_bucketed_bronze_has_one_file_per_bucket(spark, tmp_dir):
    li = with_lineage(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").repartition(6), "b", "2024-01-01", "x")
    K.write_bronze_bucketed(li, "strata_bucket_files", f"{tmp_dir}/bk", ["l_orderkey"], 4)
    assert len(spark.read.parquet(f"{tmp_dir}/bk").inputFiles()) == 4
    spark.sql("DROP TABLE IF EXISTS strata_bucket_files")


def test_stream_refuses_title_lines(spark, tmp_dir):
    from strata.sources.dialect import Dialect

    with pytest.raises(ValueError, match="title lines"):
        ST.bronze_stream(spark, tmp_dir, spark.range(1).schema, Dialect(preamble=1))


def test_keyed_state_stays_flat_over_epochs(spark, tmp_dir):
    c = Contract("t", dedup_keys=["k"], dedup_order=["v"], required_columns=["q"])
    w = ST.silver_epoch_writer(c, f"{tmp_dir}/out", seen="state")
    key_files, rows = [], []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    for e in range(7):
        part = [(f"k{(e * 7 + j) % 40}", e * 100 + j, None if j == 5 else 1) for j in range(20)]
        rows += [(e, *r) for r in part]
        w(spark.createDataFrame(part, "k string, v int, q int"), e)
        if e == 3:  # replayed
            w(spark.createDataFrame(part, "k string, v int, q int"), e)
        key_files.append(spark.read.parquet(f"{tmp_dir}/out/_keys/batch-{e}").count())
    spark.conf.set("spark.sql.shuffle.partitions", before)
    # an epoch's keys are its own, however many came before
    assert set(key_files) == {19}
    first = {}
    for e, k, v, q in rows:
        if q is not None:
            first.setdefault(k, v)
    kept, _ = ST.silver_outputs(spark, f"{tmp_dir}/out")
    assert sorted((r.k, r.v) for r in kept.collect()) == sorted(first.items())
    state = spark.read.format("statestore").option("stateVarName", "first_epoch").load(f"{tmp_dir}/out/_state")
    assert state.count() == len(first)  # a row per key, not per epoch
