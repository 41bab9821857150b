import random

import pytest
from pyspark.sql import functions as F

from strata.operators.dedup import dedup, duplicate_groups, flag_first, window_flag_first
from strata.operators.joins import check_unique, checked_denormalise, denormalise, fk_orphans, fk_valid, lookup_hit, star


def skewed(spark, n=3000):
    rnd = random.Random(7)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{rnd.randint(0, 400)}"
        rows.append((k, rnd.randint(0, 50), rnd.choice([None, 1.5, 2.5]), i % 7))
    # exact full duplicates
    rows += [("hot", 0, None, 0)] * 5 + [("k1", 0, None, 0)] * 3
    return spark.createDataFrame(rows, "k string, t int, x double, v int")


@pytest.mark.parametrize("stored", [False, True])
def test_flag_first_equals_plain_window(spark, tmp_dir, stored):
    df = skewed(spark)
    if stored:  # rows of Parquet files have a row id, others are counted by content
        df.repartition(5).write.parquet(f"{tmp_dir}/d")
        df = spark.read.parquet(f"{tmp_dir}/d")
    a = window_flag_first(df, ["k"], ["t", ("x", "desc")])
    b = flag_first(df, ["k"], ["t", ("x", "desc")])
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    firsts = b.filter("_is_first").groupBy("k").count()
    assert firsts.filter("count != 1").count() == 0
    assert firsts.count() == df.select("k").distinct().count()


def test_a_third_of_all_rows_identical_is_split(spark, tmp_dir):
    one = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"),
        F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.md5(F.col("id").cast("string"))).alias("v"),
    )
    one.repartition(32).write.parquet(f"{tmp_dir}/hot")
    conf = {
        "spark.sql.shuffle.partitions": "40",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        f = flag_first(spark.read.parquet(f"{tmp_dir}/hot"), ["k"], ["v"])
        by_task = f.withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count("v").alias("n"), F.count_if("_is_first").alias("m"))
        tasks = sorted(r["n"] for r in by_task.collect())
        # unsplit, the hot key's 20,000 identical rows would be one task; the
        # split goes by bytes, of which identical rows have few
        assert max(tasks) < 8 * tasks[len(tasks) // 2], tasks
        assert f.where("_is_first").count() == 40_001
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unknown_order_column_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    with pytest.raises(ValueError, match="order column"):
        flag_first(df, ["k"], ["w"])


def test_planning_runs_no_job(spark):
    tracker = spark.sparkContext.statusTracker()
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    spark.sparkContext.setJobGroup("plan-only", "no job may run")
    try:
        flag_first(li, ["l_orderkey"], ["l_shipdate"])
        lookup_hit(li, "l_orderkey", orders, "o_orderkey")
        denormalise(li, orders, "l_orderkey", ["o_orderdate"], ref_on="o_orderkey")
        assert list(tracker.getJobIdsForGroup("plan-only")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_alive_rows_do_not_rank(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("b", 1, True)], "k string, v int, ok boolean")
    for clustered in (False, True):
        out = {(r.k, r.v): r._is_first for r in flag_first(df, ["k"], ["v"], alive=F.col("ok"), clustered=clustered).collect()}
        assert out == {("a", 1): None, ("a", 2): True, ("b", 1): True}


def test_dedup_split_and_null_keys(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, v int")
    kept, dups = dedup(df, ["k"], ["v"])
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(None, 1), ("a", 1)], key=repr)
    assert dups.first()._dq_failure_reason == "duplicate"
    assert duplicate_groups(df, ["k"]).count() == 1


def test_lookup_broadcast_and_shuffled_agree(spark):
    big = skewed(spark)
    ref = spark.createDataFrame([("hot",), ("k3",), ("k5",), ("k5",), (None,)], "k string")
    a = lookup_hit(big, "k", ref, "k")
    b = lookup_hit(big, "k", ref.hint("merge"), "k")
    assert a.count() == big.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert fk_orphans(big, "k", ref).count() + fk_valid(big, "k", ref).count() == big.count()


def test_fanout_guard_j4(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    ref = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, name string")
    assert check_unique(ref, ["id"]).count() == 1
    assert denormalise(df, ref, "id").count() == 4  # the fan-out the guard prevents
    with pytest.raises(ValueError):
        checked_denormalise(df, ref, "id")
    ok = checked_denormalise(df, ref.dropDuplicates(["id"]), "id")
    assert ok.count() == 3


def test_star_chain(spark):
    fact = spark.createDataFrame([(1, 10), (2, 20), (3, 99)], "id int, nk int")
    nation = spark.createDataFrame([(10, "BR", 1), (20, "AR", 1)], "n_nationkey int, n_name string, n_regionkey int")
    region = spark.createDataFrame([(1, "AMERICA")], "r_regionkey int, r_name string")
    out = star(fact, [(nation, "nk", ["n_name", "n_regionkey"], "n_nationkey"), (region, "n_regionkey", ["r_name"], "r_regionkey")])
    got = sorted((r.id, r.n_name, r.r_name) for r in out.collect())
    assert got == [(1, "BR", "AMERICA"), (2, "AR", "AMERICA"), (3, None, None)]


def test_denormalise_and_file_lookup(spark):
    from strata.operators import joins

    big = skewed(spark)
    ref = spark.createDataFrame([("hot", 1), ("k3", 2), ("k5", 3), (None, 4)], "rk string, val int")
    a = denormalise(big, ref, "k", ["val"], ref_on="rk")
    b = denormalise(big, ref.hint("merge"), "k", ["val"], ref_on="rk")
    assert a.count() == big.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
    small = ref.withColumnRenamed("rk", "k")
    for how in ("left", "inner", "left_semi", "left_anti"):
        x = joins.file_lookup(big, small, "k", how, files=3)
        y = joins.file_lookup(big, small, "k", how, files=joins.MAX_BROADCAST_FILES + 1)
        assert x.exceptAll(y).count() == 0 and y.exceptAll(x).count() == 0, how


# --- property: keep-first equals the plain window -----------------

from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

_rows = st.lists(
    st.tuples(st.sampled_from(["h", "h", "h", "x", "y", None]), st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 2)),
    min_size=0,
    max_size=40,
)


@settings(max_examples=10, deadline=None)
@given(_rows, st.booleans(), st.booleans())
def test_property_keep_first_equals_window(spark, rows, clustered, descending):
    df = spark.createDataFrame(rows, "k string, t int, p int")
    order = ["t", ("p", "desc")] if descending else ["t", "p"]
    plain = window_flag_first(df, ["k"], order)
    made = flag_first(df, ["k"], order, clustered=clustered)
    a = sorted(map(tuple, plain.collect()), key=repr)
    b = sorted(map(tuple, made.collect()), key=repr)
    assert a == b


def test_classifier_in_place_agrees(spark):
    from strata.contract import Contract, Rule
    from strata.operators.quality import classify, outcome_counts

    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    sup = spark.read.parquet("/root/testdata/sf0.001/supplier.parquet").filter("s_acctbal >= 0")
    c = Contract("li", dedup_keys=["l_returnflag"], dedup_order=["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"],
                 rules=[Rule.range("l_quantity", "5..45"), Rule.foreign_key("l_suppkey", sup, "s_suppkey")])
    base = sorted(tuple(r) for r in outcome_counts(classify(li, c)).collect())
    assert sorted(tuple(r) for r in outcome_counts(classify(li, c, clustered=True)).collect()) == base
    assert dict(base)["duplicate"] == li.count() - li.select("l_returnflag").distinct().count()


def test_copies_of_a_hot_row_come_back_in_blocks(spark, tmp_dir):
    rows = spark.range(30_000).select((F.col("id") % 3).alias("third"), "id").select(
        F.when(F.col("third") == 0, "same").otherwise(F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"),
        F.when(F.col("third") == 0, 1).otherwise(F.col("id")).alias("v"),
    )
    rows.write.csv(f"{tmp_dir}/hot", header=True)
    df = spark.read.csv(f"{tmp_dir}/hot", header=True, schema="k string, v long")
    flagged = flag_first(df, ["k"], ["v"]).cache()
    assert flagged.count() == 30_000 and flagged.where("_is_first").count() == 20_001
    hot = flagged.where("k = 'same' and not _is_first").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in hot) == 9_999 and max(r["count"] for r in hot) <= 2 * 4096
    dead = flag_first(df, ["k"], ["v"], alive=F.col("k") != "same")
    assert dead.where("_is_first is null").count() == 10_000
