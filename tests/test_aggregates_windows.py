import pytest
import datetime as dt

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import aggregates as A
from strata.operators import windows as W


def events(spark):
    d = dt.datetime
    rows = [
        (1, d(2024, 1, 1, 10)), (1, d(2024, 1, 1, 11)), (1, d(2024, 1, 3)), (2, d(2024, 1, 2)), (2, d(2024, 1, 2, 5)),
        (2, d(2024, 1, 4)), (3, d(2024, 1, 4)), (None, d(2024, 1, 4)),
    ]
    return spark.createDataFrame(rows, "user_id long, ts timestamp_ntz")


def test_cohort_counts_distinct_entities(spark):
    out = {(r.cohort, r.day_n): r.users for r in A.cohort(events(spark), "user_id", "ts").collect()}
    assert out == {(dt.date(2024, 1, 1), 0): 1, (dt.date(2024, 1, 1), 2): 1, (dt.date(2024, 1, 2), 0): 1, (dt.date(2024, 1, 2), 2): 1, (dt.date(2024, 1, 4), 0): 1}


def test_aggregate_measures_and_money(spark):
    df = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", None)], "k string, x double")
    out = {r.k: r for r in A.aggregate(df, ["k"], [A.Measure("s", "money_sum", "x"), A.Measure("n", "count_all"), A.Measure("c", "count", "x"), A.Measure("d", "count_distinct", "x")]).collect()}
    assert out["a"].s == 0.3 and out["a"].n == 2 and out["b"].c == 0 and out["b"].s is None


def test_time_series_distribution_counts(spark):
    ev = events(spark)
    ts = {r.period: r.n for r in A.time_series(ev, "ts", "day", [A.Measure("n", "count_all")]).collect()}
    assert ts[dt.date(2024, 1, 4)] == 3
    df = spark.createDataFrame([(0.0,), (49999.0,), (50000.0,), (None,)], "p double")
    assert {r.bucket: r.n for r in A.distribution(df, "p", 50000).collect()} == {0: 2, 1: 1, None: 1}
    r = A.counts(ev, ["user_id"]).first()
    assert r.rows == 8 and r.distinct_user_id == 3


def test_null_distinct_value_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "s string, n int")
    r = A.null_counts(df).first()
    assert (r.rows, r.null_s, r.null_n) == (3, 1, 1)
    assert A.distinct_counts(df, exact=True).first().distinct_s == 1
    vc = {(r.col, r.v): r.n for r in A.value_counts(df, max_distinct=10).collect()}
    assert vc[("s", "a")] == 2 and vc[("n", None)] == 1


def test_summary_and_cast_failures(spark):
    df = spark.createDataFrame([(1.0, "1"), (3.0, "x"), (None, None)], "x double, s string")
    s = {r.column: r for r in A.summary(df).collect()}
    assert s["x"]["count"] == 2 and s["x"]["nulls"] == 1 and s["x"]["mean"] == 2.0
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("s", T.IntegerType())])
    assert {r.column: r.failures for r in A.cast_failures(df, schema).collect()} == {"s": 1}


def test_pct_of_total_is_subquery(spark):
    df = spark.createDataFrame([("a", 1), ("b", 3)], "k string, n long")
    assert {r.k: r.pct for r in A.pct_of_total(df, "n").collect()} == {"a": 25.0, "b": 75.0}


def test_rank_all_equals_a_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 97).alias("g"), F.col("id"))
    one = df.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("g"), "id")))
    dist = W.rank_all(df, [("g", "desc"), "id"], partitions=7)
    a = sorted((r.id, r["rank"]) for r in one.collect())
    b = sorted((r.id, r["rank"]) for r in dist.collect())
    assert a == b and sorted(r for _, r in a) == list(range(1, 5001))


def test_top_n_and_per_group(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1)], "k string, v int")
    assert [r.v for r in W.top_n(df, [("v", "desc"), "k"], 2).collect()] == [3, 2]
    g = W.top_n_per_group(df, ["k"], ["v"], 2, rank_col="r")
    assert sorted((r.k, r.v, r.r) for r in g.collect()) == [("a", 1, 1), ("a", 2, 2), ("b", 1, 1)]


def test_gaps_by_series(spark):
    d = dt.date
    df = spark.createDataFrame([("s1", d(2024, 1, 1)), ("s1", d(2024, 1, 2)), ("s1", d(2024, 1, 5)), ("s2", d(2024, 1, 1)), ("s2", d(2024, 1, 3))], "s string, d date")
    got = sorted((r.s, r.gap_start, r.gap_end) for r in W.gaps(df, "d", ["s"]).collect())
    assert got == [("s1", d(2024, 1, 2), d(2024, 1, 5)), ("s2", d(2024, 1, 1), d(2024, 1, 3))]


def test_union_schema_diff_reconcile(spark):
    a = spark.createDataFrame([(1, "x")], "id long, a string")
    b = spark.createDataFrame([(2, 1.0)], "id long, b double")
    u = W.union_all(a, b)
    assert u.columns == ["id", "a", "b"] and u.count() == 2
    diff = {r.column: r.status for r in W.schema_diff(a, b).collect()}
    assert diff == {"a": "only_a", "b": "only_b"}
    c = spark.createDataFrame([(2, 7)], "id long, a int")
    assert {r.column: r.status for r in W.schema_diff(a, c).collect()} == {"a": "type_changed"}
    r = W.reconcile(spark.range(5), spark.range(3), spark.range(2)).first()
    assert r.ok and r.source_rows == 5
    assert W.missing_rows(spark.range(5), spark.range(3), spark.range(3, 4), ["id"]).count() == 1
    assert W.top_reasons(spark.createDataFrame([("x",), ("y",), ("x",)], "_dq_failure_reason string"), 1).first().reason == "x"


def test_size_for_input(spark):
    from strata.session import size_for_input

    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        assert size_for_input(spark, 100 * 1024**4) == 409600  # 100 TB at 256 MB per partition
        assert size_for_input(spark, 1024) == 200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))


def test_cohort_offsets_by_quarter(spark):
    df = spark.createDataFrame([("a", "2020-01-15"), ("a", "2020-05-01"), ("a", "2021-02-01")], "u string, d string").withColumn("d", F.to_date("d"))
    assert sorted(r.day_n for r in A.cohort(df, "u", "d", "quarter").collect()) == [0, 1, 4]
    with pytest.raises(ValueError):
        A.cohort(df, "u", "d", "hour")


def test_skipped_columns_are_listed(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("many"), (F.col("id") % 3).cast("string").alias("few"))
    assert {r.col for r in A.value_counts(df).collect()} == {"few"}
    assert [r.col for r in A.skipped_columns(df).collect()] == ["many"]
