import pytest
from pyspark.sql import functions as F

from strata.contract import Contract
from strata.operators import audits as Q
from strata.operators import report as R
from strata.operators.aggregates import Aggregate, Measure
from strata.operators.filters import contains_any, from_file, mojibake, of_batch


def test_audit_bronze_and_enforce(spark, tmp_dir):
    ok = spark.createDataFrame([(1, "2024-01-01", "f.csv", "b")], "x int, ingestion_date string, source_file string, batch_id string")
    ok.write.partitionBy("ingestion_date").parquet(f"{tmp_dir}/b")
    checks = Q.audit_bronze(ok, input_rows=1, path=f"{tmp_dir}/b")
    assert {r.status for r in checks.collect()} == {"pass"}
    Q.enforce(checks)
    bad = spark.createDataFrame([(1, None, None, "b")], "x int, ingestion_date string, source_file string, batch_id string")
    failed = Q.audit_bronze(bad, input_rows=2)
    assert {r.check for r in failed.filter("status = 'fail'").collect()} == {"lineage_ingestion_date", "lineage_source_file", "rows_in_equals_rows_out"}
    with pytest.raises(RuntimeError):
        Q.enforce(failed)
    # stored as something else, and not partitioned
    ok.write.json(f"{tmp_dir}/j")
    stored = Q.audit_bronze(ok, path=f"{tmp_dir}/j")
    assert {(r.check, r.observed) for r in stored.filter("status = 'fail'").collect()} == {("partitioned_by", ""), ("storage_format", "json")}
    many = Q.check_rows(spark, [("s", f"c{k}", False, k, 0, Q.ABORT) for k in range(120)])
    with pytest.raises(RuntimeError, match="c119"):
        Q.enforce(many)


def test_null_rates_q8(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (None, "b")], "id int, s string")
    r = {x.column: x for x in Q.null_rates(df, key_columns=["id"], default_limit=0.5).collect()}
    assert not r["id"].ok and r["s"].ok and abs(r["s"].null_rate - 1 / 3) < 1e-9


def test_audit_silver_q18(spark):
    kept = spark.createDataFrame([("a", 1), ("a", 1)], "k string, v int")
    c = Contract("t", dedup_keys=["k"], required_columns=["k"])
    st = {r.check: r.status for r in Q.audit_silver(kept, c).collect()}
    assert st == {"required_not_null:k": "pass", "dedup_applied": "fail"}


def test_grain_dims_smoke_samples(spark):
    src = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "d string, v int")
    agg = src.groupBy("d").agg(F.sum("v").alias("s"))
    g = {r.check: r.status for r in Q.check_grain(agg, src, ["d"]).collect()}
    assert g == {"aggregate:grain": "pass", "aggregate:null_dimensions": "fail"}
    assert Q.check_dims(agg, ["d"]).first().status == "fail"
    sm = {r.t: (r.n, r.ok) for r in Q.smoke({"src": src, "agg": agg}, {"src": (1, 10), "agg": (5, 6)}).collect()}
    assert sm == {"src": (3, True), "agg": (2, False)}
    qt = spark.createDataFrame([("r1", i) for i in range(10)] + [("r2", 1)], "_dq_failure_reason string, id int")
    s = Q.bad_samples(qt, 3, order=["id"])
    assert s.count() == 4


def test_report_tables(spark, tmp_dir):
    q = spark.createDataFrame([("dup",), ("dup",), ("range",), ("dup",)], "_dq_failure_reason string")
    fr = {r.reason: (r.rows, r.pct) for r in R.failure_reasons(q).collect()}
    assert fr == {"dup": (3, 75.0), "range": (1, 25.0)}
    rs = R.run_summary({"bronze": ("bronze", spark.range(5)), "kept": ("silver", spark.range(3))})
    assert sorted((r.stage, r.rows) for r in rs.collect()) == [("bronze", 5), ("silver", 3)]
    cat = R.aggregate_catalog(spark, [Aggregate("by_state_year", ["state_id", "year"], [Measure("total_population", "sum", "population")], "totals")])
    assert cat.first().grain == "state_id, year"
    man = spark.createDataFrame([("p/a.csv", 5, "b1", "2024-01-01"), ("p/b.csv", 2, "b1", "2024-01-01")], "source_path string, row_count long, batch_id string, ingestion_date string")
    bm = R.batch_metadata(man).first()
    assert (bm.files, bm.rows) == (2, 7)
    prof = {r.column: r for r in R.profile(spark.createDataFrame([(1, "x"), (None, "y")], "a int, b string")).collect()}
    assert prof["a"].nulls == 1 and prof["b"].max == "y" and prof["a"].rows == 2
    spark.range(100).write.parquet(f"{tmp_dir}/t1")
    st = R.storage(spark, {"t1": f"{tmp_dir}/t1"}).first()
    assert st.files >= 1 and st.bytes > 0
    checks = R.audit_table(Q.check_dims(spark.createDataFrame([("a",)], "d string"), ["d"]))
    assert checks.count() == 1


def test_filters(spark):
    df = spark.createDataFrame([("b1", "f.csv", "Cuiabá"), ("b2", "g.csv", "SÃ£o Paulo")], "batch_id string, source_file string, t string")
    assert of_batch(df, "b1").count() == 1 and from_file(df, "g.csv").count() == 1
    assert contains_any(df, "t", ["á"]).count() == 1
    assert {r.column: r.suspect for r in mojibake(df).collect()}["t"] == 1


def test_profile_tables(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 3.0)], "s string, x double")
    t = R.profile_tables(df)
    assert {r.column for r in t["columns"].collect()} == {"s", "x"}
    assert t["summary"].first()["column"] == "x"
    assert {(r.col, r.v): r.n for r in t["values"].collect()}[("s", "a")] == 2
