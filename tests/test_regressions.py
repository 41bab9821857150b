"""
a runtime surface. Each name carries its D-number."""

import datetime as dt
import os


from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.functions import columns as P
from strata.functions import scalars as X
from strata.operators.quality import CHECK_TIME, REASON, VALUE, classify, split
from strata.operators.report import batch_metadata
from strata.plans.stages import bronze
from strata.sinks import layout as K
from strata.sources import files as S
from strata.sources.dialect import Dialect, canonical_encoding


def test_d1_null_in_rule_column_is_kept_not_lost(spark):
    df = spark.createDataFrame([(1950,), (None,), (1800,)], "year long")
    kept, q = split(classify(df, Contract("t", rules=[Rule.range("year", "1900..2100")])))
    assert kept.count() + q.count() == 3 and kept.filter(F.col("year").isNull()).count() == 1


def test_d2_bad_cast_does_not_abort_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") in ("true", "True")
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    f = classify(spark.createDataFrame([("abc",), ("5",)], "n string"), Contract("t", schema=schema))
    assert sorted(str(r[REASON]) for r in f.collect()) == ["None", "type_coercion_failed"]


def test_d3_keep_first_is_deterministic_across_partitionings(spark):
    rows = [("k", 1, f"payload{i}") for i in range(20)]  # all tied on key and order
    df = spark.createDataFrame(rows, "k string, d int, p string")
    c = Contract("t", dedup_keys=["k"], dedup_order=["d"])
    picks = {classify(df.repartition(n), c).filter(F.col(REASON).isNull()).first().p for n in (1, 3, 7)}
    assert len(picks) == 1


def test_d4_null_dedup_keys_are_required_failures(spark):
    df = spark.createDataFrame([(None,), (None,)], "k string")
    f = classify(df, Contract("t", dedup_keys=["k"], required_columns=["k"]))
    assert {r[REASON] for r in f.collect()} == {"required_column_null:k"}


def test_d5_failure_value_is_the_offending_value(spark):
    f = classify(spark.createDataFrame([(1800,)], "year long"), Contract("t", rules=[Rule.range("year", "1900..2100")]))
    assert f.first()[VALUE] == "1800"


def test_d6_thousands_and_decimal_comma(spark):
    r = spark.createDataFrame([("1.234,56",)], "s string").select(X.to_decimal_br("s")).first()[0]
    assert float(r) == 1234.56


def test_d7_non_required_bad_value_is_quarantined_not_silently_null(spark):
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.DoubleType())])
    f = classify(spark.createDataFrame([("x", "12,x")], "a string, n string"), Contract("t", schema=schema))
    r = f.first()
    assert r[REASON] == "type_coercion_failed" and r[VALUE] == "12,x"


def test_d8_strict_schema_drops_and_reports(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType())])
    kept, dropped = P.strict_select(spark.createDataFrame([(1, 2)], "a int, junk int"), schema)
    assert kept.columns == ["a"] and dropped == ["junk"]


def test_d9_quarantine_partitioned_by_day(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (2,)], "v int")
    q = classify(df, Contract("t", rules=[Rule.range("v", "5..9")]), check_time=dt.datetime(2024, 1, 1, 23, 59, 59))
    K.append_quarantine(q, f"{tmp_dir}/q")
    assert [n for n in os.listdir(f"{tmp_dir}/q") if n.startswith("_dq")] == ["_dq_check_date=2024-01-01"]


def test_d10_run_time_is_a_value(spark):
    ts = X.run_timestamp()
    assert isinstance(ts, dt.datetime) and "Column" not in str(ts)


def test_d11_batch_id_comes_from_lineage(spark):
    b = bronze(spark.range(3), "batch-7", "2024-01-01")
    assert batch_metadata(K.manifest_rows(b)).first().batch_id == "batch-7"


def test_d14_ingestion_date_is_a_date(spark):
    assert dict(bronze(spark.range(1), "b", "2024-01-01").dtypes)["ingestion_date"] == "date"


def test_d15_bronze_keeps_source_names(spark):
    df = spark.createDataFrame([(1,)], "D1C int")
    assert bronze(df, "b").columns[0] == "D1C"


def test_d16_d25_rename_map_is_data_and_missing_columns_reported(spark):
    schema = T.StructType([T.StructField("population", T.LongType()), T.StructField("is_capital", T.BooleanType())])
    df = spark.createDataFrame([("10",)], "V string")
    c = Contract("t", schema=schema, rename={"V": "population"}, required_columns=["is_capital"])
    assert P.missing_columns(P.rename_present(df, c.rename), schema) == ["is_capital"]
    f = classify(df, c)
    assert f.first()[REASON] == "required_column_null:is_capital" and f.first().population == 10


def test_d18_header_rule_rejects_nan(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w") as fh:
        fh.write("nan;x\n12345;y\nid;name\n1;a\n")
    hdr = S.detect_header_rows(spark, tmp_dir, Dialect(sep=";")).first()
    assert hdr.header_line == 3


def test_d19_source_file_is_per_row(spark, tmp_dir):
    for n in ("a", "b"):
        with open(f"{tmp_dir}/{n}.csv", "w") as fh:
            fh.write("x\n1\n")
    df = S.read_dir(spark, f"{tmp_dir}/*.csv")
    assert sorted(r.source_file.split(":")[-1].replace("//", "") for r in df.collect()) == [f"{tmp_dir}/a.csv", f"{tmp_dir}/b.csv"]


def test_d20_quarantine_rows_carry_their_run(spark):
    t = dt.datetime(2024, 2, 2, 2, 2, 2)
    f = classify(spark.createDataFrame([(1,)], "v int"), Contract("t", rules=[Rule.range("v", "5..9")]), check_time=t)
    assert f.first()[CHECK_TIME] == t


def test_d21_one_pass_order_duplicate_before_fk(spark):
    ref = spark.createDataFrame([("zz",)], "k2 string")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x")], "k string, v int, k2 string")
    f = classify(df, Contract("t", dedup_keys=["k"], dedup_order=["v"], rules=[Rule.foreign_key("k2", ref)]))
    assert sorted((r.v, r[REASON]) for r in f.collect()) == [(1, "k2 not in reference"), (2, "duplicate")]


def test_d23_latin1_alias(spark):
    assert canonical_encoding("Latin-1") == "ISO-8859-1"


def test_d24_no_default_fill_for_nulls(spark):
    schema = T.StructType([T.StructField("n", T.IntegerType())])
    out = P.coerce(spark.createDataFrame([(None,)], "n string"), schema)
    assert out.first().n is None


def test_d26_slug_becomes_identifier():
    assert Contract("state-population").table_name == "state_population"
