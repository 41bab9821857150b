import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions import columns as P
from strata.functions.scalars import to_bool


def test_with_lineage_uses_row_file(spark, tmp_dir):
    spark.range(3).write.parquet(f"{tmp_dir}/a")
    df = spark.read.parquet(f"{tmp_dir}/a")
    out = P.with_lineage(df, "b1", "2024-02-03")
    r = out.select("ingestion_date", "source_file", "batch_id").distinct().collect()
    assert all(x.ingestion_date == dt.date(2024, 2, 3) and x.batch_id == "b1" and x.source_file.endswith(".parquet") for x in r)
    assert dict(out.dtypes)["ingestion_date"] == "date"  # D14


def test_rename_present_ignores_absent(spark):
    df = spark.createDataFrame([(1, 2)], "D1C int, V int")
    assert P.rename_present(df, {"D1C": "state_id", "XX": "y"}).columns == ["state_id", "V"]


def test_snake_case_and_collision(spark):
    df = spark.createDataFrame([(1, 2)], "`Nome Municipio` int, `Ano-Ref` int")
    assert P.snake_case(df).columns == ["nome_municipio", "ano_ref"]
    with pytest.raises(ValueError):
        P.snake_case(spark.createDataFrame([(1, 2)], "`A b` int, `a-b` int"))


def test_coerce_keep_source_and_missing(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.BooleanType()), T.StructField("c", T.StringType())])
    df = spark.createDataFrame([("1", "sim", "x")], "a string, b string, extra string")
    out = P.coerce(df, schema, {"b": to_bool}, keep_source=True)
    assert out.columns == ["a", "b", "c", "extra", "__src_a", "__src_b"]
    r = out.first()
    assert (r["a"], r["b"], r["c"], r["__src_a"]) == (1, True, None, "1")


def test_strict_select_fill_missing(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("z", T.StringType())])
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    kept, dropped = P.strict_select(df, schema)
    assert kept.columns == ["a"] and dropped == ["b"]
    filled, missing = P.fill_missing(df, schema)
    assert missing == ["z"] and dict(filled.dtypes)["z"] == "string"


def test_coalesce_drift(spark):
    df = spark.createDataFrame([(None, "9", 1), ("7", None, 2)], "CO_ESCOLA string, CO_ESCOLA_EDUCACENSO_2021 string, n int")
    out = P.coalesce_drift(df, "school_id", r"CO_ESCOLA(_EDUCACENSO_\d{4})?")
    assert out.columns == ["n", "school_id"]
    assert [r.school_id for r in out.orderBy("n").collect()] == ["9", "7"]


def test_decode_default_and_null(spark):
    df = spark.createDataFrame([("F",), ("O",), ("X",), (None,)], "s string")
    got = [r[0] for r in df.select(P.decode("s", {"F": "filled", "O": "open"}, "unknown")).collect()]
    assert got == ["filled", "open", "unknown", "unknown"]


def test_drop_empty_and_flatten(spark):
    df = spark.createDataFrame([(None, " ", "2024-01-01"), ("a", None, "2024-01-01")], "x string, y string, ingestion_date string")
    assert P.drop_empty(df).count() == 1
    j = spark.createDataFrame([('{"a": 1, "b": {"c": "z"}}',)], "p string")
    out = P.flatten(j, "p", "a int, b struct<c:string>")
    assert out.columns == ["a", "b"] and out.first().a == 1


def test_subset_and_stamp(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert P.subset(df, keep=["b"]).columns == ["b"]
    assert P.subset(df, drop=["b"]).columns == ["a"]
    assert "last_updated" in P.stamp(df).columns
