import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from strata.functions import scalars as X


def one(spark, col, data, schema="s string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_to_bool_words_case_and_unknown(spark):
    words = ["yes", "TRUE", " 1 ", "S", "Sim", "no", "False", "0", "n", "NAO", "Não", "talvez", "", None]
    got = one(spark, X.to_bool("s"), [(w,) for w in words])
    assert got == [True] * 5 + [False] * 6 + [None, None, None]


def test_to_decimal_br_d6(spark):
    vals = ["10,5", "1.234,56", "10.5", "abc", "", None, "1.234.567,891"]
    got = one(spark, X.to_decimal_br("s"), [(v,) for v in vals])
    assert got == [Decimal("10.5000"), Decimal("1234.5600"), Decimal("10.5000"), None, None, None, Decimal("1234567.8910")]


def test_safe_cast_never_fails_under_ansi(spark):
    got = one(spark, X.safe_cast("s", "int"), [("12",), ("n/a",), (None,), ("99999999999",)])
    assert got == [12, None, None, None]
    got = one(spark, X.safe_cast("s", "date", "dd/MM/yyyy"), [("31/12/2020",), ("2020-12-31",)])
    assert got == [dt.date(2020, 12, 31), None]


def test_basename(spark):
    got = one(spark, X.basename("s"), [("/a/b/c.csv",), ("c.csv",), ("https://x.org/p/",), (None,)])
    assert got == ["c.csv", "c.csv", "", None]


def test_trunc_date_returns_date(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 5, 17, 13, 4),)], "t timestamp_ntz")
    r = df.select(X.trunc_date("t", "month").alias("m"), X.trunc_date("t", "year").alias("y")).first()
    assert r.m == dt.date(2021, 5, 1) and r.y == dt.date(2021, 1, 1)


def test_to_utc(spark):
    got = one(spark, X.to_utc("s"), [("2021-01-02T03:04:05Z",), ("2021-01-02T05:04:05+02:00",), ("nope",)])
    assert got[0] == got[1] and got[2] is None


def test_pct_and_json_and_digits(spark):
    df = spark.createDataFrame([(1,), (3,)], "n int")
    assert [r[0] for r in df.select(X.pct("n", df.select(F.sum("n")).scalar())).collect()] == [25.0, 75.0]
    got = one(spark, X.json_field("s", "$.k", "int"), [('{"k": 4}',), ('{"k": "x"}',), ("bad",)])
    assert got == [4, None, None]
    got = one(spark, X.keeps_leading_zeros("s", 5), [("00123",), ("123",), ("0012a",)])
    assert got == [True, False, False]
    assert one(spark, X.is_digits("s"), [("123",), ("12a",), ("",)]) == [True, False, False]


def test_new_batch_id_is_one_per_call():
    assert X.new_batch_id() != X.new_batch_id()
