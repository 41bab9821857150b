"""Q1-Q12 and the D-item regressions of the Silver classifier."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule, parse_range
from strata.operators.quality import REASON, VALUE, CHECK_TIME, check_conservation, classify, outcome_counts, split

SCHEMA = T.StructType(
    [
        T.StructField("state_id", T.StringType()),
        T.StructField("year", T.LongType()),
        T.StructField("population", T.DecimalType(18, 4)),
        T.StructField("is_capital", T.BooleanType()),
        T.StructField("ingestion_date", T.DateType()),
    ]
)


def states(spark):
    return spark.createDataFrame([("RJ",), ("SP",), ("MG",)], "state_id string")


def contract(spark, **kw):
    from strata.functions.scalars import to_bool, to_decimal_br

    return Contract(
        "state-population",
        schema=SCHEMA,
        primary_keys=["state_id", "year"],
        dedup_keys=["state_id", "year"],
        required_columns=["state_id", "year"],
        rules=[
            Rule.range("year", "1900..2100", "year out of valid range"),
            Rule.foreign_key("state_id", states(spark), "state_id", "state_id not in reference table"),
            Rule.custom("population", "population >= 0", "negative population"),
        ],
        coercers={"population": to_decimal_br, "is_capital": to_bool},
        **kw,
    )


ROWS = [
    # state, year, population, capital, ingestion_date
    ("RJ", "2020", "1.000,5", "sim", "2024-01-01"),  # kept
    ("RJ", "2020", "999", "nao", "2024-01-02"),  # duplicate (later)
    ("SP", "1800", "10", "s", "2024-01-01"),  # year out of range
    ("XX", "2020", "10", "s", "2024-01-01"),  # FK
    ("MG", "20x0", "10", "s", "2024-01-01"),  # coercion
    (None, "2021", "10", "s", "2024-01-01"),  # required
    ("MG", "2021", "-5", "s", "2024-01-01"),  # custom
    ("MG", "2022", None, None, "2024-01-01"),  # kept (nullable columns null)
    ("MG", "2023", "10", "talvez", "2024-01-01"),  # coercion of bool word
]


def bronze(spark):
    df = spark.createDataFrame(ROWS, "state_id string, year string, population string, is_capital string, ingestion_date string")
    return df.withColumn("ingestion_date", F.to_date("ingestion_date"))


def reasons(flagged):
    return {(r.state_id, r.year if r.year is not None else None): r[REASON] for r in flagged.collect()}


def test_every_rule_and_value(spark):
    f = classify(bronze(spark), contract(spark), check_time=dt.datetime(2024, 5, 1, 12))
    rows = f.orderBy("ingestion_date", "state_id", "year").collect()
    got = sorted(((r.state_id, r.year, r[REASON], r[VALUE]) for r in rows), key=repr)
    assert got == sorted(
        [
            ("RJ", 2020, None, None),
            ("RJ", 2020, "duplicate", "RJ|2020"),
            ("SP", 1800, "year out of valid range", "1800"),
            ("XX", 2020, "state_id not in reference table", "XX"),
            ("MG", None, "type_coercion_failed", "20x0"),  # D5: uncast source text
            (None, 2021, "required_column_null:state_id", None),
            ("MG", 2021, "negative population", "-5.0000"),
            ("MG", 2022, None, None),
            ("MG", 2023, "type_coercion_failed", "talvez"),
        ],
        key=repr,
    )
    assert {r[CHECK_TIME] for r in rows} == {dt.datetime(2024, 5, 1, 12)}


def test_conservation_q11(spark):
    f = classify(bronze(spark), contract(spark))
    r = check_conservation(f, n_in=len(ROWS)).first()
    assert r.ok and r.kept + r.quarantined == len(ROWS)
    kept, quarantined = split(f)
    assert kept.count() + quarantined.count() == len(ROWS)
    assert REASON not in kept.columns


def test_d1_null_passes_range_rule(spark):
    df = spark.createDataFrame([(1,), (None,), (5000,)], "year long")
    f = classify(df, Contract("t", rules=[Rule.range("year", "1900..2100")]))
    got = sorted(((r.year is None, r[REASON]) for r in f.collect()), key=repr)
    # null survives (no row vanishes); 1 and 5000 fail
    assert got == sorted([(False, "year failed validation"), (False, "year failed validation"), (True, None)], key=repr)


def test_d4_null_keys_fail_required_not_duplicate(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, v int")
    f = classify(df, Contract("t", dedup_keys=["k"], dedup_order=["v"], required_columns=["k"]))
    assert sorted(r[REASON] or "kept" for r in f.collect()) == ["kept", "required_column_null:k", "required_column_null:k"]


def test_rejected_row_does_not_shadow_good_duplicate(spark):
    # first row (v=1) fails coercion, so the second becomes the kept one
    df = spark.createDataFrame([("a", "x", 1), ("a", "5", 2)], "k string, n string, v int")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("v", T.IntegerType())])
    f = classify(df, Contract("t", schema=schema, dedup_keys=["k"], dedup_order=["v"]))
    assert sorted((r.v, r[REASON]) for r in f.collect()) == [(1, "type_coercion_failed"), (2, None)]


def test_rank_before_range_as_reference(spark):
    # the first row fails the range rule; its duplicate stays a duplicate
    df = spark.createDataFrame([("a", 1, 999), ("a", 2, 5)], "k string, v int, q int")
    f = classify(df, Contract("t", dedup_keys=["k"], dedup_order=["v"], rules=[Rule.range("q", "0..10")]))
    assert sorted((r.v, r[REASON]) for r in f.collect()) == [(1, "q failed validation"), (2, "duplicate")]


def test_fk_null_semantics(spark):
    ref = spark.createDataFrame([("a",)], "k string")
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    strict = classify(df, Contract("t", rules=[Rule.foreign_key("k", ref)]))
    assert sorted(str(r[REASON]) for r in strict.collect()) == ["None", "k not in reference", "k not in reference"]
    lenient = classify(df, Contract("t", rules=[Rule.foreign_key("k", ref, allow_null=True)]))
    assert sorted(str(r[REASON]) for r in lenient.collect()) == ["None", "None", "k not in reference"]


def test_parse_range_f4():
    assert parse_range("year", "1900..2100") == "`year` BETWEEN 1900 AND 2100"
    assert parse_range("s", "active|inactive|pending") == "`s` IN ('active', 'inactive', 'pending')"
    assert parse_range("uf", "01|02") == "`uf` IN ('01', '02')"
    assert parse_range("d", "2020-01-01..2020-12-31") == "`d` BETWEEN '2020-01-01' AND '2020-12-31'"
    assert parse_range("r", "0.5..1.5") == "`r` BETWEEN 0.5 AND 1.5"
    assert parse_range("r", "-10 .. -1") == "`r` BETWEEN -10 AND -1"
    assert parse_range("x", "..10") == "`x` <= 10"
    assert parse_range("x", "5..") == "`x` >= 5"
    assert parse_range("x", "x % 3 = 0") == "x % 3 = 0"


def test_contract_validate_rejects_bad_rule(spark):
    c = Contract("t", schema=SCHEMA, rules=[Rule.custom("year", "yaer > 1")])
    with pytest.raises(ValueError):
        c.validate(spark)
    contract(spark).validate(spark)


def test_contract_from_dict(spark):
    spec = {
        "dataset": {
            "slug": "state-population",
            "primary_keys": ["state_id", "year"],
            "dedup_keys": ["state_id", "year"],
            "required_columns": ["state_id", "year"],
            "value_ranges": {"year": "year BETWEEN 1900 AND 2100"},
            "foreign_keys": {"state_id": "states_clean"},
        }
    }
    c = Contract.from_dict(spec, SCHEMA, {"states_clean": states(spark)})
    assert c.table_name == "state_population"
    assert [r.kind for r in c.all_rules()] == ["required", "required", "range", "foreign_key"]


def test_outcomes_match_reference_order_on_lineitem(spark):
    from tests.conftest import SF0001

    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    sup = spark.read.parquet(f"{SF0001}/supplier.parquet").filter("s_acctbal >= 0")
    c = Contract("li", dedup_keys=["l_orderkey", "l_linenumber"], dedup_order=["l_shipdate", "l_partkey", "l_suppkey"],
                 rules=[Rule.range("l_quantity", "5..45"), Rule.foreign_key("l_suppkey", sup, "s_suppkey")])
    a = sorted(tuple(r) for r in outcome_counts(classify(li, c)).collect())
    b = sorted(tuple(r) for r in outcome_counts(classify(li, c, clustered=True)).collect())
    assert a == b and sum(n for _, n in a) == li.count()


# --- properties ---------------------------------------------------------------

row = st.tuples(st.sampled_from(["a", "b", "c", None]), st.one_of(st.none(), st.integers(-5, 15)), st.integers(0, 3))


@settings(max_examples=8, deadline=None)
@given(st.lists(row, min_size=0, max_size=30))
def test_property_split_is_a_partition_and_idempotent(spark, rows):
    df = spark.createDataFrame(rows, "k string, x int, v int")
    c = Contract("p", dedup_keys=["k"], dedup_order=["v"], required_columns=["k"], rules=[Rule.range("x", "0..10"), Rule.custom("x", "x % 2 = 0")])
    f = classify(df, c)
    kept, q = split(f)
    # multiset: kept + quarantined = input
    both = [tuple(r) for r in kept.select("k", "x", "v").collect()] + [tuple(r) for r in q.select("k", "x", "v").collect()]
    assert sorted(both, key=repr) == sorted(rows, key=repr)
    # kept satisfies every rule, and a second pass quarantines nothing
    again = classify(kept, c)
    assert again.filter(F.col(REASON).isNotNull()).count() == 0
    # independent of partitioning
    f2 = classify(df.repartition(3), c)
    assert sorted(map(tuple, f.select("k", "x", "v", REASON).collect()), key=repr) == sorted(map(tuple, f2.select("k", "x", "v", REASON).collect()), key=repr)


def test_isin_keeps_text_codes(spark):
    df = spark.createDataFrame([("01",), ("1",), ("02",)], "uf string")
    f = classify(df, Contract("t", rules=[Rule.isin("uf", ["01", "02"])]))
    assert sorted(str(r[REASON]) for r in f.collect()) == ["None", "None", "uf failed validation"]
    n = spark.createDataFrame([(1,), (3,)], "n int")
    g = classify(n, Contract("t", rules=[Rule.range("n", "1|2")]))
    assert sorted(str(r[REASON]) for r in g.collect()) == ["None", "n failed validation"]


def test_contract_from_yaml(spark):
    text = """
dataset:
  slug: "state-population"
  primary_keys: ["state_id", "year"]
  dedup_keys: ["state_id", "year"]
  required_columns:
    - "state_id"
    - "year"
  value_ranges:
    "year": "1900..2100"
  foreign_keys:
    "state_id": "states_clean"
  custom_rules:
    - {column: "population", expr: "population >= 0", message: "negative population"}
"""
    c = Contract.from_yaml(text, SCHEMA, {"states_clean": states(spark)})
    assert [r.kind for r in c.all_rules()] == ["required", "required", "range", "foreign_key", "custom"]
    assert c.rules[0].expr == "`year` BETWEEN 1900 AND 2100"
    c.validate(spark)
