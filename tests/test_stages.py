"""End to end on the worked example's shape: a Latin-1, ';'-separated
population table with three title lines, through all four layers."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.operators.aggregates import Aggregate, Measure
from strata.plans.stages import run_bronze, run_gold, run_report, run_silver
from strata.sources.dialect import Dialect

TITLES = ["Tabela 1 - População residente estimada", "Variável - População residente estimada (Pessoas)", ""]
HEADER = "D1C;D1N;D2C;D2N;V"
ROWS = [
    "33;Rio de Janeiro;2020;2020;17366189",
    "35;São Paulo;2020;2020;46289333",
    "35;São Paulo;2020;2020;46289333",  # duplicate key (state, year)
    "31;Minas Gerais;1800;1800;21292666",  # year out of range
    "99;Atlântida;2020;2020;1",  # unknown state
    "31;Minas Gerais;20x1;20x1;21411923",  # bad cast
    ";Sem UF;2021;2021;5",  # null key
    "33;Rio de Janeiro;2021;2021;17463349",
]


def write(path, rows):
    with open(path, "wb") as fh:
        fh.write(("\r\n".join(TITLES + [HEADER] + rows) + "\r\n").encode("iso-8859-1"))


def test_four_layers(spark, tmp_dir):
    src = f"{tmp_dir}/src"
    import os

    os.makedirs(src)
    write(f"{src}/pop_2020.csv", ROWS[:5])
    write(f"{src}/pop_2021.csv", ROWS[5:])
    root = f"{tmp_dir}/lake"
    d = Dialect(sep=";", encoding="latin-1", preamble=3)

    b = run_bronze(spark, f"{src}/*.csv", root, d, batch_id="b1", ingestion_date="2024-01-01")
    assert b.info["rows"] == 8 and b.checks.filter("status = 'fail'").count() == 0
    again = run_bronze(spark, f"{src}/*.csv", root, d, batch_id="b2")  # idempotent: nothing new
    assert again.info["files"] == 0

    states = spark.createDataFrame([("33", "Rio de Janeiro", "Sudeste"), ("35", "São Paulo", "Sudeste"), ("31", "Minas Gerais", "Sudeste")], "state_id string, state_name string, region string")
    schema = T.StructType(
        [
            T.StructField("state_id", T.StringType()),
            T.StructField("state_name", T.StringType()),
            T.StructField("year", T.LongType()),
            T.StructField("population", T.DecimalType(18, 4)),
        ]
    )
    contract = Contract(
        "state-population",
        schema=schema,
        primary_keys=["state_id", "year"],
        dedup_keys=["state_id", "year"],
        required_columns=["state_id", "year"],
        rename={"D1C": "state_id", "D1N": "state_name", "D2C": "year", "V": "population"},
        rules=[Rule.range("year", "1900..2100", "year out of valid range"), Rule.foreign_key("state_id", states, "state_id", "state_id not in reference table")],
    )
    contract.validate(spark)
    s = run_silver(spark, b.paths["bronze"], contract, root, check_time=dt.datetime(2024, 1, 1, 12))
    assert (s.info["kept"], s.info["quarantined"]) == (3, 5)
    # only the report of the columns that were dropped
    assert [r.check for r in s.checks.filter("status = 'fail'").collect()] == ["expected_columns_only"]
    silver = spark.read.parquet(s.paths["silver"])
    # lineage is kept; columns the contract doesn't know are dropped and reported
    assert "source_file" in silver.columns and "D2N" not in silver.columns
    assert "D2N" in s.info["unexpected_columns"]

    silver_days = spark.read.parquet(s.paths["silver"]).withColumn("day", F.make_date("year", F.lit(1), F.lit(1)))
    silver_days.write.parquet(f"{root}/silver_days")
    aggs = [
        Aggregate("by_state_year", ["state_id", "year"], [Measure("total_population", "sum", "population"), Measure("row_count", "count_all")]),
        Aggregate("yearly_summary", ["year", "day"], [Measure("total_population", "sum", "population"), Measure("state_count", "count_distinct", "state_id")]),
    ]
    g = run_gold(
        spark, f"{root}/silver_days", aggs, f"{root}/gold",
        zorder={"by_state_year": ["year", "total_population"]},
        register_prefix="strata_test_gold_",
        comments={"state_id": "state code", "year": "reference year"},
        continuity={"yearly_summary": "day"},
    )
    assert g.checks.filter("status = 'fail' AND on_fail = 'abort'").count() == 0
    assert g.checks.filter("check = 'yearly_summary:date_continuity'").first().status == "fail"  # 2020 -> 2021 is a gap of days
    assert "last_updated" in spark.read.parquet(g.paths["yearly_summary"]).columns
    assert spark.table("strata_test_gold_by_state_year").count() == 3
    yearly = {r.year: (float(r.total_population), r.state_count) for r in spark.read.parquet(g.paths["yearly_summary"]).collect()}
    assert yearly == {2020: (17366189 + 46289333, 2), 2021: (17463349.0, 1)}

    rep = run_report(spark, b, s, g, aggs)
    reasons = {r.reason: r.rows for r in rep["failure_reasons"].collect()}
    assert reasons == {
        "duplicate": 1,
        "year out of valid range": 1,
        "state_id not in reference table": 1,
        "type_coercion_failed": 1,
        "required_column_null:state_id": 1,
    }
    summary = {r.output: r.rows for r in rep["run_summary"].collect()}
    assert summary["bronze"] == 8 and summary["silver"] == 3 and summary["quarantine"] == 5
    assert rep["audits"].filter("status = 'fail' AND on_fail = 'abort'").count() == 0
    assert rep["batches"].first().rows == 8
    assert rep["storage"].count() >= 4
    assert rep["bad_samples"].count() == 5
    for n in ("by_state_year", "yearly_summary"):
        spark.sql(f"DROP TABLE IF EXISTS strata_test_gold_{n}")
