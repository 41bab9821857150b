"""Queries that build their input files: no task may get a whole table."""

import datetime as dt
import os

import duckdb
import pytest

from strata.plans import files_catalogue as FC
from strata.plans import shaping_catalogue as SH
from strata.sources.dialect import Dialect


def duck(tables, sql):
    con = duckdb.connect()
    for name in ("lineitem", "orders", "supplier", "documents"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tables}/{name}.parquet/*.parquet'")
    return con.execute(sql).fetchall()


@pytest.fixture
def tables(spark, tmp_dir):
    """Line items (of nine ship years), orders, suppliers and documents of one folder."""
    day = lambda i: dt.datetime(1992 + i % 9, 1 + i % 12, 1)
    flags = ["A", "N", "R"]
    lines = [(i // 3, i % 50, i % 10, i % 3, float(i % 50), i / 7, 0.0, 0.0, flags[i % 3], "F", day(i)) for i in range(400)]
    lines += [(k, p + 1, s, n, q, e, x, t, r, st, d + dt.timedelta(days=400)) for k, p, s, n, q, e, x, t, r, st, d in lines[:90]]
    cols = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, cols).repartition(9).write.parquet(f"{tmp_dir}/lineitem.parquet")
    orders = [(i, i % 30, "OFP"[i % 3], i * 1.5, day(i), "1-URGENT") for i in range(200)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string").repartition(9).write.parquet(f"{tmp_dir}/orders.parquet")
    spark.createDataFrame([(i, 100.0 * (i - 2)) for i in range(8)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_dir}/supplier.parquet")
    docs = [(i, "en", f'line {i}\n"quoted; {i}"\nend' * (i % 4)) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").repartition(9).write.parquet(f"{tmp_dir}/documents.parquet")
    return tmp_dir


@pytest.fixture
def own_splits(spark):
    """Every stored file is a split of its own, as in a large table."""
    names = {"spark.sql.files.openCostInBytes": "128m", "spark.sql.files.maxPartitionBytes": "128m"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_storage_reads_no_file_as_one_value(spark, tables):
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "1000")  # for files beyond 2 GB
    try:
        rows = SH.r7_storage(spark, tables).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    assert sorted(map(tuple, rows)) == [("lineitem", 3, True), ("orders", 1, True)]


def test_content_bytes_are_the_files_sizes(spark, tmp_dir):
    df = spark.range(300).selectExpr("id", "if(id % 3 = 2, null, cast(id % 3 as string)) as v", "repeat('\n', cast(id % 5 as int)) as t")
    df.repartition(3).write.json(f"{tmp_dir}/f/json")
    SH._one_file_each(spark, df, f"{tmp_dir}/f/parquet", "v")
    got = {r["path"].split(":", 1)[1].replace("///", "/"): r["bytes"] for r in SH.content_bytes(spark, f"{tmp_dir}/f").collect()}
    want = {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, ns in os.walk(f"{tmp_dir}/f") for n in ns if n.startswith("part-")}
    assert got == want
    assert sum("/parquet/" in p for p in want) == 3  # a file per value, null too
    stored = spark.read.schema(df.schema).parquet(f"{tmp_dir}/f/parquet").select("id", "v", "t")
    assert sorted(stored.collect(), key=lambda r: r["id"]) == df.collect()


def _line_files_written(spark, monkeypatch, query, tables):
    """The query's rows, and how many CSV files it wrote at each call."""
    seen = []
    real = FC.K.write_csv

    def noted(df, path, *args, **kwargs):
        real(df, path, *args, **kwargs)
        seen.append(sum(n.endswith(".csv") for n in FC.K.list_dir(spark, path)))

    monkeypatch.setattr(FC.K, "write_csv", noted)
    return query(spark, tables).collect(), seen


@pytest.mark.parametrize("name", ["e2e_lineitem_layers", "t1_stream_bronze", "t2_stream_rules"])
def test_line_files_grow_in_number_not_size(spark, tables, own_splits, monkeypatch, name):
    rows, files = _line_files_written(spark, monkeypatch, FC.FILE_QUERIES[name], tables)
    assert files == [9]  # as many as the table's splits, not four
    want = duck(tables, FC.FILE_ORACLE[name])
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))


def test_small_tables_are_dealt_over_four_files(spark, tables):
    df = spark.read.parquet(f"{tables}/supplier.parquet").coalesce(1)
    assert FC.dealt(df).rdd.getNumPartitions() == 4


def test_files_with_titles_grow_in_number_not_size(spark, tables, tmp_dir, own_splits):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    FC.write_with_titles(docs, f"{tmp_dir}/titles", Dialect(sep=";"), FC.TITLE_LINES)
    assert sum(n.endswith(".txt") for n in FC.K.list_dir(spark, f"{tmp_dir}/titles")) == 9
    got = FC.s3_multiline_preamble(spark, tables).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((r["doc_id"], r["text"]) for r in docs.collect())


def test_epochs_are_written_by_many_tasks(spark, tables, own_splits, monkeypatch):
    sources, files = [], []
    scratch, stream = FC.scratch_dir, FC.stream_silver

    def noted(*args, **kwargs):
        files.append(sum(n.endswith(".csv") for n in FC.K.list_dir(spark, sources[0])))
        return stream(*args, **kwargs)

    monkeypatch.setattr(FC, "scratch_dir", lambda s, n: sources.append(scratch(s, n)) or sources[-1])
    monkeypatch.setattr(FC, "stream_silver", noted)
    rows = FC.t2_stream_silver(spark, tables).collect()
    assert len(files) == 6 and files[0] > 1  # an epoch per pair of years, of more than one file
    assert sorted(map(tuple, rows)) == sorted(duck(tables, FC.FILE_ORACLE["t2_stream_silver"]))
