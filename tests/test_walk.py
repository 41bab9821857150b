"""Folders listed by tasks; headers that share no name with the schema."""

import os

import pytest
from pyspark.sql import functions as F

from strata.sources import files as S
from strata.sources.dialect import Dialect
from strata.sources.walk import walk_files


def _write(path, text, encoding="utf-8"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding=encoding) as fh:
        fh.write(text)


def test_walk_equals_the_recursive_listing(spark, tmp_dir):
    names = ["a.csv", "x/b c.csv", "x/y/100%.csv", "x/y/[1] #2.csv", "x/empty.csv", "k=1/_z=2/p.csv", "x/a+b,c;d&e=f.csv"]
    for k, n in enumerate(names):
        _write(f"{tmp_dir}/{n}", "" if "empty" in n else "x" * (k + 1))
    for n in ["_SUCCESS", ".hidden/a.csv", "x/_temporary/b.csv", "x/.b.crc", "x/c._COPYING_"]:
        _write(f"{tmp_dir}/{n}", "no")
    os.makedirs(f"{tmp_dir}/none")
    walked, listed = walk_files(spark, tmp_dir), S.list_files(spark, tmp_dir, recursive=True)
    assert walked.columns == listed.columns
    # Spark's listing leaves empty files out, the walk gives them
    assert sorted(map(tuple, walked.where("length > 0").collect())) == sorted(map(tuple, listed.collect()))
    assert [r.name for r in walked.where("length = 0").collect()] == ["empty.csv"]
    assert walked.count() == len(names)
    # the same by a path with a scheme; a file is known by its source path
    again = walk_files(spark, f"file://{tmp_dir}/")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, walked.collect()))
    rows = S.read_text(spark, f"{tmp_dir}/x/y", source_column="f").select("f").distinct()
    assert rows.join(walked, F.col("f") == F.col("source_path")).count() == 2


def test_walk_of_empty_and_missing_folders(spark, tmp_dir):
    assert walk_files(spark, tmp_dir).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        walk_files(spark, f"{tmp_dir}/nowhere")


def test_new_files_of_a_walk(spark, tmp_dir):
    for k in range(300):
        _write(f"{tmp_dir}/d{k % 20}/data{k}.csv", "x")
    walked = walk_files(spark, tmp_dir)
    seen = walked.where("name like '%0.csv'").select("source_path", F.col("length").alias("source_length"), F.col("modificationTime").alias("source_modified"))
    seen.write.parquet(f"{tmp_dir}/_manifest")
    _write(f"{tmp_dir}/d0/data0.csv", "changed")
    new = S.new_files(walk_files(spark, tmp_dir), spark.read.parquet(f"{tmp_dir}/_manifest"))
    assert new.count() == 271  # 270 never seen and the one that changed


@pytest.mark.parametrize("multiline", [False, True])
def test_header_without_a_known_name_is_not_guessed(spark, tmp_dir, multiline):
    _write(f"{tmp_dir}/a.csv", "title\nid;v\n1;x\n")
    _write(f"{tmp_dir}/b.csv", "title\nprice;day\n2;y\n")
    d = Dialect(sep=";", preamble=1, multiline=multiline)
    rows = S.read_csv(spark, tmp_dir, d, "id int, v string", corrupt_column=True).collect()
    assert sorted((r.id or 0, r.v or "", r._corrupt_record or "") for r in rows) == [(0, "", "2;y"), (1, "x", "")]
    with pytest.raises(Exception, match="shares no column name with the schema in .*b.csv"):
        S.read_csv(spark, tmp_dir, d, "id int, v string").collect()
    asked = Dialect(sep=";", preamble=1, multiline=multiline, by_position=True)
    assert sorted(map(tuple, S.read_csv(spark, tmp_dir, asked, "id int, v string").collect())) == [(1, "x"), (2, "y")]


def test_unknown_headers_of_wide_files_and_archives_fail(spark, tmp_dir):
    import zipfile

    from strata.sources.archives import read_zip_csv

    _write(f"{tmp_dir}/w/b.csv", "title\nprice;day\n2;y\n", "utf-16")
    wide = Dialect(sep=";", preamble=1, multiline=True, encoding="utf-16")
    with pytest.raises(ValueError, match="shares no column name with the schema in .*b.csv"):
        S.read_csv(spark, f"{tmp_dir}/w", wide, "id int, v string")
    with zipfile.ZipFile(f"{tmp_dir}/t.zip", "w") as z:
        z.writestr("b.csv", "title\nprice;day\n2;y\n")
    schema = spark.createDataFrame([], "id int, v string").schema
    with pytest.raises(Exception, match="shares no column name with the schema in .*b.csv"):
        read_zip_csv(spark, f"{tmp_dir}/t.zip", Dialect(sep=";", preamble=1), schema=schema).collect()


def test_bronze_of_a_walk_reports_empty_files(spark, tmp_dir):
    from strata.plans.stages import run_bronze

    _write(f"{tmp_dir}/in/x/a.csv", "id,v\n1,x\n2,y\n")
    _write(f"{tmp_dir}/in/y/b.csv", "")
    first = run_bronze(spark, "", f"{tmp_dir}/lake", listing=walk_files(spark, f"{tmp_dir}/in"))
    found = {r["check"]: r["status"] for r in first.checks.collect()}
    assert found["no_empty_files"] == "fail" and found["rows_in_equals_rows_out"] == "pass"
    manifest = spark.read.parquet(first.paths["manifest"]).select("source_length", "row_count").collect()
    assert sorted(map(tuple, manifest)) == [(0, 0), (13, 2)]
    again = run_bronze(spark, "", f"{tmp_dir}/lake", listing=walk_files(spark, f"{tmp_dir}/in"))
    assert again.info["files"] == 0
