"""File-dialect tests on generated files (shapes from FIXTURES.md)."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources import archives as Z
from strata.sources import files as S
from strata.sources.dialect import Dialect, canonical_encoding
from strata.sources.payload import explode_payload, records_as_columns

HEADER = '"D1C";"D1N";"D2C";"V"'
TITLES = ["Tabela 1 - População residente estimada (Pessoas)", "", "Unidade da Federação x Ano"]


def population_file(path, n, start=0, titles=TITLES):
    lines = list(titles) + [HEADER]
    for i in range(start, start + n):
        lines.append(f'"{i:02d}";"São Paulo {i}";"2020";"{i * 10}"')
    with open(path, "wb") as fh:
        fh.write(("\r\n".join(lines) + "\r\n").encode("iso-8859-1"))


def test_encoding_aliases():
    assert canonical_encoding("Latin-1") == "ISO-8859-1"  # D23
    assert canonical_encoding("utf8") == "UTF-8"
    with pytest.raises(ValueError):
        canonical_encoding("klingon")


def test_preamble_latin1_semicolon_over_many_splits(spark, tmp_dir):
    population_file(f"{tmp_dir}/a.csv", 200)
    population_file(f"{tmp_dir}/b.csv", 200, start=1000)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")  # ~12 splits
    try:
        d = Dialect(sep=";", encoding="latin-1", preamble=3)
        df = S.read_csv(spark, tmp_dir, d, source_column="source_file")
        assert df.rdd.getNumPartitions() > 4
        rows = df.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(rows) == 400
    assert df.columns == ["D1C", "D1N", "D2C", "V", "source_file"]
    assert all(r.D1N.startswith("São Paulo") for r in rows)  # accents decoded
    # lineage holds the full path
    assert {r.source_file.rsplit(":", 1)[1].replace("//", "") for r in rows} == {f"{tmp_dir}/a.csv", f"{tmp_dir}/b.csv"}
    assert sum(1 for r in rows if r.D1C is None) == 0


def test_header_detection_auto(spark, tmp_dir):
    population_file(f"{tmp_dir}/a.csv", 5, titles=["x" * 80, "", "2024", "nan"])
    population_file(f"{tmp_dir}/b.csv", 5, titles=["Tabela 1 " * 10])
    hdr = {r.file: r.header_line for r in S.detect_header_rows(spark, tmp_dir, Dialect(sep=";", encoding="latin-1")).collect()}
    assert hdr == {"a.csv": 5, "b.csv": 2}
    df = S.read_csv(spark, tmp_dir, Dialect(sep=";", encoding="latin-1", preamble="auto"))
    assert df.count() == 10 and df.columns == ["D1C", "D1N", "D2C", "V"]


def test_plain_csv_schema_corrupt_and_multiline(spark, tmp_dir):
    with open(f"{tmp_dir}/m.csv", "w", encoding="utf-8") as fh:
        fh.write('id|text|n\n1|"line one\nline two"|5\n2|plain|x\n3|"say ""hi"""|7\n')
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType())])
    df = S.read_csv(spark, f"{tmp_dir}/m.csv", Dialect(sep="|", multiline=True), schema, corrupt_column=True)
    rows = {r.id: r for r in df.collect()}
    assert rows[1].text == "line one\nline two" and rows[1].n == 5
    assert rows[2].n is None and rows[2]._corrupt_record is not None  # S20
    assert rows[3].text == 'say "hi"'


def test_json_lines_and_payload_shapes(spark, tmp_dir):
    docs = [
        [{"a": 1}, {"a": 2}],
        {"data": [{"a": 3}], "meta": {"page": 1}},
        {"data": 5, "results": [{"a": 4}]},
        {"items": [{"a": 5}]},
        {"records": [{"a": 6}], "items": "x"},
        {"a": 7},
        [],
        42,
    ]
    with open(f"{tmp_dir}/p.jsonl", "w") as fh:
        for d in docs:
            fh.write(json.dumps(d) + "\n")
        fh.write("{not json\n")
    raw = S.read_text(spark, f"{tmp_dir}/p.jsonl")
    rows = explode_payload(raw, "value")
    out = records_as_columns(rows, "record", "a int").collect()
    good = sorted(r.a for r in out if r._payload_error is None)
    assert good == [1, 2, 3, 4, 5, 6, 7]
    assert sorted(r._payload_error for r in out if r._payload_error) == ["malformed_json", "unexpected_shape"]
    with open(f"{tmp_dir}/arr.json", "w") as fh:
        json.dump([{"a": 1, "b": "x"}, {"a": 2}], fh)
    df = S.read_json(spark, f"{tmp_dir}/arr.json", "a int, b string", multiline=True)
    assert df.count() == 2


def make_zip(path, members):
    with zipfile.ZipFile(path, "w") as zf:
        for name, text in members.items():
            zf.writestr(name, text.encode("iso-8859-1") if isinstance(text, str) else text)


def test_zip_members_and_pick_strategies(spark, tmp_dir):
    body = "id;nome\n1;Cuiabá\n2;Goiânia\n"
    make_zip(f"{tmp_dir}/exam_2021.zip", {
        "__MACOSX/DADOS/._MICRODADOS.csv": "junk",
        "LEIA-ME.txt": "readme",
        "DADOS/MICRODADOS_2021.csv": body,
        "DADOS/ITENS_PROVA_2021.csv": "id;x\n9;9\n",
    })
    make_zip(f"{tmp_dir}/censo.zip", {"a/escolas.csv": body, "a/turmas.csv": body, "a/docentes.csv": body, "a/outros.csv": body})
    members = Z.list_members(spark, f"{tmp_dir}/*.zip")
    assert members.filter(F.col("member").startswith("__MACOSX")).count() == 0
    first = {r.archive.split("/")[-1]: r.member for r in Z.pick_members(members, "first_csv").collect()}
    assert first == {"exam_2021.zip": "DADOS/MICRODADOS_2021.csv", "censo.zip": "a/escolas.csv"}
    ess = sorted(r.member for r in Z.pick_members(members, "essential", ["escolas", "docentes"]).collect())
    assert ess == ["DADOS/ITENS_PROVA_2021.csv", "DADOS/MICRODADOS_2021.csv", "a/docentes.csv", "a/escolas.csv"]
    kw = {r.archive.split("/")[-1]: r.member for r in Z.pick_members(members, "keyword_rank", ["microdados&2021", "itens"]).collect()}
    assert kw["exam_2021.zip"] == "DADOS/MICRODADOS_2021.csv"
    df = Z.read_zip_csv(spark, f"{tmp_dir}/exam_2021.zip", Dialect(sep=";", encoding="latin-1"))
    assert sorted(r.nome for r in df.collect()) == ["Cuiabá", "Goiânia"]


def test_listing_new_files_binary(spark, tmp_dir):
    for n in ("a", "b", "c"):
        with open(f"{tmp_dir}/{n}.csv", "w") as fh:
            fh.write("x\n1\n")
    listing = S.list_files(spark, f"{tmp_dir}/*.csv")
    assert sorted(r.name for r in listing.collect()) == ["a.csv", "b.csv", "c.csv"]
    seen = listing.where("name = 'a.csv'").selectExpr("source_path", "length as source_length", "modificationTime as source_modified")
    assert sorted(r.name for r in S.new_files(listing, seen).collect()) == ["b.csv", "c.csv"]
    # the same path with other bytes is a new file; an older manifest knows paths only
    other = seen.withColumn("source_length", F.lit(99).cast("long"))
    assert sorted(r.name for r in S.new_files(listing, other).collect()) == ["a.csv", "b.csv", "c.csv"]
    assert sorted(r.name for r in S.new_files(listing, seen.select("source_path")).collect()) == ["b.csv", "c.csv"]
    assert S.read_binary(spark, f"{tmp_dir}/a.csv").first().content == b"x\n1\n"
    head, cols, n = S.preview(S.read_csv(spark, f"{tmp_dir}/*.csv"), 2)
    assert head.count() == 2 and cols == [("x", "string")] and n == 3


def test_ctas_and_register(spark, tmp_dir):
    with open(f"{tmp_dir}/t.csv", "w") as fh:
        fh.write("id,name\n1,a\n2,b\n")
    t = S.ctas_from_files(spark, "strata_ctas_t", f"{tmp_dir}/t.csv")
    assert t.count() == 2
    t2 = S.register_files(spark, "strata_ext_t", "csv", f"{tmp_dir}/t.csv", {"header": "true"})
    assert sorted(r.name for r in t2.collect()) == ["a", "b"]
    spark.sql("DROP TABLE IF EXISTS strata_ctas_t")
    spark.sql("DROP TABLE IF EXISTS strata_ext_t")


def test_title_lines_with_quoted_line_breaks(spark, tmp_dir):
    body = 'D1C;D1N;V\r\n"33";"Rio de\r\nJaneiro";"10"\r\n"35";"São Paulo";"20"\r\n'
    long_title = "Tabela 1 - População residente estimada, por unidade da federação e ano"  # over 60 characters
    for name, titles in (("a.csv", long_title + "\r\n\r\n2024\r\n"), ("b.csv", long_title + "\r\nnan\r\n2023\r\n")):
        with open(f"{tmp_dir}/{name}", "wb") as fh:
            fh.write((titles + body).encode("iso-8859-1"))
    for pre in (3, "auto"):
        d = Dialect(sep=";", encoding="latin-1", preamble=pre, multiline=True)
        rows = S.read_csv(spark, tmp_dir, d, source_column="source_file").collect()
        assert sorted((r.source_file.rsplit("/", 1)[1], r.D1C, r.D1N, r.V) for r in rows) == sorted(
            # the multi-line reader gives a quoted line break as "\n"
            [(f, "33", "Rio de\nJaneiro", "10") for f in ("a.csv", "b.csv")] + [(f, "35", "São Paulo", "20") for f in ("a.csv", "b.csv")]
        ), pre


def test_read_text_whole_files(spark, tmp_dir):
    for n in ("a", "b"):
        with open(f"{tmp_dir}/{n}.txt", "w") as fh:
            fh.write("line 1\nline 2\n")
    assert S.read_text(spark, tmp_dir).count() == 4
    assert S.read_text(spark, tmp_dir, whole=True).count() == 2


def _write(path, text):
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


@pytest.mark.parametrize("multiline", [False, True])
def test_headers_are_mapped_per_file(spark, tmp_dir, multiline):
    long_title = "Tabela 1 - População residente estimada, por unidade da federação e ano"
    _write(f"{tmp_dir}/a.csv", f"{long_title}\nid;v\n1;x\n")
    _write(f"{tmp_dir}/b.csv", f"{long_title}\nv;extra;id\ny;e;2\n")
    d = Dialect(sep=";", preamble=1, multiline=multiline)
    rows = sorted((r.id, r.v, r.extra) for r in S.read_csv(spark, tmp_dir, d).collect())
    assert rows == [("1", "x", None), ("2", "y", "e")]
    pinned = sorted((r.id, r.v) for r in S.read_csv(spark, tmp_dir, d, "id int, v string").collect())
    assert pinned == [(1, "x"), (2, "y")]


def test_files_without_a_header_row_are_marked_or_refused(spark, tmp_dir):
    _write(f"{tmp_dir}/a.csv", "id;v\n1;x\n")
    _write(f"{tmp_dir}/b.csv", "2;y\n3;z\n4;w\n")
    d = Dialect(sep=";", preamble="auto")
    rows = S.read_csv(spark, tmp_dir, d, "id int, v string", corrupt_column=True).collect()
    assert sorted((r.id, r.v, r._corrupt_record) for r in rows if r.id) == [(1, "x", None)]
    assert sorted(r._corrupt_record for r in rows if r.id is None) == ["2;y", "3;z", "4;w"]
    with pytest.raises(Exception, match="no header row found in .*b.csv"):
        S.read_csv(spark, tmp_dir, d, "id int, v string").collect()
    with pytest.raises(ValueError, match="no header row found in .*b.csv"):
        S.read_csv(spark, tmp_dir, Dialect(sep=";", preamble="auto", multiline=True), "id int, v string").collect()


def test_utf16_title_lines_are_refused_early(spark, tmp_dir):
    with open(f"{tmp_dir}/a.csv", "w", encoding="utf-16") as fh:
        fh.write("title\nid;v\n1;x\n")
    with pytest.raises(ValueError, match="multiline"):
        S.read_csv(spark, tmp_dir, Dialect(sep=";", encoding="utf-16", preamble=1))


def test_zip_members_with_titles_and_other_columns(spark, tmp_dir):
    import zipfile

    from strata.sources import archives as Z

    with zipfile.ZipFile(f"{tmp_dir}/t.zip", "w") as z:
        z.writestr("read me.txt", "not a table")
        z.writestr("a.csv", "T" * 80 + "\nid;v\n1;x\n")
        z.writestr("b.csv", "T" * 80 + "\n\nv;id\ny;2\n")
    rows = Z.read_zip_csv(spark, f"{tmp_dir}/t.zip", Dialect(sep=";", preamble="auto"), strategy="all_csvs").collect()
    assert sorted((r.id, r.v, r.source_file) for r in rows) == [("1", "x", "a.csv"), ("2", "y", "b.csv")]
