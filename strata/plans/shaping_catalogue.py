"""More driver keys: column shaping, profile measures, audits and reports.

Same rules as ``catalogue``: library operators over the given tables,
derived nulls and bad text built inside the query, and DuckDB SQL with
the same column names in ``ORACLE``. Keys whose output is a check table
or depends on file names are rows-only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.functions import columns as P
from strata.functions.scalars import basename, is_digits, keeps_leading_zeros, to_utc
from strata.operators import aggregates as A
from strata.operators import audits as Q
from strata.operators import report as R
from strata.operators import windows as W
from strata.operators.filters import mojibake
from strata.operators.joins import denormalise
from strata.operators.quality import REASON, VALUE, check_conservation, classify, split
from strata.plans.catalogue import lineitem_contract, table
from strata.session import scratch_dir
from strata.sinks import layout as K

Query = Callable[[SparkSession, str], DataFrame]


def _flagged_lineitem(spark: SparkSession, d: str) -> DataFrame:
    return classify(table(spark, d, "lineitem"), lineitem_contract(spark, d))


def _stored_lineitem(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Silver and quarantine of the line items, classified and written once;
    reports read what is stored."""
    return K.write_split(_flagged_lineitem(spark, d), scratch_dir(spark, "split"))


# --- column shaping -----------------------------------------------------------


def p2_rename_snake(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    r = P.rename_present(c, {"c_custkey": "Customer Key", "c_name": "Customer-Name", "not_there": "x"})
    return P.subset(P.snake_case(r), keep=["customer_key", "customer_name"])


def p5_strict_fill(spark: SparkSession, d: str) -> DataFrame:
    target = T.StructType(
        [T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_comment", T.StringType())]
    )
    filled, _missing = P.fill_missing(table(spark, d, "orders"), target)
    kept, _dropped = P.strict_select(filled, target)
    return kept


def p7_drift(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    even = F.col("o_orderkey") % 2 == 0
    drift = o.select(
        "o_orderkey",
        F.when(even, F.col("o_custkey").cast("string")).alias("CO_ESCOLA"),
        F.when(~even, F.col("o_custkey").cast("string")).alias("CO_ESCOLA_EDUCACENSO_2021"),
    )
    return P.coalesce_drift(drift, "school_id", r"CO_ESCOLA(_EDUCACENSO_\d{4})?")


def p11_drop_empty(spark: SparkSession, d: str) -> DataFrame:
    blank = F.col("doc_id") % 5 == 0
    docs = table(spark, d, "documents").select(
        F.when(blank, F.lit(None)).otherwise(F.col("lang")).alias("lang"),
        F.when(blank, F.lit("  ")).otherwise(F.col("source")).alias("source"),
    )
    return P.drop_empty(docs).agg(F.count(F.lit(1)).alias("n"))


def f9_mojibake(spark: SparkSession, d: str) -> DataFrame:
    # every seventh text and every third source were decoded as the wrong encoding
    docs = table(spark, d, "documents")
    bad = lambda c, k: F.when(F.col("doc_id") % k == 0, F.concat(F.col(c), F.lit("caf\u00c3\u00a9"))).otherwise(F.col(c)).alias(c)
    return mojibake(docs.select(bad("text", 7), bad("source", 3)), ["text", "source"])


def j6_cross_source(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_quantity")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    j = denormalise(li, o, "l_orderkey", ["o_orderstatus"], how="inner", ref_on="o_orderkey")
    return j.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


# --- profile measures ---------------------------------------------------------


def a4_average(spark: SparkSession, d: str) -> DataFrame:
    return A.average(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "average", digits=6)


def a8_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.counts(table(spark, d, "lineitem"), ["l_orderkey", "l_suppkey"])


def a11_distinct_exact(spark: SparkSession, d: str) -> DataFrame:
    return A.distinct_counts(table(spark, d, "customer"), ["c_nationkey", "c_mktsegment"], exact=True)


def a13_summary(spark: SparkSession, d: str) -> DataFrame:
    s = A.summary(table(spark, d, "lineitem"), ["l_quantity", "l_discount"])
    return s.withColumns({"mean": F.round("mean", 6), "stddev": F.round("stddev", 6)})


def a15_cast_failures(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.when(F.col("event_id") % 7 == 0, F.lit("x")).otherwise(F.col("value").cast("string")).alias("value"),
        "event_type",
    )
    schema = T.StructType([T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType()), T.StructField("event_type", T.StringType())])
    return A.cast_failures(ev, schema)


# --- windows and quality outputs -------------------------------------------------


def w5_top_reasons(spark: SparkSession, d: str) -> DataFrame:
    _, quarantined = split(_flagged_lineitem(spark, d))
    return W.top_reasons(quarantined, 10)


def w9_reconcile(spark: SparkSession, d: str) -> DataFrame:
    kept, quarantined = _stored_lineitem(spark, d)
    return W.reconcile(table(spark, d, "lineitem"), kept, quarantined)


def q10_values(spark: SparkSession, d: str) -> DataFrame:
    _, quarantined = split(_flagged_lineitem(spark, d))
    return quarantined.groupBy(F.col(REASON).alias("reason")).agg(
        F.count_distinct(F.col(VALUE)).alias("distinct_values"), F.count_if(F.col(VALUE).isNull()).alias("null_values")
    )


def q11_conservation(spark: SparkSession, d: str) -> DataFrame:
    return check_conservation(_flagged_lineitem(spark, d), source=table(spark, d, "lineitem"))


def q8_null_rates(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    j = denormalise(docs, table(spark, d, "labels"), "doc_id", ["quality", "toxic"])
    return Q.null_rates(j, key_columns=["doc_id"])


def q13_audit_bronze(spark: SparkSession, d: str) -> DataFrame:
    """Q13 over two stored tables: a good one, and one that is JSON, not
    partitioned, and lacks its source files."""
    li = table(spark, d, "lineitem")
    good, bad = scratch_dir(spark, "q13"), scratch_dir(spark, "q13bad")
    K.write_bronze(P.with_lineage(li, "batch-q13", "2024-01-01"), good)
    P.with_lineage(li, "batch-q13", "2024-01-01", F.lit(None).cast("string")).write.json(bad)
    rows = li.agg(F.count(F.lit(1)).alias("n")).first()["n"]  # type: ignore[index]
    first = Q.audit_bronze(spark.read.parquet(good), input_rows=rows, path=good)
    schema = spark.read.parquet(good).schema
    second = Q.audit_bronze(spark.read.schema(schema).json(bad), input_rows=rows, path=bad)
    tag = lambda c, name: c.withColumn("stored", F.lit(name))
    return tag(first, "good").unionByName(tag(second, "bad")).withColumn("observed", F.when(F.col("check") == "partitioned_by", "").otherwise(F.col("observed")))


def q18_audit_silver(spark: SparkSession, d: str) -> DataFrame:
    c = lineitem_contract(spark, d)
    c.required_columns = ["l_orderkey", "l_linenumber"]
    kept, _ = K.write_split(classify(table(spark, d, "lineitem"), c), scratch_dir(spark, "q18"))
    return Q.audit_silver(kept, c)


def q20_enforce(spark: SparkSession, d: str) -> DataFrame:
    """Q20: duplicates in the raw line items fail an abort check, by policy."""
    c = lineitem_contract(spark, d)
    checks = Q.audit_silver(table(spark, d, "lineitem"), c)
    try:
        Q.enforce(checks)
        outcome = "passed"
    except RuntimeError:
        outcome = "aborted"
    return checks.select("check", "status", "observed", F.lit(outcome).alias("outcome"))


# --- reports -----------------------------------------------------------------------


def r1_run_summary(spark: SparkSession, d: str) -> DataFrame:
    kept, quarantined = _stored_lineitem(spark, d)
    gold = A.aggregate(kept, ["l_returnflag", "l_linestatus"], [A.Measure("n", "count_all")])
    return R.run_summary(
        {
            "lineitem_raw": ("bronze", table(spark, d, "lineitem")),
            "lineitem_kept": ("silver", kept),
            "lineitem_quarantine": ("silver", quarantined),
            "by_flag_status": ("gold", gold),
        }
    )


def r2_failure_reasons(spark: SparkSession, d: str) -> DataFrame:
    _, quarantined = _stored_lineitem(spark, d)
    return R.failure_reasons(quarantined)


def r3_aggregate_catalog(spark: SparkSession, d: str) -> DataFrame:
    """An aggregate's catalogue row, whose sample query is then run."""
    from strata.plans.stages import LINE_GOLD

    agg = A.Aggregate(LINE_GOLD.name, LINE_GOLD.dims, [A.Measure("row_count", "count_all")], use_case=LINE_GOLD.use_case)
    row = R.aggregate_catalog(spark, [agg], "strata_r3_").first()
    agg.build(table(spark, d, "lineitem")).createOrReplaceTempView(f"strata_r3_{agg.name}")
    return spark.sql(row["sample_query"]).withColumn("grain", F.lit(row["grain"]))  # type: ignore[index]


def r4_batch_metadata(spark: SparkSession, d: str) -> DataFrame:
    b = P.with_lineage(table(spark, d, "orders"), "batch-r4", "2024-01-01")
    return R.batch_metadata(K.manifest_rows(b)).select("batch_id", "ingestion_date", "files", "rows")


def r5_profile(spark: SparkSession, d: str) -> DataFrame:
    return R.profile(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), exact=True)


def r6_audit_table(spark: SparkSession, d: str) -> DataFrame:
    """Bronze, Silver and Gold checks of one run in one table."""
    li = table(spark, d, "lineitem")
    kept, _ = _stored_lineitem(spark, d)
    gold = A.aggregate(kept, ["l_returnflag", "l_linestatus"], [A.Measure("n", "count_all")])
    return R.audit_table(
        Q.audit_bronze(P.with_lineage(li, "batch-r6", "2024-01-01")),
        Q.audit_silver(kept, lineitem_contract(spark, d)),
        Q.check_grain(gold, kept, ["l_returnflag", "l_linestatus"], "by_flag_status"),
    )


def _one_file_each(spark: SparkSession, df: DataFrame, path: str, column: str) -> None:
    """Write ``df`` as Parquet with one file per value of ``column``.

    The rows are first written by value, compressed well, by all tasks of the
    scan; a file is then written by one task, but that reads the rows of its
    value only, and none are sorted."""
    parts = scratch_dir(spark, "by-value")
    df.write.partitionBy(column).option("compression", "zstd").parquet(parts)
    reader = spark.read.schema(df.schema).option("basePath", parts)
    for folder in sorted(n for n in K.list_dir(spark, parts) if n.startswith(f"{column}=")):
        reader.parquet(f"{parts}/{folder}").coalesce(1).write.mode("append").partitionBy(column).parquet(path)
    if not K.path_exists(spark, path):
        df.limit(0).write.partitionBy(column).parquet(path)


def content_bytes(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of JSON lines and Parquet files, by reading what is in
    them: cut at line breaks, so many tasks read one file and no file is ever
    one value. Each cut is a byte; a JSON-lines file ends with one, a Parquet
    file with its magic number."""
    read = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n").text(root)
    own = read.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.sum(F.octet_length("value") + F.lit(1).cast("long")).alias("b"))
    return own.select("path", (F.col("b") - F.col("path").endswith(".parquet").cast("long")).alias("bytes"))


def r7_storage(spark: SparkSession, d: str) -> DataFrame:
    """Files and bytes per stored table, of two formats; bytes are those
    of the files' contents."""
    root = scratch_dir(spark, "r7")
    table(spark, d, "orders").coalesce(1).write.json(f"{root}/orders")
    _one_file_each(spark, table(spark, d, "lineitem"), f"{root}/lineitem", "l_returnflag")
    sized = R.storage(spark, {"orders": f"{root}/orders", "lineitem": f"{root}/lineitem"})
    read = content_bytes(spark, root)
    own = read.groupBy(F.when(F.col("path").contains("/orders/"), "orders").otherwise("lineitem").alias("t")).agg(F.sum("bytes").alias("b"))
    return sized.join(own, F.col("table") == F.col("t")).select("table", "files", (F.col("bytes") == F.col("b")).alias("sized"))


# --- scalar functions ------------------------------------------------------------------


def x10_digits(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    return p.groupBy(is_digits(basename("url")).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def x13_to_utc(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    text = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    return ev.select("event_id", to_utc(text).cast("timestamp_ntz").alias("ts"))


def x14_two_digit_year(spark: SparkSession, d: str) -> DataFrame:
    # every third year was cut to two digits
    y = F.year("o_orderdate")
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, y % 100).otherwise(y).alias("yr"))
    f = classify(o, Contract("orders", rules=[Rule.custom("yr", "yr BETWEEN 1900 AND 2100", "two-digit year suspected")]))
    return f.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(REASON).isNotNull()).alias("failing"),
        F.round(F.count_if(F.col(REASON).isNotNull()) / F.count(F.lit(1)), 6).alias("share"),
    )


def x17_leading_zeros(spark: SparkSession, d: str) -> DataFrame:
    # every fourth id went through a number and lost its zeros
    raw = F.col("c_custkey").cast("string")
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 4 == 0, raw).otherwise(F.lpad(raw, 8, "0")).alias("id"))
    return c.groupBy(keeps_leading_zeros("id", 8).alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def x7_batch_id(spark: SparkSession, d: str) -> DataFrame:
    """One batch id and one stamp per run, other ids for other runs."""
    from strata.functions.scalars import new_batch_id, run_timestamp

    o = table(spark, d, "orders")
    runs = [P.stamp(P.with_lineage(o, new_batch_id())).withColumns({"run": F.lit(k), "at": F.lit(run_timestamp())}) for k in (1, 2)]
    both = runs[0].unionByName(runs[1])
    return both.agg(
        F.count_distinct("batch_id").alias("ids"),
        F.count_if(F.length("batch_id") != 36).alias("malformed"),
        F.count_if(F.col("last_updated").isNull() | F.col("ingestion_date").isNull()).alias("unstamped"),
        (F.max(F.abs(F.datediff("at", F.current_date()))) <= 1).alias("today"),
    )


# --- sinks and scans ---------------------------------------------------------------------


def k4_write_gold(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    aggs = {
        "yearly": A.aggregate(o, [F.year("o_orderdate").alias("yr")], [A.Measure("customers", "count_distinct", "o_custkey"), A.Measure("n", "count_all")]),
        "by_status": A.aggregate(o, ["o_orderstatus"], [A.Measure("n", "count_all")]),
    }
    root = scratch_dir(spark, "gold")
    K.write_gold(aggs, root)
    paths = K.write_gold(aggs, root)  # a second run replaces the tables
    yearly = spark.read.parquet(paths["yearly"]).select(F.col("yr").cast("string").alias("key"), "customers", "n")
    status = spark.read.parquet(paths["by_status"]).select(F.col("o_orderstatus").alias("key"), F.lit(None).cast("bigint").alias("customers"), "n")
    return yearly.unionByName(status)


def k11_rebuild(spark: SparkSession, d: str) -> DataFrame:
    """A table rebuilt twice holds its last version only."""
    import uuid

    name = f"strata_k11_{uuid.uuid4().hex[:8]}"
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    K.rebuild_table(spark, name, o)
    return K.rebuild_table(spark, name, o.where(F.col("o_orderstatus") != "F"))


def w8_schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """A stored layer's schema against its source's."""
    from strata.sources.files import read_layer

    path = scratch_dir(spark, "w8")
    o = table(spark, d, "orders")
    o.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(1).alias("n")).write.parquet(path)
    diff = W.schema_diff(o.select("o_orderkey", "o_custkey", "o_orderstatus"), read_layer(spark, path), "source", "stored")
    rows = read_layer(spark, path).agg(F.count(F.lit(1)).alias("stored_rows")).select("stored_rows").scalar()
    return diff.withColumn("stored_rows", rows)


def s19_preview(spark: SparkSession, d: str) -> DataFrame:
    """The preview's rows, schema and row count."""
    from strata.sources.files import preview

    head, cols, n = preview(table(spark, d, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name"), 5)
    return head.withColumns({"columns": F.lit(",".join(c for c, _ in cols)), "rows": F.lit(n).cast("bigint")})


# Characters of the lines that one archive of s14_zip_csv takes.
ARCHIVE_CHARS = 32 << 20


def s14_zip_csv(spark: SparkSession, d: str) -> DataFrame:
    """Orders zipped by the executors, each archive of one status and
    of bounded size, with a readme and a CSV per half; all CSVs read back, by
    header. A task writes its own rows: no status is gathered anywhere."""
    import io
    import zipfile

    from strata.sinks.layout import path_exists
    from strata.sources import archives as Z
    from strata.sources.dialect import Dialect

    root = scratch_dir(spark, "zip")
    limit = ARCHIVE_CHARS
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    half = F.coalesce((F.col("o_orderkey") % 2).cast("string"), F.lit("")).alias("half")
    lines = o.select("o_orderstatus", half, F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), {"sep": ";"}).alias("line"))

    def pack(batches):  # noqa: ANN001, ANN202
        import pandas as pd
        import pyarrow.fs as pafs
        from pyspark import TaskContext

        fs, inner = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        task = TaskContext.get().partitionId()
        held: dict[str | None, dict[str, list[str]]] = {}
        size = made = 0

        def close():  # noqa: ANN202 - the names are those of a repeated attempt too
            nonlocal held, size, made
            paths = []
            for halves in held.values():
                packed = io.BytesIO()
                with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
                    z.writestr("readme.txt", "o_orderkey;not data\n")
                    for name, own in sorted(halves.items()):
                        z.writestr(f"part{name}.csv", "title line\no_orderkey;o_orderstatus;o_totalprice\n" + "\n".join(own) + "\n")
                paths.append(f"{inner}/orders_{task}_{made}.zip")
                made += 1
                fs.create_dir(inner, recursive=True)
                with fs.open_output_stream(paths[-1]) as f:
                    f.write(packed.getvalue())
            held, size = {}, 0
            return pd.DataFrame({"path": paths}, dtype=object)

        for pdf in batches:
            for status, name, line in zip(pdf["o_orderstatus"], pdf["half"], pdf["line"], strict=True):
                if size and size + len(line) > limit:
                    yield close()
                held.setdefault(status, {}).setdefault(name, []).append(line)
                size += len(line)
        if held:
            yield close()

    lines.mapInPandas(pack, "path string").write.format("noop").mode("overwrite").save()
    assert path_exists(spark, root)
    df = Z.read_zip_csv(spark, f"{root}/*.zip", Dialect(sep=";", preamble=1), strategy="all_csvs")
    return df.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_orderstatus", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.col("source_file").alias("member"))


# Orders of one archive of s15_member_choice, by their keys.
ARCHIVE_KEYS = 4096


def s15_member_choice(spark: SparkSession, d: str) -> DataFrame:
    """Which members each strategy chooses, and the lines they hold, in
    archives of a bounded range of order keys with a member per status."""
    import io
    import zipfile

    from strata.sources import archives as Z

    root = scratch_dir(spark, "s15")
    names = {"O": "a/orders_open.csv", "F": "a/orders done per capita.csv", "P": "b/orders_mixed.xlsx"}
    member = F.coalesce(*[F.when(F.col("o_orderstatus") == s, n) for s, n in names.items()], F.lit("b/others.csv"))
    block = F.coalesce(F.floor(F.col("o_orderkey") / ARCHIVE_KEYS), F.lit(-1))
    o = table(spark, d, "orders")
    lines = o.select(block.alias("block"), member.alias("member"), F.to_csv(F.struct(*o.columns)).alias("line"))

    def pack(pdf):  # noqa: ANN001, ANN202
        import pandas as pd
        import pyarrow.fs as pafs

        fs, inner = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("__MACOSX/a.csv", "x")
            z.writestr("readme.txt", "x")
            for name, own in sorted(pdf.groupby("member")):
                z.writestr(name, "\n".join(sorted(own["line"])) + "\n")
        fs.create_dir(inner, recursive=True)
        with fs.open_output_stream(f"{inner}/{pdf['block'].iloc[0]}.zip") as f:
            f.write(packed.getvalue())
        return pd.DataFrame({"path": [inner]})

    lines.groupBy("block").applyInPandas(pack, "path string").write.format("noop").mode("overwrite").save()
    members = Z.list_members(spark, f"{root}/*.zip").checkpoint()
    choices = {
        "first_csv": [], "all_csvs": [], "first_csv_or_xlsx": [], "essential": ["open"], "keyword_rank": ["mixed&orders", "per capita"],
    }
    chosen = [Z.pick_members(members, s, k).select(F.lit(s).alias("strategy"), *members.columns) for s, k in choices.items()]
    every = chosen[0].unionByName(chosen[1]).unionByName(chosen[2]).unionByName(chosen[3]).unionByName(chosen[4])
    read = Z.read_zip_lines(spark, f"{root}/*.zip", members).groupBy("archive", "member").agg(F.count(F.lit(1)).alias("lines"))
    block_of = F.regexp_extract("archive", r"(-?[0-9]+)\.zip$", 1).cast("long")
    return every.join(read, ["archive", "member"]).select("strategy", block_of.alias("block"), "member", "lines")


def q7_schema_match(spark: SparkSession, d: str) -> DataFrame:
    """An extra column goes, a missing one is filled, and one that
    is missing and required quarantines the rows."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_comment", T.StringType())])
    filled = classify(o, Contract("orders", schema=schema))
    needed = classify(o, Contract("orders", schema=schema, required_columns=["o_comment"]))
    shape = lambda f, name: f.groupBy(
        F.lit(name).alias("case"), F.lit(",".join(c for c in f.columns if not c.startswith("_dq_"))).alias("columns"), F.coalesce(F.col(REASON), F.lit("kept")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n"))
    return shape(filled, "filled").unionByName(shape(needed, "required"))


def d4_null_keys(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a null dedup key leave before duplicates are ranked."""
    li = table(spark, d, "lineitem").withColumn("l_linenumber", F.nullif(F.col("l_linenumber"), F.lit(7)))
    return classify(li, lineitem_contract(spark, d)).groupBy(F.coalesce(F.col(REASON), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def s7_parquet_pushdown(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources.files import read_parquet

    li = read_parquet(spark, f"{d.rstrip('/')}/lineitem.parquet")
    return li.filter(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).select("l_orderkey", "l_linenumber", "l_quantity")


QUERIES: dict[str, Query] = {
    "p2_rename_snake": p2_rename_snake,
    "p5_strict_fill": p5_strict_fill,
    "p7_drift": p7_drift,
    "p11_drop_empty": p11_drop_empty,
    "f9_mojibake": f9_mojibake,
    "j6_cross_source": j6_cross_source,
    "a4_average": a4_average,
    "a8_counts": a8_counts,
    "a11_distinct_exact": a11_distinct_exact,
    "a13_summary": a13_summary,
    "a15_cast_failures": a15_cast_failures,
    "w5_top_reasons": w5_top_reasons,
    "w9_reconcile": w9_reconcile,
    "q10_values": q10_values,
    "q11_conservation": q11_conservation,
    "q8_null_rates": q8_null_rates,
    "q13_audit_bronze": q13_audit_bronze,
    "q18_audit_silver": q18_audit_silver,
    "r1_run_summary": r1_run_summary,
    "r2_failure_reasons": r2_failure_reasons,
    "r4_batch_metadata": r4_batch_metadata,
    "r5_profile": r5_profile,
    "r6_audit_table": r6_audit_table,
    "r7_storage": r7_storage,
    "x10_digits": x10_digits,
    "x13_to_utc": x13_to_utc,
    "x14_two_digit_year": x14_two_digit_year,
    "x17_leading_zeros": x17_leading_zeros,
    "k4_write_gold": k4_write_gold,
    "s7_parquet_pushdown": s7_parquet_pushdown,
    "q20_enforce": q20_enforce,
    "r3_aggregate_catalog": r3_aggregate_catalog,
    "x7_batch_id": x7_batch_id,
    "k11_rebuild": k11_rebuild,
    "w8_schema_diff": w8_schema_diff,
    "s19_preview": s19_preview,
    "s14_zip_csv": s14_zip_csv,
    "s15_member_choice": s15_member_choice,
    "q7_schema_match": q7_schema_match,
    "d4_null_keys": d4_null_keys,
}

_Q9_REASON = (
    "(SELECT l.*, CASE WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' "
    "WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason, "
    "CASE WHEN rn>1 THEN CAST(l_orderkey AS VARCHAR)||'|'||CAST(l_linenumber AS VARCHAR) "
    "WHEN NOT l_quantity BETWEEN 5 AND 45 THEN CAST(l_quantity AS VARCHAR) WHEN hit IS NULL THEN CAST(l_suppkey AS VARCHAR) END AS value "
    "FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, "
    "s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey) l)"
)

ORACLE: dict[str, str] = {
    "p2_rename_snake": "SELECT c_custkey AS customer_key, c_name AS customer_name FROM customer",
    "p5_strict_fill": "SELECT o_orderkey, o_totalprice, CAST(NULL AS VARCHAR) AS o_comment FROM orders",
    "p7_drift": "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS school_id FROM orders",
    "p11_drop_empty": "SELECT count(*) AS n FROM documents WHERE doc_id%5<>0 AND NOT ((lang IS NULL OR trim(lang)='') AND (source IS NULL OR trim(source)=''))",
    "f9_mojibake": "SELECT 'text' AS column, count(*) FILTER (WHERE doc_id%7=0) AS suspect FROM documents UNION ALL SELECT 'source', count(*) FILTER (WHERE doc_id%3=0) FROM documents",
    "j6_cross_source": "SELECT o_orderstatus, count(*) AS n, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1",
    "a4_average": "SELECT l_returnflag, round(avg(l_discount),6) AS average FROM lineitem GROUP BY 1",
    "a8_counts": "SELECT count(*) AS rows, count(DISTINCT l_orderkey) AS distinct_l_orderkey, count(DISTINCT l_suppkey) AS distinct_l_suppkey FROM lineitem",
    "a11_distinct_exact": "SELECT count(DISTINCT c_nationkey) AS distinct_c_nationkey, count(DISTINCT c_mktsegment) AS distinct_c_mktsegment FROM customer",
    "a13_summary": "SELECT 'l_quantity' AS column, count(l_quantity) AS count, count(*) FILTER (WHERE l_quantity IS NULL) AS nulls, min(l_quantity) AS min, max(l_quantity) AS max, round(avg(l_quantity),6) AS mean, round(stddev_samp(l_quantity),6) AS stddev FROM lineitem UNION ALL SELECT 'l_discount', count(l_discount), count(*) FILTER (WHERE l_discount IS NULL), min(l_discount), max(l_discount), round(avg(l_discount),6), round(stddev_samp(l_discount),6) FROM lineitem",
    "a15_cast_failures": "SELECT 'user_id' AS column, count(*) FILTER (WHERE TRY_CAST(CAST(user_id AS VARCHAR) AS BIGINT) IS NULL) AS failures FROM events UNION ALL SELECT 'value', count(*) FILTER (WHERE event_id%7=0) FROM events",
    "w5_top_reasons": f"SELECT reason, count(*) AS count FROM {_Q9_REASON} WHERE reason<>'kept' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "w9_reconcile": f"SELECT count(*) AS source_rows, count(*) FILTER (WHERE reason='kept') AS kept_rows, count(*) FILTER (WHERE reason<>'kept') AS quarantined_rows, true AS ok FROM {_Q9_REASON}",
    "q10_values": f"SELECT reason, count(DISTINCT value) AS distinct_values, count(*) FILTER (WHERE value IS NULL) AS null_values FROM {_Q9_REASON} WHERE reason<>'kept' GROUP BY 1",
    "q11_conservation": f"SELECT count(*) FILTER (WHERE reason='kept') AS kept, count(*) FILTER (WHERE reason<>'kept') AS quarantined, count(*) AS total, count(*) AS input_rows, true AS ok FROM {_Q9_REASON}",
    "q8_null_rates": "WITH j AS (SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id), s AS (SELECT 'doc_id' AS col, count(*) AS rows, count(*) FILTER (WHERE doc_id IS NULL) AS nulls, CAST(0.0 AS DOUBLE) AS lim FROM j UNION ALL SELECT 'lang', count(*), count(*) FILTER (WHERE lang IS NULL), CAST(0.02 AS DOUBLE) FROM j UNION ALL SELECT 'quality', count(*), count(*) FILTER (WHERE quality IS NULL), CAST(0.02 AS DOUBLE) FROM j UNION ALL SELECT 'toxic', count(*), count(*) FILTER (WHERE toxic IS NULL), CAST(0.02 AS DOUBLE) FROM j) SELECT col AS \"column\", rows, nulls, CASE WHEN rows>0 THEN nulls/rows ELSE 0.0 END AS null_rate, lim AS \"limit\", (CASE WHEN rows>0 THEN nulls/rows ELSE 0.0 END)<=lim AS ok FROM s",
    "q13_audit_bronze": "WITH n AS (SELECT CAST(count(*) AS VARCHAR) AS c FROM lineitem), t(stored) AS (VALUES ('good'),('bad')) SELECT 'bronze' AS stage,'non_empty' AS \"check\",'pass' AS status,c AS observed,'> 0' AS expected,'abort' AS on_fail,stored FROM n,t UNION ALL SELECT 'bronze','lineage_ingestion_date','pass','0','0','abort',stored FROM t UNION ALL SELECT 'bronze','lineage_batch_id','pass','0','0','abort',stored FROM t UNION ALL SELECT 'bronze','lineage_source_file',CASE stored WHEN 'good' THEN 'pass' ELSE 'fail' END,CASE stored WHEN 'good' THEN '0' ELSE c END,'0','abort',stored FROM n,t UNION ALL SELECT 'bronze','rows_in_equals_rows_out','pass',c,c,'abort',stored FROM n,t UNION ALL SELECT 'bronze','partitioned_by',CASE stored WHEN 'good' THEN 'pass' ELSE 'fail' END,'','ingestion_date','abort',stored FROM t UNION ALL SELECT 'bronze','storage_format',CASE stored WHEN 'good' THEN 'pass' ELSE 'fail' END,CASE stored WHEN 'good' THEN 'parquet' ELSE 'json' END,'parquet','abort',stored FROM t",
    "q18_audit_silver": f"WITH k AS (SELECT * FROM {_Q9_REASON} WHERE reason='kept'), n AS (SELECT count(*) FILTER (WHERE l_orderkey IS NULL) AS n1, count(*) FILTER (WHERE l_linenumber IS NULL) AS n2 FROM k), dup AS (SELECT count(*) AS n3 FROM (SELECT l_orderkey,l_linenumber FROM k GROUP BY 1,2 HAVING count(*)>1)) SELECT 'silver' AS stage,'required_not_null:l_orderkey' AS \"check\",CASE WHEN n1=0 THEN 'pass' ELSE 'fail' END AS status,CAST(n1 AS VARCHAR) AS observed,'0' AS expected,'abort' AS on_fail FROM n UNION ALL SELECT 'silver','required_not_null:l_linenumber',CASE WHEN n2=0 THEN 'pass' ELSE 'fail' END,CAST(n2 AS VARCHAR),'0','abort' FROM n UNION ALL SELECT 'silver','dedup_applied',CASE WHEN n3=0 THEN 'pass' ELSE 'fail' END,CAST(n3 AS VARCHAR),'0','abort' FROM dup",
    "r1_run_summary": f"SELECT 'bronze' AS stage, 'lineitem_raw' AS output, count(*) AS rows FROM lineitem UNION ALL SELECT 'silver','lineitem_kept', count(*) FILTER (WHERE reason='kept') FROM {_Q9_REASON} UNION ALL SELECT 'silver','lineitem_quarantine', count(*) FILTER (WHERE reason<>'kept') FROM {_Q9_REASON} UNION ALL SELECT 'gold','by_flag_status', count(DISTINCT (l_returnflag,l_linestatus)) FROM {_Q9_REASON} WHERE reason='kept'",
    "r2_failure_reasons": f"SELECT reason, count(*) AS rows, round(100.0*count(*)/sum(count(*)) OVER (),2) AS pct FROM {_Q9_REASON} WHERE reason<>'kept' GROUP BY 1",
    "r4_batch_metadata": "SELECT 'batch-r4' AS batch_id, DATE '2024-01-01' AS ingestion_date, CAST(1 AS BIGINT) AS files, count(*) AS rows FROM orders",
    "x10_digits": "SELECT regexp_full_match(split_part(url,'/',-1),'[0-9]+') AS digits, count(*) AS n FROM pages GROUP BY 1",
    "x13_to_utc": "SELECT event_id, ts FROM events",
    "x14_two_digit_year": "SELECT count(*) AS n, count(*) FILTER (WHERE o_orderkey%3=0) AS failing, round(count(*) FILTER (WHERE o_orderkey%3=0)/count(*),6) AS share FROM orders",
    "x17_leading_zeros": "SELECT NOT (c_custkey%4=0 AND length(CAST(c_custkey AS VARCHAR))<8) AS ok, count(*) AS n FROM customer GROUP BY 1",
    "k4_write_gold": "SELECT CAST(year(o_orderdate) AS VARCHAR) AS key, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, NULL, count(*) FROM orders GROUP BY 1",
    "s7_parquet_pushdown": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01'",
    "q20_enforce": "WITH x AS (SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey,l_linenumber HAVING count(*)>1)) SELECT 'dedup_applied' AS \"check\", CASE WHEN n=0 THEN 'pass' ELSE 'fail' END AS status, CAST(n AS VARCHAR) AS observed, CASE WHEN n=0 THEN 'passed' ELSE 'aborted' END AS outcome FROM x",
    "r3_aggregate_catalog": "SELECT l_returnflag,l_linestatus,count(*) AS row_count,'l_returnflag, l_linestatus' AS grain FROM lineitem GROUP BY 1,2",
    "r5_profile": "SELECT 'o_orderkey' AS column,'bigint' AS type,count(*) AS rows,count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls,count(DISTINCT o_orderkey) AS distinct,CAST(min(o_orderkey) AS VARCHAR) AS min,CAST(max(o_orderkey) AS VARCHAR) AS max FROM orders UNION ALL SELECT 'o_custkey','bigint',count(*),count(*) FILTER (WHERE o_custkey IS NULL),count(DISTINCT o_custkey),CAST(min(o_custkey) AS VARCHAR),CAST(max(o_custkey) AS VARCHAR) FROM orders UNION ALL SELECT 'o_orderstatus','string',count(*),count(*) FILTER (WHERE o_orderstatus IS NULL),count(DISTINCT o_orderstatus),min(o_orderstatus),max(o_orderstatus) FROM orders",
    "r6_audit_table": f"WITH k AS (SELECT * FROM {_Q9_REASON} WHERE reason='kept'), n AS (SELECT CAST(count(*) AS VARCHAR) AS c FROM lineitem), g AS (SELECT CAST(count(DISTINCT (l_returnflag,l_linestatus)) AS VARCHAR) AS c FROM k) SELECT 'bronze' AS stage,'non_empty' AS \"check\",'pass' AS status,c AS observed,'> 0' AS expected,'abort' AS on_fail FROM n UNION ALL SELECT 'bronze','lineage_'||x,'pass','0','0','abort' FROM (VALUES ('ingestion_date'),('source_file'),('batch_id')) v(x) UNION ALL SELECT 'silver','dedup_applied','pass','0','0','abort' UNION ALL SELECT 'gold','by_flag_status:grain','pass',c,c,'abort' FROM g UNION ALL SELECT 'gold','by_flag_status:null_dimensions','pass','0','0','abort'",
    "r7_storage": "SELECT 'orders' AS table, CAST(1 AS BIGINT) AS files, true AS sized UNION ALL SELECT 'lineitem', count(DISTINCT l_returnflag), true FROM lineitem",
    "x7_batch_id": "SELECT CAST(2 AS BIGINT) AS ids, CAST(0 AS BIGINT) AS malformed, CAST(0 AS BIGINT) AS unstamped, count(*)>0 AS today FROM orders",
    "k11_rebuild": "SELECT o_orderkey,o_orderstatus FROM orders WHERE o_orderstatus<>'F'",
    "w8_schema_diff": "SELECT c AS column,a AS source_type,b AS stored_type,s AS status,(SELECT count(*) FROM orders) AS stored_rows FROM (VALUES ('o_custkey','bigint','string','type_changed'),('o_orderstatus','string',NULL,'only_source'),('n',NULL,'int','only_stored')) v(c,a,b,s)",
    "s19_preview": "SELECT n_nationkey,n_name,'n_nationkey,n_name' AS columns,(SELECT count(*) FROM nation) AS rows FROM nation ORDER BY n_nationkey LIMIT 5",
    "s15_member_choice": """
WITH m AS (
  SELECT CAST(coalesce(floor(o_orderkey / 4096), -1) AS BIGINT) AS block,
    CASE o_orderstatus WHEN 'O' THEN 'a/orders_open.csv' WHEN 'F' THEN 'a/orders done per capita.csv'
      WHEN 'P' THEN 'b/orders_mixed.xlsx' ELSE 'b/others.csv' END AS member, count(*) AS lines
  FROM orders GROUP BY 1, 2),
r AS (
  SELECT *, member LIKE '%.csv' AS csv, row_number() OVER (PARTITION BY block ORDER BY member) AS pos,
    row_number() OVER (PARTITION BY block, member LIKE '%.csv' ORDER BY member) AS kind_pos,
    max(CASE WHEN member LIKE '%open.csv' THEN 1 ELSE 0 END) OVER (PARTITION BY block) AS has_open,
    row_number() OVER (PARTITION BY block ORDER BY CASE WHEN member LIKE '%mixed%' THEN 0 WHEN member LIKE '%per capita%' THEN 1 ELSE 2 END, member) AS best
  FROM m)
SELECT 'first_csv' AS strategy, block, member, lines FROM r WHERE csv AND kind_pos = 1
UNION ALL SELECT 'all_csvs', block, member, lines FROM r WHERE csv
UNION ALL SELECT 'first_csv_or_xlsx', block, member, lines FROM r WHERE pos = 1
UNION ALL SELECT 'essential', block, member, lines FROM r WHERE csv AND CASE WHEN has_open = 1 THEN member LIKE '%open%' ELSE kind_pos <= 3 END
UNION ALL SELECT 'keyword_rank', block, member, lines FROM r WHERE best = 1 AND (member LIKE '%mixed%' OR member LIKE '%per capita%')
""",
    "s14_zip_csv": "SELECT o_orderkey,o_orderstatus,o_totalprice,'part'||(o_orderkey%2)||'.csv' AS member FROM orders",
    "q7_schema_match": "SELECT 'filled' AS case,'o_orderkey,o_totalprice,o_comment' AS columns,'kept' AS reason,count(*) AS n FROM orders UNION ALL SELECT 'required','o_orderkey,o_totalprice,o_comment','required_column_null:o_comment',count(*) FROM orders",
    "d4_null_keys": "SELECT CASE WHEN ln IS NULL THEN 'required_column_null:l_linenumber' WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason, count(*) AS n FROM (SELECT l.*, nullif(l_linenumber,7) AS ln, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey) GROUP BY 1",
}
