"""Driver keys for sources, sinks and streams.

Each key writes files *derived from the given tables by Spark* into a
fresh folder under the session's shared checkpoint directory, reads them
back through the library, and returns the result. Where a round trip
must reproduce a table, ``FILE_ORACLE`` holds the SQL over the original
table, so these keys get a value check too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import with_lineage
from strata.operators.filters import from_file, of_batch
from strata.operators.quality import REASON, classify, outcome_counts
from strata.plans.catalogue import lineitem_contract, table
from strata.session import scratch_dir
from strata.sinks import layout as K
from strata.sources import files as S
from strata.sources.dialect import SEMICOLON_LATIN1, Dialect
from strata.sources.payload import explode_payload, records_as_columns
from strata.sources.walk import walk_files
from strata.streaming.files import silver_outputs, stream_bronze, stream_silver

Query = Callable[[SparkSession, str], DataFrame]

CUSTOMER_SCHEMA = T.StructType(
    [
        T.StructField("c_custkey", T.LongType()),
        T.StructField("c_name", T.StringType()),
        T.StructField("c_nationkey", T.IntegerType()),
        T.StructField("c_acctbal", T.DoubleType()),
        T.StructField("c_mktsegment", T.StringType()),
    ]
)
ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()),
        T.StructField("o_custkey", T.LongType()),
        T.StructField("o_orderstatus", T.StringType()),
        T.StructField("o_totalprice", T.DoubleType()),
        T.StructField("o_orderdate", T.DateType()),
        T.StructField("o_orderpriority", T.StringType()),
    ]
)
LINE_SCHEMA = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)

# Title lines placed above the header in the preamble fixtures
# (a long title, a blank line, a year), as statistical agencies publish.
TITLE_LINES = [
    "Tabela 1 - População residente estimada, por unidade da federação e ano de referência",
    "",
    "2024",
]


def _orders_for_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").alias("o_orderdate"), "o_orderpriority"
    )


def dealt(df: DataFrame, files: int = 4) -> DataFrame:
    """``df`` (a scan) in ``files`` partitions at least: a small table is dealt
    anew, a larger one keeps its scan's splits, so that with the table the
    files written become more, not larger."""
    return df if df.rdd.getNumPartitions() >= files else df.repartition(files)


def write_with_titles(df: DataFrame, path: str, dialect: Dialect, titles: list[str], files: int = 4) -> None:
    """Write ``df`` as delimited text, ``files`` files or more (see ``dealt``),
    each starting with ``titles`` and a header."""
    header = dialect.sep.join(df.columns)
    opts = {"sep": dialect.sep, "quote": dialect.quote, "escape": dialect.escape}
    lines = dealt(df, files).select(F.to_csv(F.struct(*df.columns), opts).alias("value"))
    block = list(titles) + [header]

    def prepend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        started = False
        for pdf in batches:
            if not started:
                yield pd.DataFrame({"value": block})
                started = True
            yield pdf

    lines.mapInPandas(prepend, "value string").write.mode("overwrite").text(path)


# --- sources ------------------------------------------------------------------


def s1_csv_latin1_semicolon(spark: SparkSession, d: str) -> DataFrame:
    """S1 S2 S10 K13: ';' + Latin-1 round trip with the schema pinned."""
    path = scratch_dir(spark, "s1")
    K.write_csv(table(spark, d, "customer").select(*CUSTOMER_SCHEMA.fieldNames()), path, SEMICOLON_LATIN1)
    return S.read_csv(spark, path, Dialect(sep=";", encoding="latin-1"), CUSTOMER_SCHEMA)


def s3_preamble_skip(spark: SparkSession, d: str) -> DataFrame:
    """S3: three title lines above the header in every file."""
    path = scratch_dir(spark, "s3")
    write_with_titles(_orders_for_text(spark, d), path, Dialect(sep=";"), TITLE_LINES)
    return S.read_csv(spark, path, Dialect(sep=";", preamble=3), ORDER_SCHEMA)


def s4_header_detect(spark: SparkSession, d: str) -> DataFrame:
    """Header row found per file by the header rule."""
    path = scratch_dir(spark, "s4")
    write_with_titles(_orders_for_text(spark, d), path, Dialect(sep="|"), TITLE_LINES)
    return S.read_csv(spark, path, Dialect(sep="|", preamble="auto"), ORDER_SCHEMA)


def s3_multiline_preamble(spark: SparkSession, d: str) -> DataFrame:
    """Title lines above the header in files whose quoted fields hold
    line breaks and quotes (whole document texts)."""
    path = scratch_dir(spark, "s3m")
    docs = table(spark, d, "documents").select("doc_id", "lang", "text")
    write_with_titles(docs, path, Dialect(sep=";"), TITLE_LINES)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("text", T.StringType())])
    return S.read_csv(spark, path, Dialect(sep=";", preamble=3, multiline=True), schema)


def s5_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines round trip."""
    path = scratch_dir(spark, "s5")
    ev = table(spark, d, "events")
    fmt = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    ev.write.mode("overwrite").options(**fmt).json(path)
    return S.read_json(spark, path, ev.schema, options=fmt)


def s6_payload_unwrap(spark: SparkSession, d: str) -> DataFrame:
    """Payload documents of four shapes (root array, data list, results
    list behind a non-list data key, single object) unwrapped to rows."""
    c = table(spark, d, "customer")
    rec = F.to_json(F.struct("c_custkey", "c_name", "c_acctbal"))
    k = F.col("c_custkey") % 4
    doc = (
        F.when(k == 0, F.concat(F.lit("["), rec, F.lit("]")))
        .when(k == 1, F.concat(F.lit('{"data":['), rec, F.lit('],"meta":{"source":"derived"}}')))
        .when(k == 2, F.concat(F.lit('{"data":5,"results":['), rec, F.lit("]}")))
        .otherwise(rec)
    )
    path = scratch_dir(spark, "s6")
    c.select(doc.alias("value")).write.mode("overwrite").text(path)
    docs = S.read_text(spark, path)
    rows = explode_payload(docs, "value")
    return records_as_columns(rows, "record", "c_custkey long, c_name string, c_acctbal double").drop("_payload_error")


def _csv_by_day(spark: SparkSession, d: str, key: str) -> tuple[str, DataFrame]:
    """Orders as one CSV file in each of two folders: equal base names
    under different paths."""
    path = scratch_dir(spark, key)
    for part in ("a", "b"):
        own = F.col("o_orderkey") % 2 == (0 if part == "a" else 1)
        K.write_csv(_orders_for_text(spark, d).where(own).coalesce(1), f"{path}/{part}", Dialect())
        name = next(n for n in K.list_dir(spark, f"{path}/{part}") if n.endswith(".csv"))
        K.rename_path(spark, f"{path}/{part}/{name}", f"{path}/{part}/data.csv")
    return path, S.list_files(spark, f"{path}/*/data.csv")


def s9_dir_source_file(spark: SparkSession, d: str) -> DataFrame:
    """A glob over files of one base name; every row knows its folder."""
    path, _ = _csv_by_day(spark, d, "s9")
    df = S.read_dir(spark, f"{path}/*/data.csv", "csv", Dialect(), ORDER_SCHEMA)
    b = with_lineage(df, "b-s9", "2024-01-01")
    return b.select("o_orderkey", F.regexp_extract("source_file", "([^/]+/[^/]+)$", 1).alias("source"))


def s13_binary_listing(spark: SparkSession, d: str) -> DataFrame:
    """Listed files with their sizes, which must be their bytes' number."""
    path, listing = _csv_by_day(spark, d, "s13")
    read = S.read_binary(spark, f"{path}/*/data.csv").select(F.col("path").alias("p"), F.length("content").alias("n"))
    lines = S.read_text(spark, f"{path}/*/data.csv", source_column="f").groupBy("f").agg((F.count(F.lit(1)) - 1).alias("rows"))
    both = listing.join(read, F.col("path") == F.col("p")).join(lines, F.col("source_path") == F.col("f"))
    return both.select(F.element_at(F.split("path", "/"), -2).alias("folder"), "name", (F.col("length") == F.col("n")).alias("sized"), "rows")


def s17_new_files(spark: SparkSession, d: str) -> DataFrame:
    """After folder a is ingested, only folder b's file of the same
    name is new; after both, none is."""
    path, listing = _csv_by_day(spark, d, "s17")
    rows = with_lineage(S.read_dir(spark, f"{path}/*/data.csv", "csv", Dialect(), ORDER_SCHEMA), "b-s17", "2024-01-01")
    some = listing.where(F.col("path").contains("/a/"))
    seen = K.manifest_rows(rows.where(F.col("source_file").contains("/a/")), some, "b-s17", "2024-01-01")
    every = K.manifest_rows(rows, listing, "b-s17", "2024-01-01")
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    first = S.new_files(listing, seen).select(F.lit("after a").alias("state"), folder, "name")
    return first.unionByName(S.new_files(listing, every).select(F.lit("after both").alias("state"), folder, "name"))


def s16_walk_new_files(spark: SparkSession, d: str) -> DataFrame:
    """A file per order month and priority, in folders listed by
    tasks; the files of two priorities are recorded, the others are new.
    Rows find their file in the listing by their lineage path."""
    path, known = scratch_dir(spark, "s16w"), scratch_dir(spark, "s16m")
    o = table(spark, d, "orders").withColumns(
        {"month": F.date_format("o_orderdate", "yyyy-MM"), "level": F.substring("o_orderpriority", 1, 1)}
    )
    o.repartition("month", "level").write.partitionBy("month", "level").csv(path)
    walked = walk_files(spark, path)
    seen = walked.where(F.col("path").rlike("/level=[12]/")).select(*[F.col(a).alias(b) for a, b in zip(S.LISTED, S.RECORDED)])
    seen.write.parquet(known)
    new = S.new_files(walked, spark.read.parquet(known)).select("source_path", F.lit(1).alias("new"))
    rows = S.read_text(spark, path, source_column="f").groupBy("f").agg(F.count(F.lit(1)).alias("n"))
    files = walked.join(new, "source_path", "left").join(rows, F.col("source_path") == F.col("f"), "left")
    return files.groupBy(F.regexp_extract("path", "/month=([^/]+)/", 1).alias("month")).agg(
        F.count(F.lit(1)).alias("files"), F.count("new").alias("new_files"), F.sum("n").alias("rows")
    )


def s3_headers_per_file(spark: SparkSession, d: str) -> DataFrame:
    """Files with their columns in another order and one more column
    are mapped by their own header; a file without a header row keeps its
    lines, marked corrupt."""
    path = scratch_dir(spark, "s3h")
    o = _orders_for_text(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice")
    part = F.col("o_orderkey") % 3
    dialect = Dialect(sep=";")
    write_with_titles(o.where(part == 0), f"{path}/a", dialect, TITLE_LINES, files=2)
    write_with_titles(o.where(part == 1).select("o_totalprice", F.lit("x").alias("note"), "o_orderkey", "o_orderstatus"), f"{path}/b", dialect, TITLE_LINES, files=2)
    # no line of these qualifies as a header: every first cell is a number
    o.where(part == 2).select(F.to_csv(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), {"sep": ";"}).alias("value")).write.text(f"{path}/c")
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType()), T.StructField("o_totalprice", T.DoubleType())])
    out = S.read_csv(spark, f"{path}/*", Dialect(sep=";", preamble="auto"), schema, corrupt_column=True)
    key = F.coalesce(F.col("o_orderkey"), F.split(S.CORRUPT, ";").getItem(0).cast("long"))
    return out.select(key.alias("o_orderkey"), "o_orderstatus", "o_totalprice", F.col(S.CORRUPT).isNotNull().alias("corrupt"))


def s20_corrupt_capture(spark: SparkSession, d: str) -> DataFrame:
    """Malformed values survive Bronze in ``_corrupt_record``."""
    path = scratch_dir(spark, "s20")
    o = _orders_for_text(spark, d)
    price = F.when(F.col("o_orderkey") % 10 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    K.write_csv(o.withColumn("o_totalprice", price), path, Dialect())
    df = S.read_csv(spark, path, Dialect(), ORDER_SCHEMA, corrupt_column=True)
    return df.select("o_orderkey", "o_totalprice", F.col(S.CORRUPT).isNotNull().alias("corrupt"))


# --- sinks ----------------------------------------------------------------------


def k1_bronze_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Bronze append partitioned by date, verified in one aggregate."""
    path = scratch_dir(spark, "k1")
    b = with_lineage(table(spark, d, "lineitem"), "batch-k1", "2024-01-01")
    K.write_bronze(b, path)
    v = K.verify_write(spark, path, "batch-k1")
    of = of_batch(spark.read.parquet(path), "batch-k1").agg(F.count(F.lit(1)).alias("of_batch_rows"))
    return v.select("*", of.scalar().alias("of_batch_rows"))


def q9_bucketed_bronze(spark: SparkSession, d: str) -> DataFrame:
    """K1 + Q9: Bronze stored bucketed by the dedup keys; Silver's keep-first
    window then reads the buckets with no shuffle of the full rows."""
    import uuid

    path = scratch_dir(spark, "bucketed")
    b = with_lineage(table(spark, d, "lineitem"), "b-bkt", "2024-01-01", "lineitem.csv")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    t = K.write_bronze_bucketed(b, f"strata_bronze_{uuid.uuid4().hex[:8]}", path, ["l_orderkey", "l_linenumber"], n)
    return outcome_counts(classify(t, lineitem_contract(spark, d), clustered=True))


def k2_silver_split(spark: SparkSession, d: str) -> DataFrame:
    """Q9 K2 K3: flagged frame written once by outcome, both parts read back."""
    root = scratch_dir(spark, "k2")
    flagged = classify(table(spark, d, "lineitem"), lineitem_contract(spark, d))
    kept, quarantined = K.write_split(flagged, root)
    qpath = scratch_dir(spark, "k2q")
    K.append_quarantine(quarantined, qpath)
    spath = scratch_dir(spark, "k2s")
    K.write_silver(kept, spath)
    stored_q = spark.read.parquet(qpath).drop("_dq_check_date", "_dq_run")
    stored_k = spark.read.parquet(spath)
    return outcome_counts(stored_q.unionByName(stored_k.withColumns({REASON: F.lit(None).cast("string")}), allowMissingColumns=True))


def k8_zorder(spark: SparkSession, d: str) -> DataFrame:
    """K8: a Z-ordered rewrite keeps every row, and its files are narrower in
    both columns than the whole (a plain copy's are not)."""
    path = scratch_dir(spark, "k8")
    o = table(spark, d, "orders")
    K.zorder_write(o, path, ["o_custkey", "o_totalprice"], files=16)
    out = spark.read.parquet(path)
    for c in ("o_custkey", "o_totalprice"):
        whole = o.select((F.max(c) - F.min(c)).alias("w")).scalar()
        mean = K.file_spans(spark, path, c).select(F.avg(F.col("hi") - F.col("lo")).alias("m")).scalar()
        out = out.withColumn(f"narrow_{c}", mean < whole * 0.8)
    return out


def k8_hilbert_text(spark: SparkSession, d: str) -> DataFrame:
    """K8: customers clustered by a text and a number along the Hilbert curve;
    files are narrow in both, and together no wider than in Z-order."""
    c = table(spark, d, "customer")  # names sort as keys do
    whole = c.select(F.max("c_custkey") - F.min("c_custkey"), F.max("c_acctbal") - F.min("c_acctbal")).first()
    spans = {}
    for curve in ("hilbert", "z"):
        path = scratch_dir(spark, f"k8{curve}")
        K.zorder_write(c, path, ["c_name", "c_acctbal"], files=16, curve=curve)
        for k, column in enumerate(("c_custkey", "c_acctbal")):
            spans[curve, column] = K.file_spans(spark, path, column).select(F.avg(F.col("hi") - F.col("lo"))).scalar() / whole[k]
        spans[curve] = path
    out = spark.read.parquet(spans["hilbert"])
    for column in ("c_custkey", "c_acctbal"):
        out = out.withColumn(f"narrow_{column}", spans["hilbert", column] < 0.6)
    total = {curve: spans[curve, "c_custkey"] + spans[curve, "c_acctbal"] for curve in ("hilbert", "z")}
    return out.withColumn("narrower_than_z", F.lit(total["hilbert"]) <= F.lit(total["z"]) * 1.02)


def k9_compact(spark: SparkSession, d: str) -> DataFrame:
    """K9 K4: many small files compacted; rows and partitions are kept, and
    one file per partition value is left."""
    path = scratch_dir(spark, "k9")
    table(spark, d, "orders").repartition(8).write.partitionBy("o_orderstatus").parquet(path)
    before = len(spark.read.parquet(path).inputFiles())
    after = K.compact(spark, path, target_mb=64)
    parts = ",".join(K.partition_columns(spark, path))
    out = spark.read.parquet(path)
    per = out.select(F.count_distinct("o_orderstatus").alias("n")).scalar()
    return out.withColumns({"fewer": F.lit(after < before), "per_value": F.lit(after) == per, "parts": F.lit(parts)})


def f7_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Lineage lookup of the rows that came from one of two files of
    the same base name."""
    path, listing = _csv_by_day(spark, d, "f7")
    df = with_lineage(S.read_dir(spark, f"{path}/*/data.csv", "csv", Dialect(), ORDER_SCHEMA), "b-f7", "2024-01-01")
    one = listing.where(F.col("path").contains("/b/")).select("source_path").first()
    return from_file(df, one["source_path"]).select("o_orderkey", "o_totalprice")  # type: ignore[index]


def w6_head(spark: SparkSession, d: str) -> DataFrame:
    """Preview rows (ordered first, so the 20 rows are fixed)."""
    from strata.operators.windows import head

    return head(table(spark, d, "orders").orderBy("o_orderkey").select("o_orderkey", "o_orderstatus"), 20)


def w1_incremental_first(spark: SparkSession, d: str) -> DataFrame:
    """Line items merged batch by batch into the stored first rows;
    later batches demote former winners. All rows with their final outcome."""
    import uuid

    from strata.operators.incremental import merge_first, winners

    li = table(spark, d, "lineitem")
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]
    name, path, lost = f"strata_first_{uuid.uuid4().hex[:8]}", scratch_dir(spark, "w1w"), scratch_dir(spark, "w1q")
    for b in range(3):
        part = li.where(F.coalesce(F.pmod("l_partkey", F.lit(3)), F.lit(0)) == b)
        merge_first(part, f"b{b}", name, path, lost, keys, order, scratch_dir(spark, "w1s"))
    own = [*keys, "l_partkey", "l_suppkey", "l_quantity"]
    kept = winners(spark, name, keys, order).select(*own, F.lit("kept").alias("reason"))
    return kept.unionByName(spark.read.parquet(lost).select(*own, F.col(REASON).alias("reason")))


def k10_retention(spark: SparkSession, d: str) -> DataFrame:
    """Two daily Bronze batches; the older partition is dropped."""
    path = scratch_dir(spark, "k10")
    li = table(spark, d, "lineitem")
    K.write_bronze(with_lineage(li, "b-old", "2024-01-01", "old.csv"), path)
    K.write_bronze(with_lineage(li, "b-new", "2024-01-02", "new.csv"), path)
    K.drop_partitions(spark, path, "2024-01-02")
    return spark.read.parquet(path).select("l_orderkey", "l_linenumber", "l_quantity", "batch_id")


def k12_partition_guard(spark: SparkSession, d: str) -> DataFrame:
    """Distinct values of candidate partition columns, checked against the limit."""
    li = table(spark, d, "lineitem")
    rows = []
    for c, limit in (("l_returnflag", 10_000), ("l_linestatus", 10_000), ("l_linestatus", 1), ("l_orderkey", 100)):
        try:
            rows.append((c, limit, K.check_partition_column(li, c, limit), False))
        except ValueError:
            rows.append((c, limit, None, True))
    return spark.createDataFrame(rows, "column string, max_values long, distinct_values long, refused boolean")


def k6_register_comment(spark: SparkSession, d: str) -> DataFrame:
    """Tables registered on shared locations, commented, read back."""
    import uuid

    from strata.operators.audits import check_comments

    tag = uuid.uuid4().hex[:8]
    gold = scratch_dir(spark, "k6")
    o = table(spark, d, "orders")
    o.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).write.parquet(gold)
    name = f"strata_gold_status_{tag}"
    K.register(spark, name, gold)
    K.comment_columns(spark, name, {"o_orderstatus": "order status code", "n": "orders with that status"})
    failed = check_comments(spark, name).filter(F.col("status") == "fail").count()
    if failed:
        raise RuntimeError(f"{failed} columns without comments")
    csv_path = scratch_dir(spark, "k6csv")
    K.write_csv(o.select("o_orderkey", "o_orderstatus"), csv_path, Dialect())
    ext = S.register_files(spark, f"strata_orders_csv_{tag}", "csv", csv_path, {"header": "true"})
    ctas = S.ctas_from_files(
        spark, f"strata_orders_ctas_{tag}", csv_path, Dialect(), T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderstatus", T.StringType())]),
        location=scratch_dir(spark, "k6ctas"),
    )
    per_status = spark.table(name)
    check = ext.count() == ctas.count()
    if not check:
        raise RuntimeError("external and CTAS tables disagree")
    return per_status


LINE_WIDE = T.StructType(
    [
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_partkey", T.LongType()),
        T.StructField("l_suppkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_quantity", T.DoubleType()),
        T.StructField("l_extendedprice", T.DoubleType()),
        T.StructField("l_returnflag", T.StringType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_shipdate", T.TimestampNTZType()),
    ]
)


def e2e_lineitem_layers(spark: SparkSession, d: str) -> DataFrame:
    """Bronze (CSV files, manifest, audit) -> Silver (one flagged write) ->
    Gold, each layer materialised once; returns the stored Gold table."""
    import datetime as _dt

    from strata.operators.aggregates import Aggregate, Measure
    from strata.plans.stages import run_bronze, run_gold, run_silver

    src = scratch_dir(spark, "e2e_src")
    li = table(spark, d, "lineitem").select(*LINE_WIDE.fieldNames())
    K.write_csv(dealt(li), src, Dialect())
    root = scratch_dir(spark, "e2e")
    b = run_bronze(spark, f"{src}/*.csv", root, Dialect(), schema=LINE_WIDE, batch_id="e2e", ingestion_date="2024-01-01")
    s = run_silver(spark, b.paths["bronze"], lineitem_contract(spark, d), root, check_time=_dt.datetime(2024, 1, 1))
    agg = Aggregate(
        "by_flag_status",
        ["l_returnflag", "l_linestatus"],
        [Measure("total_price", "money_sum", "l_extendedprice"), Measure("row_count", "count_all"), Measure("avg_qty", "avg", "l_quantity", digits=6)],
    )
    g = run_gold(spark, s.paths["silver"], [agg], f"{root}/gold")
    return spark.read.parquet(g.paths["by_flag_status"]).drop("last_updated")


# --- streams ------------------------------------------------------------------------


def _line_files(spark: SparkSession, d: str, files: int = 4) -> str:
    path = scratch_dir(spark, "lines")
    li = table(spark, d, "lineitem").select(*LINE_SCHEMA.fieldNames())
    K.write_csv(dealt(li, files), path, Dialect())
    return path


def t1_stream_bronze(spark: SparkSession, d: str) -> DataFrame:
    """New files appended to Bronze by a file stream (availableNow)."""
    src = _line_files(spark, d)
    out, ck = scratch_dir(spark, "t1out"), scratch_dir(spark, "t1ck")
    stream_bronze(spark, src, LINE_SCHEMA, out, ck, Dialect())
    return spark.read.parquet(out).select("l_orderkey", "l_linenumber", "l_quantity")


def t2_stream_silver(spark: SparkSession, d: str) -> DataFrame:
    """Epochs classified one by one; duplicates found across epochs.

    The pairs of years follow the dedup order. Each is written by all tasks of
    the scan and then streamed as one epoch, so the stream's outcomes are those
    of the batch classifier."""
    from strata.streaming.files import bronze_stream

    src, out, ck = scratch_dir(spark, "t2src"), scratch_dir(spark, "t2out"), scratch_dir(spark, "t2ck")
    li = table(spark, d, "lineitem").select(*LINE_SCHEMA.fieldNames())
    contract = lineitem_contract(spark, d)
    pair = F.floor(F.year("l_shipdate") / 2)
    for r in li.select(pair.alias("p")).distinct().orderBy("p").collect():  # a few pairs of years, null first
        own = li.where(pair.eqNullSafe(F.lit(r["p"]).cast("bigint")))
        own.write.mode("append").option("header", "true").csv(src)
        stream_silver(bronze_stream(spark, src, LINE_SCHEMA, Dialect()), contract, out, ck)
    kept, quarantined = silver_outputs(spark, out)
    both = quarantined.select(REASON).unionByName(kept.select(F.lit(None).cast("string").alias(REASON)))
    return outcome_counts(both)


def t3_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    """The first order of every customer, over runs of a stream that
    remembers customers in keyed state (a run per three years of orders)."""
    from strata.contract import Contract, Rule
    from strata.streaming.files import bronze_stream

    src, out, ck = scratch_dir(spark, "t3src"), scratch_dir(spark, "t3out"), scratch_dir(spark, "t3ck")
    o = table(spark, d, "orders")
    span = F.floor(F.year("o_orderdate") / 3)
    c = Contract("first_orders", dedup_keys=["o_custkey"], dedup_order=["o_orderdate", "o_orderkey"], rules=[Rule.range("o_totalprice", "1000..300000")])
    for r in o.select(span.alias("s")).distinct().orderBy("s").collect():  # a few spans, null first
        o.where(span.eqNullSafe(F.lit(r["s"]).cast("bigint"))).write.mode("append").parquet(src)
        stream_silver(bronze_stream(spark, src, o.schema, fmt="parquet"), c, out, ck, seen="state")
    kept, quarantined = silver_outputs(spark, out)
    own = ["o_orderkey", "o_custkey", "o_totalprice"]
    return kept.select(*own, F.lit("kept").alias("reason")).unionByName(quarantined.select(*own, F.col(REASON).alias("reason")))


def t3_watermark_late(spark: SparkSession, d: str) -> DataFrame:
    """Events streamed in spans of six days, with copies of rows of the
    span before and of three spans before, under a watermark of four days."""
    import datetime as dt

    from strata.contract import Contract, Rule
    from strata.streaming.files import bronze_stream
    from strata.streaming.watermark import stream_silver_within

    src, out, ck = scratch_dir(spark, "t3wsrc"), scratch_dir(spark, "t3wout"), scratch_dir(spark, "t3wck")
    e = table(spark, d, "events").withColumn("span", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / (6 * 86400)))
    again = e.where("event_id % 7 = 0").withColumn("span", F.col("span") + 1)
    old = e.where("event_id % 11 = 0").withColumn("span", F.col("span") + 3)
    feed = e.unionByName(again).unionByName(old)
    c = Contract("events", dedup_keys=["event_id"], dedup_order=["ts"], rules=[Rule.range("value", "0..30")])
    for r in e.select("span").distinct().orderBy("span").collect():  # a few spans
        feed.where(F.col("span") == r["span"]).write.mode("append").parquet(src)
        b = bronze_stream(spark, src, feed.schema, fmt="parquet")
        stream_silver_within(b, c, out, ck, event_time="ts", delay=dt.timedelta(days=4))
    kept, quarantined = silver_outputs(spark, out)
    own = ["event_id", "span", "user_id", "event_type", "value", "props"]
    return kept.select(*own, F.lit("kept").alias("reason")).unionByName(quarantined.select(*own, F.col(REASON).alias("reason")))


def t2_stream_rules(spark: SparkSession, d: str) -> DataFrame:
    """T2 without dedup: range and FK rules inside a plain streaming query."""
    from strata.contract import Contract, Rule
    from strata.streaming.files import bronze_stream, stream_silver_rules

    src = _line_files(spark, d)
    out, ck = scratch_dir(spark, "t2r_out"), scratch_dir(spark, "t2r_ck")
    sup = table(spark, d, "supplier").filter(F.col("s_acctbal") >= 0)
    c = Contract("lineitem_rules", rules=[Rule.range("l_quantity", "5..45"), Rule.foreign_key("l_suppkey", sup, "s_suppkey")])
    files = sum(n.endswith(".csv") for n in K.list_dir(spark, src))
    half = max(2, -(-files // 2))  # two epochs, whatever the table's size
    stream_silver_rules(bronze_stream(spark, src, LINE_SCHEMA, Dialect(), max_files_per_trigger=half), c, out, ck)
    return outcome_counts(spark.read.parquet(out))


FILE_QUERIES: dict[str, Query] = {
    "s1_csv_latin1_semicolon": s1_csv_latin1_semicolon,
    "s3_preamble_skip": s3_preamble_skip,
    "s4_header_detect": s4_header_detect,
    "s3_multiline_preamble": s3_multiline_preamble,
    "s5_json_lines": s5_json_lines,
    "s6_payload_unwrap": s6_payload_unwrap,
    "s9_dir_source_file": s9_dir_source_file,
    "s13_binary_listing": s13_binary_listing,
    "s16_walk_new_files": s16_walk_new_files,
    "s17_new_files": s17_new_files,
    "s20_corrupt_capture": s20_corrupt_capture,
    "s3_headers_per_file": s3_headers_per_file,
    "k1_bronze_roundtrip": k1_bronze_roundtrip,
    "k2_silver_split": k2_silver_split,
    "q9_bucketed_bronze": q9_bucketed_bronze,
    "k8_zorder": k8_zorder,
    "k8_hilbert_text": k8_hilbert_text,
    "k9_compact": k9_compact,
    "t1_stream_bronze": t1_stream_bronze,
    "t2_stream_silver": t2_stream_silver,
    "t2_stream_rules": t2_stream_rules,
    "t3_keyed_state": t3_keyed_state,
    "t3_watermark_late": t3_watermark_late,
    "f7_from_file": f7_from_file,
    "w6_head": w6_head,
    "k10_retention": k10_retention,
    "w1_incremental_first": w1_incremental_first,
    "k12_partition_guard": k12_partition_guard,
    "k6_register_comment": k6_register_comment,
    "e2e_lineitem_layers": e2e_lineitem_layers,
}

_ORDERS_TEXT = "SELECT o_orderkey,o_custkey,o_orderstatus,o_totalprice,CAST(o_orderdate AS DATE) AS o_orderdate,o_orderpriority FROM orders"

FILE_ORACLE: dict[str, str] = {
    "s1_csv_latin1_semicolon": "SELECT c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment FROM customer",
    "s3_preamble_skip": _ORDERS_TEXT,
    "s4_header_detect": _ORDERS_TEXT,
    "s3_multiline_preamble": "SELECT doc_id,lang,text FROM documents",
    "s5_json_lines": "SELECT event_id,ts,user_id,event_type,value,props FROM events",
    "s6_payload_unwrap": "SELECT c_custkey,c_name,c_acctbal FROM customer",
    "s9_dir_source_file": "SELECT o_orderkey,CASE WHEN o_orderkey%2=0 THEN 'a' ELSE 'b' END||'/data.csv' AS source FROM orders",
    "s13_binary_listing": "SELECT CASE WHEN o_orderkey%2=0 THEN 'a' ELSE 'b' END AS folder,'data.csv' AS name,true AS sized,count(*) AS rows FROM orders GROUP BY 1",
    "s16_walk_new_files": "SELECT strftime(o_orderdate,'%Y-%m') AS month,count(DISTINCT substr(o_orderpriority,1,1)) AS files,count(DISTINCT substr(o_orderpriority,1,1)) FILTER (substr(o_orderpriority,1,1) NOT IN ('1','2')) AS new_files,count(*) AS rows FROM orders GROUP BY 1",
    "s17_new_files": "SELECT DISTINCT 'after a' AS state,'b' AS folder,'data.csv' AS name FROM orders WHERE o_orderkey%2=1",
    "s3_headers_per_file": "SELECT o_orderkey,CASE WHEN o_orderkey%3<2 THEN o_orderstatus END AS o_orderstatus,CASE WHEN o_orderkey%3<2 THEN o_totalprice END AS o_totalprice,o_orderkey%3=2 AS corrupt FROM orders",
    "s20_corrupt_capture": "SELECT o_orderkey,CASE WHEN o_orderkey%10=0 THEN NULL ELSE o_totalprice END AS o_totalprice,o_orderkey%10=0 AS corrupt FROM orders",
    "k1_bronze_roundtrip": "SELECT count(*) AS total_rows,CAST(1 AS BIGINT) AS batches,count(*) AS batch_rows,CAST(1 AS BIGINT) AS partitions,count(*) AS of_batch_rows FROM lineitem",
    "k2_silver_split": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey)) GROUP BY 1",
    "k8_zorder": "SELECT *,true AS narrow_o_custkey,true AS narrow_o_totalprice FROM orders",
    "q9_bucketed_bronze": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey)) GROUP BY 1",
    "k8_hilbert_text": "SELECT *,true AS narrow_c_custkey,true AS narrow_c_acctbal,true AS narrower_than_z FROM customer",
    "k9_compact": "SELECT *,true AS fewer,true AS per_value,'o_orderstatus' AS parts FROM orders",
    "t1_stream_bronze": "SELECT l_orderkey,l_linenumber,l_quantity FROM lineitem",
    "t2_stream_silver": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey)) GROUP BY 1",
    "t2_stream_rules": "SELECT CASE WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN s.s_suppkey IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason, count(*) AS n FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey GROUP BY 1",
    "t3_keyed_state": "SELECT o_orderkey,o_custkey,o_totalprice,CASE WHEN rn>1 THEN 'duplicate' WHEN NOT o_totalprice BETWEEN 1000 AND 300000 THEN 'o_totalprice failed validation' ELSE 'kept' END AS reason FROM (SELECT *,row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate,o_orderkey) AS rn FROM orders)",
    "t3_watermark_late": """WITH e AS (SELECT *, CAST(floor(epoch(ts) / 518400) AS BIGINT) AS span FROM events),
        feed AS (SELECT *, true AS own FROM e
            UNION ALL SELECT * REPLACE (span + 1 AS span), false FROM e WHERE event_id % 7 = 0
            UNION ALL SELECT * REPLACE (span + 3 AS span), false FROM e WHERE event_id % 11 = 0),
        high AS (SELECT span, max(max(ts)) OVER (ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 4 DAY AS line
            FROM e GROUP BY span)
        SELECT event_id, span, user_id, event_type, value, props,
            CASE WHEN ts <= line THEN 'late arrival' WHEN NOT own THEN 'duplicate'
                WHEN NOT value BETWEEN 0 AND 30 THEN 'value failed validation' ELSE 'kept' END AS reason
        FROM feed JOIN high USING (span)""",
    "f7_from_file": "SELECT o_orderkey,o_totalprice FROM orders WHERE o_orderkey%2=1",
    "w6_head": "SELECT o_orderkey,o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20",
    "w1_incremental_first": "SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,l_quantity,CASE WHEN rn>1 THEN 'duplicate' ELSE 'kept' END AS reason FROM (SELECT *,row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn FROM lineitem)",
    "k10_retention": "SELECT l_orderkey,l_linenumber,l_quantity,'b-new' AS batch_id FROM lineitem",
    "k12_partition_guard": "SELECT c AS column,m AS max_values,CASE WHEN n<=m THEN n END AS distinct_values,n>m AS refused FROM (SELECT 'l_returnflag' AS c,CAST(10000 AS BIGINT) AS m,count(DISTINCT l_returnflag) AS n FROM lineitem UNION ALL SELECT 'l_linestatus',10000,count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT 'l_linestatus',1,count(DISTINCT l_linestatus) FROM lineitem UNION ALL SELECT 'l_orderkey',100,count(DISTINCT l_orderkey) FROM lineitem)",
    "k6_register_comment": "SELECT o_orderstatus,count(*) AS n FROM orders GROUP BY 1",
    "e2e_lineitem_layers": "SELECT l_returnflag,l_linestatus,CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,count(*) AS row_count,round(avg(l_quantity),6) AS avg_qty FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn FROM lineitem l) x WHERE rn=1 AND l_quantity BETWEEN 5 AND 45 AND EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey=x.l_suppkey AND s.s_acctbal>=0) GROUP BY 1,2",
}
