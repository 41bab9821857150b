"""Writes and table layout (inventory K1-K14).

Storage is Parquet behind a ``fmt`` argument (Delta or another table
format can be passed where its jars are installed). File-system steps
(swap, delete a partition folder) go through Hadoop's ``FileSystem`` so
they work on any cluster file system, not only a local disk.
"""

from __future__ import annotations

import datetime as _dt
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators.quality import CHECK_TIME, REASON
from strata.sources.dialect import Dialect

OUTCOME = "_dq_outcome"


# --- Hadoop file system helpers ---------------------------------------------


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm  # type: ignore[attr-defined]
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p  # type: ignore[attr-defined]


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.delete(p, True))


def rename_path(spark: SparkSession, src: str, dst: str) -> bool:
    fs, s = _fs(spark, src)
    _, d = _fs(spark, dst)
    return bool(fs.rename(s, d))


def list_dir(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return [str(st.getPath().getName()) for st in fs.listStatus(p)]


def dir_bytes(spark: SparkSession, path: str) -> int:
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0


# --- writes --------------------------------------------------------------------


def write_bronze(df: DataFrame, path: str, partition: str = "ingestion_date", fmt: str = "parquet", by_batch: bool = False) -> None:
    """K1: append, partitioned by ingestion date.

    With ``by_batch`` each batch gets its own sub-partition and the write
    replaces only the partitions it produces (dynamic overwrite): running
    the same batch again after a failure replaces it instead of adding it
    twice, while other batches stay.
    """
    if not by_batch:
        df.write.format(fmt).mode("append").partitionBy(partition).save(path)
        return
    (
        df.write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition, "batch_id")
        .save(path)
    )


def write_bronze_bucketed(
    df: DataFrame,
    table: str,
    path: str,
    keys: Sequence[str],
    buckets: int,
    partition: str = "ingestion_date",
    fmt: str = "parquet",
) -> DataFrame:
    """K1 for tables rebuilt into Silver again and again: append Bronze as an
    external table at ``path``, bucketed (and sorted) by the dedup keys.

    Silver's keep-first window then reads the buckets as they lie: its
    ``partitionBy(keys)`` needs no shuffle of the full rows, each run. The
    bucket count should match the intended shuffle width (e.g. from
    ``strata.session.size_for_input``).
    """
    # clustered as the buckets are, so each bucket is one sorted file
    (
        df.repartition(buckets, *keys)
        .write.format(fmt)
        .mode("append")
        .partitionBy(partition)
        .bucketBy(buckets, *keys)
        .sortBy(*keys)
        .option("path", path)
        .saveAsTable(table)
    )
    return df.sparkSession.table(table)


def recover(spark: SparkSession, path: str) -> bool:
    """Put back the version that a swap cut short had moved aside, if the
    path is missing; says whether it did."""
    base, _, name = path.rstrip("/").rpartition("/")
    if path_exists(spark, path) or not base:
        return False
    for old in sorted(n for n in list_dir(spark, base) if n.startswith(f"{name}.__old_")):
        return rename_path(spark, f"{base}/{old}", path)
    return False


def write_overwrite(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """Overwrite a path that ``df`` may itself read: write beside, then swap.

    Spark refuses to overwrite a path its plan reads; the new version is
    written to a sibling folder first, then the old folder is replaced.
    Every step is checked: when one fails, the old version is put back and
    the error raised; the old version goes only after the new one stands.
    A swap that died between its two renames is undone by the next write
    (or by ``recover``).
    """
    spark = df.sparkSession
    recover(spark, path)
    staging = f"{path.rstrip('/')}.__next_{uuid.uuid4().hex[:8]}"
    w = df.write.format(fmt).mode("overwrite")
    if partition:
        w = w.partitionBy(*partition)
    w.save(staging)
    old = f"{path.rstrip('/')}.__old_{uuid.uuid4().hex[:8]}"
    had = path_exists(spark, path)
    if had and not rename_path(spark, path, old):
        delete_path(spark, staging)
        raise OSError(f"can't move {path} aside; it is unchanged")
    try:
        done = rename_path(spark, staging, path)
    except Exception:  # noqa: BLE001 - put the old version back, then raise
        if had:
            rename_path(spark, old, path)
        raise
    if not done:
        if had and not rename_path(spark, old, path):
            raise OSError(f"can't move the new version to {path}, nor the old one back; it is at {old}")
        raise OSError(f"can't move {staging} to {path}; the old version stays")
    if had:
        delete_path(spark, old)


def write_silver(df: DataFrame, path: str, fmt: str = "parquet", partition: Sequence[str] = ()) -> None:
    """K2: full rebuild of a Silver table from Bronze."""
    write_overwrite(df, path, fmt, partition)


def append_quarantine(df: DataFrame, path: str, fmt: str = "parquet", run: str | None = None) -> None:
    """K3: append quarantined rows, partitioned by the *date* of the check.

    Each run is a sub-partition of its day, written with dynamic partition
    overwrite: the history of earlier runs stays, and a run repeated after a
    failure replaces its own rows instead of adding them again. ``run``
    names it (contract and run id, so that two contracts checked at one
    time don't meet); by default it is the check time to the microsecond. The table always exists with its schema, even when no row
    was ever quarantined: an empty append leaves an empty file in today's
    partition.
    """
    spark = df.sparkSession
    (
        df.withColumns(
            {
                "_dq_check_date": F.to_date(F.col(CHECK_TIME)),
                "_dq_run": F.date_format(F.col(CHECK_TIME), "yyyyMMdd'T'HHmmssSSSSSS") if run is None else F.lit(run),
            }
        )
        .write.format(fmt)
        .mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("_dq_check_date", "_dq_run")
        .save(path)
    )
    if not any(n.startswith("_dq_check_date=") for n in list_dir(spark, path)):
        today = _dt.datetime.now(_dt.timezone.utc).date().isoformat()
        df.limit(0).write.format(fmt).mode("append").save(f"{path.rstrip('/')}/_dq_check_date={today}/_dq_run=none")


def write_split(flagged: DataFrame, root: str, fmt: str = "parquet") -> tuple[DataFrame, DataFrame]:
    """Q9 materialised once: write the flagged frame partitioned by outcome,
    then read kept and quarantined back (one job, one dedup shuffle)."""
    spark = flagged.sparkSession
    out = flagged.withColumn(OUTCOME, F.when(F.col(REASON).isNull(), F.lit("kept")).otherwise(F.lit("quarantined")))
    out.write.format(fmt).mode("overwrite").partitionBy(OUTCOME).save(root)
    stored = spark.read.format(fmt).load(root)
    kept = stored.filter(F.col(OUTCOME) == "kept").drop(OUTCOME, REASON, "_dq_failure_value", CHECK_TIME)
    quarantined = stored.filter(F.col(OUTCOME) == "quarantined").drop(OUTCOME)
    return kept, quarantined


def write_gold(aggs: Mapping[str, DataFrame], root: str, fmt: str = "parquet") -> dict[str, str]:
    """K4: one overwritten table per aggregate; returns name -> path."""
    paths = {}
    for name, df in aggs.items():
        p = f"{root.rstrip('/')}/{name}"
        write_overwrite(df, p, fmt)
        paths[name] = p
    return paths


def manifest_rows(bronze_df: DataFrame, listing: DataFrame | None = None, batch_id: str | None = None, ingestion_date: str | None = None) -> DataFrame:
    """K5 rows: one per (source file, batch, date) with its row count.

    With ``listing`` (``list_files``) rows also carry each file's length and
    modification time, and listed files that gave no row are recorded too,
    with 0 rows, under ``batch_id`` and ``ingestion_date``."""
    rows = bronze_df.groupBy(F.col("source_file").alias("source_path"), "batch_id", "ingestion_date").agg(
        F.count(F.lit(1)).alias("row_count")
    )
    if listing is None:
        return rows
    files = listing.select(
        F.col("source_path").alias("_path"), F.col("length").alias("source_length"), F.col("modificationTime").alias("source_modified")
    )
    both = files.join(rows, F.col("_path") == F.col("source_path"), "left")
    return both.select(
        F.col("_path").alias("source_path"),
        "source_length",
        "source_modified",
        F.coalesce("batch_id", F.lit(batch_id)).alias("batch_id"),
        F.coalesce("ingestion_date", F.lit(ingestion_date).cast("date")).alias("ingestion_date"),
        F.coalesce("row_count", F.lit(0)).alias("row_count"),
    )


def append_manifest(
    bronze_df: DataFrame, path: str, fmt: str = "parquet", listing: DataFrame | None = None, batch_id: str | None = None, ingestion_date: str | None = None
) -> DataFrame:
    """K5: append manifest rows (path, rows, batch, date, time)."""
    rows = manifest_rows(bronze_df, listing, batch_id, ingestion_date).withColumn("recorded_at", F.current_timestamp())
    rows.write.format(fmt).mode("append").save(path)
    return bronze_df.sparkSession.read.format(fmt).load(path)


def register(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> None:
    """K6: external table over a location (idempotent)."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} USING {fmt} LOCATION '{path}'")
    if any(c.isPartition for c in spark.catalog.listColumns(name)):
        spark.sql(f"MSCK REPAIR TABLE {name}")


def comment_columns(spark: SparkSession, table: str, comments: Mapping[str, str], default: str = "No description provided.") -> None:
    """K7: a comment on every column; columns without one get ``default``."""
    for c in spark.table(table).columns:
        text = comments.get(c, default).replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {table} ALTER COLUMN `{c}` COMMENT '{text}'")


def rebuild_table(spark: SparkSession, name: str, df: DataFrame, fmt: str = "parquet") -> DataFrame:
    """Idempotent rebuild — drop if exists, then create as select."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    df.write.format(fmt).saveAsTable(name)
    return spark.table(name)


def check_partition_column(df: DataFrame, column: str, limit: int = 10_000) -> int:
    """Refuse a partition column with more than ``limit`` distinct values;
    returns their number otherwise.

    Exact: distinct values are combined map-side, and no more than
    ``limit`` + 1 of them are counted."""
    n = df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct().limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"partition column {column!r} has more than {limit} distinct values")
    return n


def write_csv(df: DataFrame, path: str, dialect: Dialect = Dialect(), mode: str = "overwrite") -> None:
    """Delimited text with the dialect's separator, encoding and quoting."""
    opts = dialect.options()
    opts.pop("multiLine", None)
    df.write.mode(mode).options(**opts).csv(path)


def verify_write(spark: SparkSession, path: str, batch_id: str | None = None, fmt: str = "parquet") -> DataFrame:
    """Total rows, batches, partitions and this batch's rows in one aggregate."""
    df = spark.read.format(fmt).load(path)
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    if "batch_id" in df.columns:
        aggs.append(F.count_distinct("batch_id").alias("batches"))
        aggs.append(F.count_if(F.col("batch_id") == F.lit(batch_id)).alias("batch_rows"))
    if "ingestion_date" in df.columns:
        aggs.append(F.count_distinct("ingestion_date").alias("partitions"))
    return df.agg(*aggs)


# --- layout ----------------------------------------------------------------


def _text_edges(df: DataFrame, column: str, buckets: int, prefix: int) -> list[str]:
    """At most ``buckets`` - 1 values that cut the distinct prefixes of a text
    column into ranges of about equal size.

    Distinct prefixes are combined map-side, so a value that a third of the
    rows have counts once; the ranges are those of a range partitioning,
    and one prefix per range reaches the driver."""
    values = df.select(F.substring(F.col(f"`{column}`").cast("string"), 1, prefix).alias("v")).where("v is not null").distinct()
    lows = values.repartitionByRange(buckets, "v").groupBy(F.spark_partition_id().alias("p")).agg(F.min("v").alias("low"))
    return sorted(r["low"] for r in lows.collect())[1:]


def _hilbert(coordinates: list, bits: int):  # noqa: ANN202
    """Position on the Hilbert curve: the coordinates are rotated and flipped
    bit by bit, Gray-coded, and their bits interleaved (Skilling, 2004)."""
    k = len(coordinates)
    steps = [F.struct(F.lit(1 << bit).cast("long").alias("q"), F.lit(i).alias("i")) for bit in range(bits - 1, 0, -1) for i in range(k)]

    def turn(x, step):  # noqa: ANN001, ANN202
        q, i = step["q"], step["i"]
        own, first, low = F.get(x, i), F.get(x, F.lit(0)), q - 1
        hit = own.bitwiseAND(q) != 0
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        new_first = F.when(hit, first.bitwiseXOR(low)).otherwise(first.bitwiseXOR(swap))
        new_own = F.when(hit, own).otherwise(own.bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, new_first).when(j == i, new_own).otherwise(v))

    x = F.array(*coordinates)
    if k > 1 and steps:
        x = F.aggregate(F.array(*steps), x, turn)
    # Gray code along the axes: every axis is folded into the next
    gray = F.aggregate(x, F.array().cast("array<bigint>"), lambda out, v: F.concat(out, F.array(v.bitwiseXOR(F.coalesce(F.get(out, F.size(out) - 1), F.lit(0).cast("long"))))))

    def fold(a):  # noqa: ANN001, ANN202
        flips = F.array(*[F.lit(1 << bit).cast("long") for bit in range(bits - 1, 0, -1)]) if bits > 1 else F.array().cast("array<bigint>")
        last = F.get(a, F.lit(k - 1))
        t = F.aggregate(flips, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.transform(a, lambda v: v.bitwiseXOR(t))

    order = [F.struct(F.lit(bit).alias("b"), F.lit(i).alias("i")) for bit in range(bits - 1, -1, -1) for i in range(k)]
    place = lambda a: F.aggregate(
        F.array(*order),
        F.lit(0).cast("long"),
        lambda key, s: F.shiftleft(key, 1).bitwiseOR(F.call_function("shiftright", F.get(a, s["i"]), s["b"]).bitwiseAND(F.lit(1))),
    )
    # each stage is bound once, as the element of an array of one
    return F.get(F.transform(F.transform(F.array(gray), fold), place), F.lit(0))


def zorder_key(
    df: DataFrame, columns: Sequence[str], bits: int = 8, relative_error: float = 0.01, curve: str = "z", text_prefix: int = 64
) -> DataFrame:
    """K8 key: position of the row's quantile buckets on a space-filling curve.

    Bucket edges come from ``approxQuantile`` (a bounded list of
    2**bits - 1 numbers per column), those of text columns from a range
    partitioning of the distinct first ``text_prefix`` characters, so
    buckets keep the order of the values. ``curve`` is ``"z"`` (bits
    interleaved) or ``"hilbert"``, whose neighbours on the curve always are
    neighbours in space, so files are narrower in every column.
    """
    from pyspark.sql import types as T

    if curve not in ("z", "hilbert"):
        raise ValueError(f"curve is 'z' or 'hilbert', not {curve!r}")
    n = 1 << bits
    probs = [i / n for i in range(1, n)]

    def is_text(c: str) -> bool:
        return isinstance(df.schema[c].dataType, (T.StringType, T.CharType, T.VarcharType))

    def comparable(c: str):  # noqa: ANN202
        dt = df.schema[c].dataType
        col = F.col(f"`{c}`")
        if isinstance(dt, T.NumericType):
            return col.cast("double")
        if isinstance(dt, T.DateType):
            return F.unix_date(col).cast("double")
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            return F.unix_micros(col.cast("timestamp")).cast("double")
        if is_text(c):
            return F.substring(col.cast("string"), 1, text_prefix)
        raise ValueError(f"clustering needs numeric, temporal or text columns, not {c!r} ({dt.simpleString()})")

    comparables = {c: comparable(c) for c in columns}
    numbers = [c for c in columns if not is_text(c)]
    edges: dict[str, list] = {}
    if numbers:
        proxies = df.select(*[comparables[c].alias(f"_zq{i}") for i, c in enumerate(numbers)])
        found = proxies.approxQuantile([f"_zq{i}" for i in range(len(numbers))], probs, relative_error)
        edges = {c: sorted(set(map(float, e))) for c, e in zip(numbers, found, strict=True)}
    edges |= {c: _text_edges(df, c, n, text_prefix) for c in columns if is_text(c)}

    def bucket(c: str):  # noqa: ANN202
        """Number of edges <= x, by binary search (nulls go to bucket 0)."""
        ends, x = edges[c], comparables[c]

        def search(lo: int, hi: int):  # noqa: ANN202
            if lo == hi:
                return F.lit(lo)
            mid = (lo + hi) // 2
            return F.when(x < F.lit(ends[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

        return F.when(x.isNull(), F.lit(0)).otherwise(search(0, len(ends))).cast("long")

    buckets = [bucket(c) for c in columns]
    if curve == "hilbert":
        return df.withColumn("_zkey", _hilbert(buckets, bits))
    key = F.lit(0).cast("long")
    k = len(buckets)
    for bit in range(bits):
        for j, b in enumerate(buckets):
            key = key.bitwiseOR(F.shiftleft(F.shiftright(b, bit).bitwiseAND(F.lit(1)), bit * k + j))
    return df.withColumn("_zkey", key)


def zorder_write(
    df: DataFrame, path: str, columns: Sequence[str], files: int = 16, fmt: str = "parquet", bits: int = 8, curve: str = "z"
) -> None:
    """K8: cluster rows by a Z-order or Hilbert key over 1-4 columns (numbers,
    dates, times or texts) into ``files`` output files.

    Range partitioning by the key groups nearby values in one file, so
    Parquet min/max statistics let filters on any of the columns skip files.
    """
    if not 1 <= len(columns) <= 4:
        raise ValueError("Z-order on 1-4 columns; more dilutes clustering")
    others = [c for c in df.columns if c not in columns][:3]
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in others]) if others else F.lit(0).cast("long")
    # a hash of a few other columns after the key lets one very common key
    # value span several files instead of landing in one range partition
    keyed = zorder_key(df, columns, bits, curve=curve).withColumn("_zt", tie)
    out = keyed.repartitionByRange(files, "_zkey", "_zt").sortWithinPartitions("_zkey").drop("_zkey", "_zt")
    write_overwrite(out, path, fmt)


def file_spans(spark: SparkSession, path: str, column: str, fmt: str = "parquet") -> DataFrame:
    """K8 check: per file, min and max of a column (how well files cluster)."""
    df = spark.read.format(fmt).load(path)
    return df.groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.min(column).alias("lo"), F.max(column).alias("hi"), F.count(F.lit(1)).alias("rows")
    )


def partition_columns(spark: SparkSession, path: str) -> list[str]:
    """The columns a stored table is partitioned by, from its folders."""
    found: list[str] = []
    at = path.rstrip("/")
    while True:
        inner = [n for n in list_dir(spark, at) if "=" in n and not n.startswith(("_", "."))] or [
            n for n in list_dir(spark, at) if n.startswith("_dq_") and "=" in n
        ]
        if not inner:
            return found
        found.append(inner[0].split("=", 1)[0])
        at = f"{at}/{inner[0]}"


def compact(spark: SparkSession, path: str, target_mb: int = 128, fmt: str = "parquet") -> int:
    """K9: rewrite a table into files of about ``target_mb``; returns the file count.

    The table keeps its partition columns. Rows are rebalanced by adaptive
    execution, which merges small partition values' tasks and splits large
    values over several (REBALANCE goes by bytes)."""
    partition = partition_columns(spark, path)
    df = spark.read.format(fmt).load(path)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_mb << 20),
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        write_overwrite(df.hint("rebalance", *[F.col(f"`{c}`") for c in partition]), path, fmt, partition)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return len(spark.read.format(fmt).load(path).inputFiles())


def drop_partitions(spark: SparkSession, path: str, before: _dt.date | str, column: str = "ingestion_date") -> list[str]:
    """Delete ``column=<date>`` partition folders older than ``before``."""
    cutoff = str(before)
    dropped = []
    for name in list_dir(spark, path):
        if name.startswith(f"{column}=") and name.split("=", 1)[1] < cutoff:
            delete_path(spark, f"{path.rstrip('/')}/{name}")
            dropped.append(name)
    return dropped
