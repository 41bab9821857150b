"""Report tables (inventory R1-R7): queries over stored outputs, manifest
and check tables — nothing parsed out of printed text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators.aggregates import Aggregate, pct_of_total, reason_counts
from strata.operators.audits import union_checks


def run_summary(outputs: Mapping[str, tuple[str, DataFrame]]) -> DataFrame:
    """(stage, output, rows) for every named output.

    ``outputs`` maps output name -> (stage, DataFrame); each count is a
    one-row aggregate, unioned.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(stage).alias("stage"), F.lit(name).alias("output"), "rows")
        for name, (stage, df) in outputs.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def failure_reasons(quarantine: DataFrame, reason: str = "_dq_failure_reason") -> DataFrame:
    """R2: (reason, rows, pct of quarantined rows)."""
    counts = reason_counts(quarantine, reason).withColumnRenamed("n", "rows")
    return pct_of_total(counts, "rows", "pct", 2)


def aggregate_catalog(spark: SparkSession, aggs: Sequence[Aggregate], table_prefix: str = "") -> DataFrame:
    """(name, grain, dimensions, measures, use_case, sample_query) — metadata."""
    rows = []
    for a in aggs:
        dims = ", ".join(a.dims)
        measures = ", ".join(f"{m.kind}({m.column or '*'}) AS {m.alias}" for m in a.measures)
        sample = f"SELECT {dims}, {', '.join(m.alias for m in a.measures)} FROM {table_prefix}{a.name} LIMIT 10"
        rows.append((a.name, dims, dims, measures, a.use_case, sample))
    return spark.createDataFrame(rows, "name string, grain string, dimensions string, measures string, use_case string, sample_query string")


def batch_metadata(manifest: DataFrame) -> DataFrame:
    """Per batch: date, files, rows, first and last source file."""
    return manifest.groupBy("batch_id", "ingestion_date").agg(
        F.count_distinct("source_path").alias("files"),
        F.sum("row_count").cast("long").alias("rows"),
        F.min("source_path").alias("first_source"),
        F.max("source_path").alias("last_source"),
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Per column: type, rows, nulls, distinct count, min, max.

    One aggregate pass over the data; min/max are reported as text so all
    columns fit one table. Distinct counts are approximate unless ``exact``.
    """
    distinct, label = (F.count_distinct, "distinct") if exact else (F.approx_count_distinct, "distinct_approx")
    cols = list(columns) if columns is not None else df.columns
    types = {f.name: f.dataType for f in df.schema.fields}
    structs = []
    for c in cols:
        x = F.col(f"`{c}`")
        orderable = not isinstance(types[c], (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))
        structs.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(types[c].simpleString()).alias("type"),
                F.count_if(x.isNull()).alias("nulls"),
                (distinct(x) if orderable else F.lit(None).cast("long")).alias(label),
                (F.min(x).cast("string") if orderable else F.lit(None).cast("string")).alias("min"),
                (F.max(x).cast("string") if orderable else F.lit(None).cast("string")).alias("max"),
            )
        )
    one = df.agg(F.count(F.lit(1)).alias("rows"), F.array(*structs).alias("_s"))
    return one.select("rows", F.explode("_s").alias("s")).select("s.column", "s.type", "rows", "s.nulls", f"s.{label}", "s.min", "s.max")


def profile_tables(df: DataFrame, max_distinct: int = 50) -> dict[str, DataFrame]:
    """R5 in full: per-column profile, numeric summary, the value
    distribution of low-cardinality columns (A10-A13), and the columns that
    have too many values for one."""
    from strata.operators.aggregates import skipped_columns, summary, value_counts

    return {
        "columns": profile(df),
        "summary": summary(df),
        "values": value_counts(df, max_distinct=max_distinct),
        "values_skipped": skipped_columns(df, max_distinct=max_distinct),
    }


def audit_table(*checks: DataFrame) -> DataFrame:
    """Audit results of all stages in one table."""
    return union_checks(*checks)


def storage(spark: SparkSession, tables: Mapping[str, str]) -> DataFrame:
    """(table, files, bytes) from a recursive listing of each table folder.

    Every data file counts, of any format; markers and hidden files (names
    that start with ``_`` or ``.``) don't. The listing reads file metadata
    only (``content`` is pruned).
    """
    parts = []
    for name, path in tables.items():
        listing = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .load(path)
            .select("length")
        )
        parts.append(
            listing.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("bytes"))
            .select(F.lit(name).alias("table"), "files", "bytes")
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
