"""Stage audits and check tables (inventory Q8, Q13-Q21).

Every audit is a lazy frame: one aggregate over the data, unfolded into a
small *check table*:

    stage, check, status ('pass'|'fail'), observed, expected, on_fail

``on_fail`` is the action policy (Q20): ``abort``, ``quarantine`` or
``report``. ``enforce`` raises when an ``abort`` check failed. Only
check tables (one row per check) ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.columns import LINEAGE_COLUMNS
from strata.operators.skew import row_hash
from strata.operators.windows import top_n_per_group

CHECK_SCHEMA = "stage string, check string, status string, observed string, expected string, on_fail string"

# Action policies.
ABORT, QUARANTINE, REPORT = "abort", "quarantine", "report"


def check_rows(spark: SparkSession, rows: list[tuple[str, str, bool, object, object, str]]) -> DataFrame:
    """A check table from (stage, check, passed, observed, expected, on_fail) tuples."""
    data = [(s, c, "pass" if ok else "fail", None if o is None else str(o), None if e is None else str(e), p) for s, c, ok, o, e, p in rows]
    return spark.createDataFrame(data, CHECK_SCHEMA)


Check = tuple[str, str, Column, Column, object, str]


def checks_from(one: DataFrame, specs: Sequence[Check]) -> DataFrame:
    """A lazy check table from a one-row aggregate: (stage, check, passed,
    observed, expected, on_fail) with expressions over its columns."""
    rows = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.lit(check).alias("check"),
            F.when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"),
            observed.cast("string").alias("observed"),
            (expected if isinstance(expected, Column) else F.lit(str(expected))).cast("string").alias("expected"),
            F.lit(policy).alias("on_fail"),
        )
        for stage, check, ok, observed, expected, policy in specs
    ]
    return one.select(F.inline(F.array(*rows)))


def enforce(checks: DataFrame) -> DataFrame:
    """Q20: raise when a failed check has ``on_fail = 'abort'``; else return checks."""
    bad = checks.filter((F.col("status") == "fail") & (F.col("on_fail") == ABORT)).collect()  # one row per check
    if bad:
        lines = "; ".join(f"{r['stage']}/{r['check']}: observed {r['observed']}, expected {r['expected']}" for r in bad)
        raise RuntimeError(f"audit failed: {lines}")
    return checks


# --- Bronze ----------------------------------------------------------------


def stored_layout(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    """(format, partition columns) of a stored table, from its files: the
    formats are the file name endings, joined by commas where they differ."""
    from strata.sinks.layout import partition_columns

    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    ends = names.select(F.regexp_extract("path", r"([A-Za-z]+)(?:\.(?:gz|snappy|zst|lz4))?$", 1).alias("e")).distinct().orderBy("e").collect()
    return ",".join(r["e"] for r in ends), partition_columns(spark, path)


def audit_bronze(
    out: DataFrame,
    input_rows: int | None = None,
    partition_column: str = "ingestion_date",
    path: str | None = None,
    expected_format: str = "parquet",
    source_bytes: int | None = None,
) -> DataFrame:
    """Q13: non-empty, lineage columns present and non-null, rows in = rows
    out; with ``path``, the format and the partitioning of the files stored
    there. One aggregate over ``out``."""
    lineage = [c for c in LINEAGE_COLUMNS if c in out.columns]
    one = out.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in lineage],
    )
    n = F.col("rows")
    specs: list[Check] = [("bronze", "non_empty", n > 0, n, "> 0", ABORT)]
    if source_bytes is not None:
        specs.append(("bronze", "file_non_empty", F.lit(source_bytes > 0), F.lit(source_bytes), "> 0 bytes", ABORT))
    for c in LINEAGE_COLUMNS:
        nulls = F.col(f"null_{c}") if c in lineage else F.lit("missing")
        specs.append(("bronze", f"lineage_{c}", nulls == 0 if c in lineage else F.lit(False), nulls, 0, ABORT))
    if input_rows is not None:
        specs.append(("bronze", "rows_in_equals_rows_out", n == input_rows, n, input_rows, ABORT))
    if path is not None:
        kind, parts = stored_layout(out.sparkSession, path)
        specs.append(("bronze", "partitioned_by", F.lit(partition_column in parts), F.lit(",".join(parts)), partition_column, ABORT))
        specs.append(("bronze", "storage_format", F.lit(kind == expected_format), F.lit(kind), expected_format, ABORT))
    return checks_from(one, specs)


# --- Silver ----------------------------------------------------------------


def null_rates(
    df: DataFrame,
    limits: Mapping[str, float] | None = None,
    key_columns: Sequence[str] = (),
    default_limit: float = 0.02,
) -> DataFrame:
    """Q8: null share per column against its limit (0 for keys, 2% by default).

    Returns (column, rows, nulls, null_rate, limit, ok); one aggregate.
    """
    limits = dict(limits or {})
    cols = df.columns
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in cols])
    long = wide.unpivot(["__rows"], [F.col(f"`{c}`").alias(c) for c in cols], "column", "nulls")
    lim_pairs = []
    for c in cols:
        lim = limits.get(c, 0.0 if c in key_columns else default_limit)
        lim_pairs += [F.lit(c), F.lit(float(lim))]
    lim_map = F.create_map(*lim_pairs)
    rate = F.when(F.col("__rows") > 0, F.col("nulls") / F.col("__rows")).otherwise(F.lit(0.0))
    return long.select(
        "column",
        F.col("__rows").alias("rows"),
        "nulls",
        rate.alias("null_rate"),
        lim_map[F.col("column")].alias("limit"),
    ).withColumn("ok", F.col("null_rate") <= F.col("limit"))


def audit_silver(kept: DataFrame, contract, schema: T.StructType | None = None) -> DataFrame:  # noqa: ANN001
    """Q18: required columns non-null, types match the contract, no duplicate keys.

    One pass: nulls and rows are counted per key (combined map-side), then
    summed."""
    req = [c for c in contract.required_columns if c in kept.columns]
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"_n{k}") for k, c in enumerate(req)]
    one = kept
    if contract.dedup_keys:
        one = kept.groupBy(*contract.dedup_keys).agg(F.count(F.lit(1)).alias("_rows"), *nulls)
        sums = [F.coalesce(F.sum(f"_n{k}"), F.lit(0)).alias(f"_n{k}") for k in range(len(req))]
        one = one.agg(F.count_if(F.col("_rows") > 1).alias("_dups"), *sums)
    else:
        one = kept.agg(F.count(F.lit(1)).alias("_rows"), *nulls)
    specs: list[Check] = [
        ("silver", f"required_not_null:{c}", F.col(f"_n{k}") == 0, F.col(f"_n{k}"), 0, ABORT) for k, c in enumerate(req)
    ]
    target = schema or contract.schema
    for f in target.fields if target is not None else []:
        got = kept.schema[f.name].dataType.simpleString() if f.name in kept.columns else "missing"
        specs.append(("silver", f"type:{f.name}", F.lit(got == f.dataType.simpleString()), F.lit(got), f.dataType.simpleString(), ABORT))
    if contract.dedup_keys:
        specs.append(("silver", "dedup_applied", F.col("_dups") == 0, F.col("_dups"), 0, ABORT))
    if not specs:
        return kept.sparkSession.createDataFrame([], CHECK_SCHEMA)
    return checks_from(one, specs)


def bad_samples(quarantine: DataFrame, n: int = 5, reason: str = "_dq_failure_reason", order: Sequence[str] | None = None) -> DataFrame:
    """Q21: up to ``n`` quarantined rows per failure reason, by ``order`` and
    then by a hash of the whole row, so the choice never changes."""
    o = list(order) if order is not None else [c for c in quarantine.columns if c != reason][:3]
    tied = quarantine.withColumn("_tie", row_hash(quarantine))
    return top_n_per_group(tied, [reason], [*o, "_tie"], n).drop("_tie")


# --- Gold ------------------------------------------------------------------


def grain_stats(agg: DataFrame, source: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Q14/Q15 numbers: aggregate rows, distinct key tuples in the source,
    aggregate rows with a null dimension. The source count is a scalar
    subquery, so the plan has no cross join."""
    keys = source.select(F.count_distinct(F.struct(*[F.col(f"`{d}`") for d in dims]))).scalar()
    null_any = None
    for d in dims:
        c = F.col(f"`{d}`").isNull()
        null_any = c if null_any is None else null_any | c
    return agg.agg(
        F.count(F.lit(1)).alias("agg_rows"),
        F.count_if(null_any).alias("null_dims"),
    ).select("agg_rows", keys.alias("keys"), "null_dims")


def check_grain(agg: DataFrame, source: DataFrame, dims: Sequence[str], name: str = "aggregate") -> DataFrame:
    """Q14 + Q15 as check rows: rows = distinct keys (abort), no null dimension (abort)."""
    return checks_from(
        grain_stats(agg, source, dims),
        [
            ("gold", f"{name}:grain", F.col("agg_rows") == F.col("keys"), F.col("agg_rows"), F.col("keys"), ABORT),
            ("gold", f"{name}:null_dimensions", F.col("null_dims") == 0, F.col("null_dims"), 0, ABORT),
        ],
    )


def check_dims(agg: DataFrame, dims: Sequence[str], name: str = "aggregate") -> DataFrame:
    """Q15: no null in any dimension column, per column."""
    one = agg.agg(*[F.count_if(F.col(f"`{d}`").isNull()).alias(d) for d in dims])
    return checks_from(one, [("gold", f"{name}:null_dimension:{d}", F.col(f"`{d}`") == 0, F.col(f"`{d}`"), 0, ABORT) for d in dims])


def check_continuity(gaps: DataFrame, name: str = "aggregate") -> DataFrame:
    """Gold date continuity (W4): report-only check on the number of gaps."""
    one = gaps.agg(F.count(F.lit(1)).alias("n"))
    return checks_from(one, [("gold", f"{name}:date_continuity", F.col("n") == 0, F.col("n"), 0, REPORT)])


def check_comments(spark: SparkSession, table_name: str) -> DataFrame:
    """Q16: every column of a registered table has a comment."""
    cols = spark.catalog.listColumns(table_name)
    rows = [("gold", f"{table_name}:comment:{c.name}", bool(c.description), c.description or "", "non-empty", REPORT) for c in cols]
    return check_rows(spark, rows)


# --- smoke -------------------------------------------------------------------


def smoke(tables: Mapping[str, DataFrame], bounds: Mapping[str, tuple[int, int]]) -> DataFrame:
    """(t, n, ok) — row count of each table inside its [lo, hi]."""
    parts = []
    for name, df in tables.items():
        lo, hi = bounds[name]
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n")).select(
                F.lit(name).alias("t"), "n", F.col("n").between(F.lit(lo), F.lit(hi)).alias("ok")
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def union_checks(*checks: DataFrame) -> DataFrame:
    """All stage check tables in one."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out
