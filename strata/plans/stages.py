"""Stage compositions: Bronze -> Silver -> Gold as lazy DataFrame plans.

The functions here only compose library operators. Writing is left to
``strata.sinks`` so callers choose where (and whether) to materialise.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Observation
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.functions.columns import with_lineage
from strata.functions.scalars import run_timestamp
from strata.operators import audits as Q
from strata.operators import report as R
from strata.operators.aggregates import Aggregate, Measure
from strata.operators.quality import REASON, classify, split, unexpected_columns
from strata.sinks import layout as K
from strata.sources.dialect import Dialect
from strata.sources.files import list_files, new_files, read_csv


def bronze(df: DataFrame, batch_id: str, ingestion_date: _dt.date | str | None = None) -> DataFrame:
    """Bronze: the source rows untouched, plus lineage columns."""
    return with_lineage(df, batch_id, ingestion_date)


def silver(
    bronze_df: DataFrame,
    contract: Contract,
    *,
    check_time: _dt.datetime | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Silver: (flagged, kept, quarantined) from one classification plan."""
    flagged = classify(bronze_df, contract, check_time=check_time)
    kept, quarantined = split(flagged)
    return flagged, kept, quarantined


def gold(kept: DataFrame, aggregates: list[Aggregate]) -> Mapping[str, DataFrame]:
    """Gold: one DataFrame per aggregate definition."""
    return {a.name: a.build(kept) for a in aggregates}


# The flagship: line items through every layer.
LINE_GOLD = Aggregate(
    name="by_flag_status",
    dims=["l_returnflag", "l_linestatus"],
    measures=[
        Measure("total_price", "money_sum", "l_extendedprice"),
        Measure("row_count", "count_all"),
        Measure("avg_qty", "avg", "l_quantity", digits=6),
        Measure("min_qty", "min", "l_quantity"),
        Measure("max_qty", "max", "l_quantity"),
    ],
    use_case="revenue and volume by return flag and line status",
)


def flagship(spark: SparkSession, sf_dir: str, batch_id: str = "flagship") -> DataFrame:
    """lineitem -> lineage -> dedup (l_orderkey, l_linenumber) -> quantity range
    -> FK to orders -> Gold by (l_returnflag, l_linestatus)."""
    d = sf_dir.rstrip("/")
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    orders = spark.read.parquet(f"{d}/orders.parquet")
    b = bronze(li, batch_id, "2024-01-01")
    contract = Contract(
        "lineitem",
        dedup_keys=["l_orderkey", "l_linenumber"],
        dedup_order=["ingestion_date", "l_shipdate", "l_partkey", "l_suppkey"],
        rules=[
            Rule.range("l_quantity", "5..45"),
            Rule.foreign_key("l_orderkey", orders, "o_orderkey", "l_orderkey not in orders"),
        ],
        dedup_tie_break="order",
    )
    _, kept, _ = silver(b, contract)
    return LINE_GOLD.build(kept.select(*[c for c in kept.columns if c not in ("source_file",)]))


# --- materialised stage runs -------------------------------------------------------
#
# Each run writes its layer once and derives checks and reports from what
# was stored, never from re-running the upstream plan.


@dataclass
class StageRun:
    """Paths written by a stage run, and its check table."""

    paths: dict[str, str]
    checks: DataFrame
    info: dict[str, object] = field(default_factory=dict)


def run_bronze(
    spark: SparkSession,
    source: str,
    root: str,
    dialect: Dialect = Dialect(),
    *,
    schema: T.StructType | None = None,
    batch_id: str | None = None,
    ingestion_date: _dt.date | str | None = None,
    listing: DataFrame | None = None,
) -> StageRun:
    """Bronze: new files only (manifest), lineage, append by date, audit.

    ``listing`` takes the files to consider from elsewhere, such as
    ``walk_files``, which also lists empty files (``no_empty_files`` can
    find them only then: Spark's own listing leaves them out); ``source`` is
    not listed then. The paths of the new files are held on the driver.

    Rows read are counted by an ``Observation`` on the write itself, so
    the source is scanned once.
    """
    bronze_path, manifest_path = f"{root}/bronze", f"{root}/manifest"
    if listing is None:
        listing = list_files(spark, source)
    if K.path_exists(spark, manifest_path):
        todo = new_files(listing, spark.read.parquet(manifest_path))
    else:
        todo = listing
    # one row per new file, as Spark's own listing of the read holds on the driver
    listed = todo.select("path", "length", "modificationTime", "source_path").orderBy("path").collect()
    names = [r["path"] for r in listed]
    todo_rows = spark.createDataFrame(
        [tuple(r) for r in listed], "path string, length bigint, modificationTime timestamp, source_path string"
    )
    if batch_id is None:
        # derived from the files, so a run repeated after a failure reuses
        # its batch id and replaces its own partition (write_bronze by_batch)
        import hashlib

        digest = hashlib.sha1("|".join(f"{r['path']}:{r['length']}:{r['modificationTime']}" for r in listed).encode()).hexdigest()
        batch_id = f"b-{digest[:16]}"
    if not names:
        empty = Q.union_checks(Q.check_rows(spark, [("bronze", "new_files", True, 0, ">= 0", Q.REPORT)]))
        return StageRun({"bronze": bronze_path, "manifest": manifest_path}, empty, {"rows": 0, "files": 0})
    df = read_csv(spark, names, dialect, schema, source_column="source_file")
    obs = Observation("bronze_rows")
    if ingestion_date is None:
        # a batch that was stored before keeps its date, so a retry after
        # midnight replaces the batch instead of adding it a second time
        ingestion_date = _stored_date(spark, bronze_path, batch_id) or run_timestamp().date()
    b = bronze(df, batch_id, ingestion_date).observe(obs, F.count(F.lit(1)).alias("rows"))
    K.write_bronze(b, bronze_path, by_batch=True)
    rows_in = int(obs.get["rows"])
    stored = spark.read.parquet(bronze_path).filter(F.col("batch_id") == batch_id)
    K.append_manifest(stored, manifest_path, listing=todo_rows, batch_id=batch_id, ingestion_date=str(ingestion_date))
    empty_files = [r["path"] for r in listed if r["length"] == 0]
    checks = Q.union_checks(
        Q.audit_bronze(stored, input_rows=rows_in, path=bronze_path, source_bytes=sum(r["length"] for r in listed)),
        Q.check_rows(spark, [("bronze", "no_empty_files", not empty_files, len(empty_files), 0, Q.ABORT)]),
    )
    return StageRun({"bronze": bronze_path, "manifest": manifest_path}, checks, {"rows": rows_in, "files": len(names), "batch_id": batch_id})


def _stored_date(spark: SparkSession, bronze_path: str, batch_id: str) -> str | None:
    """The ingestion date under which a batch is stored, from its folder."""
    for name in K.list_dir(spark, bronze_path):
        if name.startswith("ingestion_date=") and K.path_exists(spark, f"{bronze_path}/{name}/batch_id={batch_id}"):
            return name.split("=", 1)[1]
    return None


def run_silver(
    spark: SparkSession,
    bronze_path: str,
    contract: Contract,
    root: str,
    *,
    check_time: _dt.datetime | None = None,
) -> StageRun:
    """Silver: classify once, rebuild Silver from the kept rows and append the
    quarantined ones; checks are computed over the stored tables."""
    check_time = check_time or run_timestamp()
    source = spark.read.parquet(bronze_path)
    flagged = classify(source, contract, check_time=check_time)
    run = f"{contract.table_name}-{check_time.strftime('%Y%m%dT%H%M%S%f')}"
    silver_path, quarantine_path = f"{root}/silver", f"{root}/quarantine"
    # classified once, kept on the executors' disks, and each row written once,
    # to the table it belongs to; the writes count their rows themselves
    flagged = flagged.persist(StorageLevel.DISK_ONLY)
    try:
        counted = {name: Observation(f"silver_{name}") for name in ("kept", "quarantined")}
        kept, quarantined = (
            part.observe(o, F.count(F.lit(1)).alias("rows")) for part, o in zip(split(flagged), counted.values())
        )
        K.write_silver(kept, silver_path)
        K.append_quarantine(quarantined, quarantine_path, run=run)
        rows = {name: int(o.get["rows"]) for name, o in counted.items()}
    finally:
        flagged.unpersist()
    rows_in = source.count()  # from the stored files' footers
    stored_kept = spark.read.parquet(silver_path)
    # by the partition columns, so earlier runs' files are not read
    day = check_time.date().isoformat()
    this_run = spark.read.parquet(quarantine_path).filter((F.col("_dq_check_date") == F.lit(day).cast("date")) & (F.col("_dq_run") == run))
    total = rows["kept"] + rows["quarantined"]
    rates = Q.null_rates(stored_kept.select(*[c for c in stored_kept.columns if c in (contract.schema.fieldNames() if contract.schema else stored_kept.columns)]), key_columns=contract.primary_keys)
    rate_rows = [
        ("silver", f"null_rate:{r['column']}", bool(r["ok"]), round(r["null_rate"], 6), r["limit"], Q.REPORT) for r in rates.collect()
    ]  # one row per column
    extra = unexpected_columns(source, contract)
    rate_rows.append(("silver", "expected_columns_only", not extra, ",".join(extra), "", Q.REPORT))
    checks = Q.union_checks(
        Q.check_rows(spark, [("silver", "kept_plus_quarantined_equals_bronze", total == rows_in, total, rows_in, Q.ABORT)]),
        Q.audit_silver(stored_kept, contract),
        Q.check_rows(spark, rate_rows),
    )
    return StageRun(
        {"silver": silver_path, "quarantine": quarantine_path},
        checks,
        {**rows, "check_time": check_time, "quarantine_this_run": this_run, "unexpected_columns": extra},
    )


def run_gold(
    spark: SparkSession,
    silver_path: str,
    aggregates: list[Aggregate],
    root: str,
    *,
    stamp: bool = True,
    zorder: dict[str, list[str]] | None = None,
    register_prefix: str | None = None,
    comments: dict[str, str] | None = None,
    continuity: dict[str, str] | None = None,
) -> StageRun:
    """Gold: one table per aggregate, stamped ``last_updated``; optionally
    Z-ordered (``zorder``: name -> 1-4 columns), registered as external
    tables ``<register_prefix><name>`` with a comment on every column.
    Grain and null-dimension checks (and comment checks) read the stored
    tables."""
    from strata.functions.columns import stamp as add_stamp

    silver_df = spark.read.parquet(silver_path)
    built = {a.name: (add_stamp(a.build(silver_df)) if stamp else a.build(silver_df)) for a in aggregates}
    zorder = zorder or {}
    plain = {n: df for n, df in built.items() if n not in zorder}
    paths = K.write_gold(plain, root)
    for name, cols in zorder.items():
        paths[name] = f"{root.rstrip('/')}/{name}"
        K.zorder_write(built[name], paths[name], cols)
    checks = [Q.check_grain(spark.read.parquet(paths[a.name]), silver_df, a.dims, a.name) for a in aggregates]
    from strata.operators.windows import gaps

    for name, date_col in (continuity or {}).items():
        # date continuity is reported, never aborts
        checks.append(Q.check_continuity(gaps(spark.read.parquet(paths[name]), date_col), name))
    if register_prefix is not None:
        for a in aggregates:
            table = f"{register_prefix}{a.name}"
            K.register(spark, table, paths[a.name])
            K.comment_columns(spark, table, comments or {})
            checks.append(Q.check_comments(spark, table))
    return StageRun(paths, Q.union_checks(*checks))


def run_report(spark: SparkSession, bronze_run: StageRun, silver_run: StageRun, gold_run: StageRun, aggregates: list[Aggregate]) -> dict[str, DataFrame]:
    """Report tables (R1-R7) over what the stages stored."""
    outputs = {
        "bronze": ("bronze", spark.read.parquet(bronze_run.paths["bronze"])),
        "silver": ("silver", spark.read.parquet(silver_run.paths["silver"])),
        "quarantine": ("silver", spark.read.parquet(silver_run.paths["quarantine"])),
    }
    outputs.update({name: ("gold", spark.read.parquet(p)) for name, p in gold_run.paths.items()})
    this_run = silver_run.info["quarantine_this_run"]
    assert isinstance(this_run, DataFrame)
    return {
        "run_summary": R.run_summary(outputs),
        "failure_reasons": R.failure_reasons(this_run),
        "aggregate_catalog": R.aggregate_catalog(spark, aggregates),
        "batches": R.batch_metadata(spark.read.parquet(bronze_run.paths["manifest"])),
        **{f"bronze_profile_{k}": v for k, v in R.profile_tables(spark.read.parquet(bronze_run.paths["bronze"])).items()},
        "audits": R.audit_table(bronze_run.checks, silver_run.checks, gold_run.checks),
        "storage": R.storage(spark, {k: v for k, v in {**bronze_run.paths, **silver_run.paths, **gold_run.paths}.items() if k != "manifest"}),
        "bad_samples": Q.bad_samples(this_run, 5, order=[c for c in this_run.columns if c not in (REASON,)][:2]),
    }
