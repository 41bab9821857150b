"""Single-pass Silver classification (inventory Q1-Q12).

``classify`` returns one *flagged* frame: every input row exactly once,
with ``_dq_failure_reason`` null for kept rows and the first failed rule
otherwise. ``split`` derives kept and quarantined frames from it. There
is one shuffle for deduplication and one (normally broadcast) join per
foreign key, however many rules the contract has.

Rule order (first failure wins): type coercion, required columns,
duplicate, range, foreign key, custom. Coercion and required failures
leave before duplicates are ranked, so a rejected row never shadows a
good duplicate; range/FK/custom rules apply after ranking, as the Silver
layer prescribes (dedup first, then rules).
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.contract import REASON_COERCION, REASON_DUPLICATE, Contract, Rule
from strata.functions.columns import LINEAGE_COLUMNS, coerce, rename_present, strict_select
from strata.operators.dedup import default_order, flag_first
from strata.operators.joins import lookup_hit
from strata.operators.skew import null_safe_on

# Quarantine metadata columns.
REASON = "_dq_failure_reason"
VALUE = "_dq_failure_value"
CHECK_TIME = "_dq_check_time"
DQ_COLUMNS = (REASON, VALUE, CHECK_TIME)
SOURCE_PREFIX = "__src_"


@dataclass
class _Failure:
    cond: Column
    reason: Column
    value: Column


def _fail(cond: Column, reason: str | Column, value: Column | None) -> _Failure:
    r = F.lit(reason) if isinstance(reason, str) else reason
    v = value.cast("string") if value is not None else F.lit(None).cast("string")
    return _Failure(cond, r, v)


def _first(failures: list[_Failure]) -> Column:
    """Struct(reason, value) of the first failing rule, null when all pass."""
    if not failures:
        return F.lit(None).cast("struct<r:string,v:string>")
    branches = [F.when(f.cond, F.struct(f.reason.alias("r"), f.value.alias("v"))) for f in failures]
    return F.coalesce(*branches) if len(branches) > 1 else branches[0]


def classify(
    df: DataFrame,
    contract: Contract,
    *,
    check_time: _dt.datetime | None = None,
    seen_keys: DataFrame | None = None,
    first_flag: str | None = None,
    clustered: bool = False,
) -> DataFrame:
    """Q9: flag every row with its first failure (or null when kept).

    ``seen_keys`` (dedup-key columns) lists keys already ranked first by
    earlier runs or stream epochs; rows with such a key are duplicates
    too (T3). ``first_flag`` names an output column holding whether the
    row was its key's first (what a later epoch must treat as seen).
    ``clustered``: the input lies bucketed by the dedup keys (see
    ``flag_first``). Rows with a null dedup key fail as required columns
    do, before any ranking.
    """
    d = rename_present(df, contract.rename)
    if contract.schema is not None:
        # columns beyond the schema go (``unexpected_columns`` reports them),
        # but for lineage and the keys that rules and dedup name; missing ones
        # become nulls, which then fail where they are required
        used = {*LINEAGE_COLUMNS, *contract.dedup_keys, *(o if isinstance(o, str) else o[0] for o in contract.dedup_order or [])}
        used |= {r.column for r in contract.all_rules()}
        d, _ = strict_select(d, contract.schema, [c for c in d.columns if c in used])
        d = coerce(d, contract.schema, contract.coercers, keep_source=True, source_prefix=SOURCE_PREFIX)
    src_cols = [c for c in d.columns if c.startswith(SOURCE_PREFIX)]
    q = lambda c: F.col(f"`{c}`")

    # Q2 then Q1: failures known before ranking.
    pre: list[_Failure] = []
    for s in src_cols:
        name = s[len(SOURCE_PREFIX):]
        pre.append(_fail(q(s).isNotNull() & q(name).isNull(), REASON_COERCION, q(s)))
    rules = contract.all_rules()
    needed = [r for r in rules if r.kind == "required"]
    if not contract.dedup_before_required:
        named = {r.column for r in needed}
        needed = [Rule.required(k) for k in contract.dedup_keys if k not in named] + needed
    for r in needed:
        pre.append(_fail(q(r.column).isNull(), r.message or "", None))

    d = d.withColumn("_pre", _first(pre))

    # Q3: keep-first among rows still alive.
    post: list[_Failure] = []
    if contract.dedup_keys:
        alive = None if contract.dedup_before_required else F.col("_pre").isNull()
        order = default_order(d) if contract.dedup_order is None else contract.dedup_order
        d = flag_first(
            d, contract.dedup_keys, order, alive=alive, out="_is_first", tie_break=contract.dedup_tie_break, clustered=clustered
        )
        if seen_keys is not None:
            d = _mark_seen(d, seen_keys, contract.dedup_keys)
        key_text = F.concat_ws("|", *[q(k).cast("string") for k in contract.dedup_keys])
        post.append(_fail(~F.coalesce(F.col("_is_first"), F.lit(True)), REASON_DUPLICATE, key_text))

    # Q4 range, Q5 foreign key, Q6 custom — in that order.
    for r in rules:
        if r.kind == "range":
            post.append(_fail(~r.predicate(), r.message or "", q(r.column)))
    for i, r in enumerate(r for r in rules if r.kind == "foreign_key"):
        hit = f"_fk_hit{i}"
        assert r.reference is not None
        d = lookup_hit(d, r.column, r.reference, r.reference_column or r.column, hit)
        miss = ~F.col(hit)
        if r.allow_null:
            miss = miss & q(r.column).isNotNull()
        post.append(_fail(miss, r.message or "", q(r.column)))
    for r in rules:
        if r.kind == "custom":
            post.append(_fail(~r.predicate(), r.message or "", q(r.column)))

    outcome = F.coalesce(F.col("_pre"), _first(post)) if post else F.col("_pre")
    ts = F.lit(check_time).cast("timestamp") if check_time is not None else F.current_timestamp()
    helper = {"_pre", "_is_first"} | {c for c in d.columns if c.startswith("_fk_hit")} | set(src_cols)
    keep = [q(c) for c in d.columns if c not in helper]
    extra = []
    if first_flag:
        flag = F.coalesce(F.col("_is_first"), F.lit(False)) if "_is_first" in d.columns else F.col("_pre").isNull()
        extra.append(flag.alias(first_flag))
    return d.select(
        *keep,
        outcome.getField("r").alias(REASON),
        outcome.getField("v").alias(VALUE),
        ts.alias(CHECK_TIME),
        *extra,
    )


def living_keys(df: DataFrame, contract: Contract, earliest: str | None = None) -> DataFrame:
    """The distinct dedup keys of the rows that take part in the ranking:
    those that pass coercion and required rules (all, if duplicates are
    ranked first). ``earliest`` names a column whose least value comes along."""
    first = [] if contract.dedup_before_required else [r for r in contract.all_rules() if r.kind == "required"]
    named = {r.column for r in first}
    first = [Rule.required(k) for k in contract.dedup_keys if k not in named] + first
    early = replace(contract, dedup_keys=[], dedup_order=None, required_columns=[], rules=first)
    keys = [F.col(f"`{k}`") for k in contract.dedup_keys]
    ranked = classify(df, early)
    alive = F.lit(True) if contract.dedup_before_required else F.col(REASON).isNull()
    if earliest is not None:
        return ranked.where(alive).groupBy(*keys).agg(F.min(F.col(f"`{earliest}`")).alias(earliest))
    return ranked.where(alive).select(*keys).distinct()


def unexpected_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Q7 report: columns (after renaming) that the contract doesn't know."""
    if contract.schema is None:
        return []
    known = {*contract.schema.fieldNames(), *LINEAGE_COLUMNS}
    return [c for c in rename_present(df, contract.rename).columns if c not in known]


def _mark_seen(d: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Turn ``_is_first`` false for rows whose key is in ``seen`` (distinct
    after a partial aggregate; null-safe)."""
    sk = seen.select(*[F.col(f"`{k}`").alias(f"_sk{i}") for i, k in enumerate(keys)]).distinct().withColumn("_seen", F.lit(True))
    on = null_safe_on([(d[f"`{k}`"], sk[f"_sk{i}"]) for i, k in enumerate(keys)])
    j = d.join(sk, on, "left").drop(*[f"_sk{i}" for i in range(len(keys))])
    first = F.when(F.col("_is_first").isNotNull(), F.col("_is_first") & F.col("_seen").isNull())
    return j.withColumn("_is_first", first).drop("_seen")


def split(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, quarantined) from a flagged frame. Kept rows lose the DQ columns."""
    kept = flagged.filter(F.col(REASON).isNull()).drop(*DQ_COLUMNS)
    quarantined = flagged.filter(F.col(REASON).isNotNull())
    return kept, quarantined


def outcome_counts(flagged: DataFrame, kept_label: str = "kept") -> DataFrame:
    """Rows per outcome (``kept`` or the failure reason)."""
    return (
        flagged.groupBy(F.coalesce(F.col(REASON), F.lit(kept_label)).alias("reason"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def check_conservation(flagged: DataFrame, n_in: int | None = None, source: DataFrame | None = None) -> DataFrame:
    """Q11: one aggregate giving kept, quarantined and total; ``ok`` when
    kept + quarantined equals the input count."""
    agg = flagged.agg(
        F.count_if(F.col(REASON).isNull()).alias("kept"),
        F.count_if(F.col(REASON).isNotNull()).alias("quarantined"),
        F.count(F.lit(1)).alias("total"),
    )
    if n_in is None and source is not None:
        n_in = source.count()
    if n_in is None:
        return agg.withColumn("ok", F.col("kept") + F.col("quarantined") == F.col("total"))
    return agg.withColumn("input_rows", F.lit(n_in).cast("long")).withColumn(
        "ok", (F.col("kept") + F.col("quarantined") == F.lit(n_in)) & (F.col("total") == F.lit(n_in))
    )
