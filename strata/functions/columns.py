"""Column shaping (inventory P1-P13).

Each helper builds a single ``select``/``withColumns`` so Catalyst sees one
projection, not a stack of ``withColumn`` calls.
"""

from __future__ import annotations

import datetime as _dt
import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.scalars import safe_cast

# Lineage column names carried from Bronze through Silver.
LINEAGE_COLUMNS = ("ingestion_date", "source_file", "batch_id")


def with_lineage(
    df: DataFrame,
    batch_id: str,
    ingestion_date: _dt.date | str | None = None,
    source_file: Column | str | None = None,
) -> DataFrame:
    """Add ``ingestion_date`` (date), ``source_file`` and ``batch_id``.

    ``source_file`` defaults to the per-row full file path from the scan's
    ``_metadata`` column, so multi-file loads keep the real file per row.
    ``ingestion_date`` is a ``DateType`` literal fixed on the driver.
    """
    if ingestion_date is None:
        date_col = F.current_date()
    else:
        date_col = F.lit(str(ingestion_date)).cast("date")
    if source_file is None and "source_file" in df.columns:
        src = F.col("source_file")
    elif source_file is None:
        src = F.col("_metadata.file_path") if resolves(df, "_metadata.file_path") else F.lit(None).cast("string")
    elif isinstance(source_file, str):
        src = F.lit(source_file)
    else:
        src = source_file
    return df.withColumns(
        {"ingestion_date": date_col, "source_file": src, "batch_id": F.lit(batch_id)}
    )


def resolves(df: DataFrame, *names: str) -> bool:
    """Whether ``df`` can still reach these (hidden) columns; analysis only."""
    import logging

    log = logging.getLogger("DataFrameQueryContextLogger")  # reports the expected failure as an error
    level = log.level
    log.setLevel(logging.CRITICAL)
    try:
        df.select(*names).schema  # noqa: B018
        return True
    except AnalysisException:
        return False
    finally:
        log.setLevel(level)


def rename_present(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename columns by a map; names absent from the frame are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def snake_name(name: str) -> str:
    """Trim, lower-case, and turn spaces and hyphens into underscores."""
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def snake_case(df: DataFrame) -> DataFrame:
    """snake_case every column name; fail when two names collide."""
    new = [snake_name(c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, n in zip(df.columns, new):
        if n in seen:
            raise ValueError(f"snake_case collision: {seen[n]!r} and {old!r} both become {n!r}")
        seen[n] = old
    return df.toDF(*new)


def coerce(
    df: DataFrame,
    schema: T.StructType,
    coercers: Mapping[str, Callable[[Column], Column]] | None = None,
    keep_source: bool = False,
    source_prefix: str = "__src_",
) -> DataFrame:
    """Cast every target column in one projection.

    Uses ``try_cast`` semantics (bad text -> null). ``coercers`` overrides
    the cast for named columns (e.g. ``to_bool``, ``to_decimal_br``).
    Columns missing from the input become typed nulls. With
    ``keep_source`` the uncast value is kept as ``__src_<name>`` (string)
    beside each column whose cast can fail, for coercion checks (Q2).
    Columns not in the target schema are kept at the end (see
    ``strict_select`` to drop them).
    """
    coercers = dict(coercers or {})
    cols: list[Column] = []
    sources: list[Column] = []
    for f in schema.fields:
        if f.name in df.columns:
            src = F.col(f.name)
            same = df.schema[f.name].dataType == f.dataType and f.name not in coercers
            if f.name in coercers:
                out = coercers[f.name](src)
            elif same:
                out = src
            else:
                out = safe_cast(src, f.dataType)
            cols.append(out.cast(f.dataType).alias(f.name) if not same else src)
            if keep_source and not same:
                sources.append(src.cast("string").alias(source_prefix + f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    names = set(schema.fieldNames())
    extra = [F.col(c) for c in df.columns if c not in names]
    return df.select(*cols, *extra, *sources)


def strict_select(df: DataFrame, schema: T.StructType, keep: Iterable[str] = ()) -> tuple[DataFrame, list[str]]:
    """P5: keep only target columns (plus ``keep``); return the dropped names."""
    wanted = list(schema.fieldNames()) + [c for c in keep if c not in schema.fieldNames()]
    dropped = [c for c in df.columns if c not in wanted]
    present = [c for c in wanted if c in df.columns]
    return df.select(*present), dropped


def missing_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Target columns absent from the frame (Q7)."""
    return [f.name for f in schema.fields if f.name not in df.columns]


def fill_missing(df: DataFrame, schema: T.StructType) -> tuple[DataFrame, list[str]]:
    """Add typed nulls for missing target columns; report which were added.

    A missing column that is required then fails Q1 on every row, which is
    the quarantine the contract asks for; nullable ones are simply filled.
    """
    missing = missing_columns(df, schema)
    if not missing:
        return df, []
    types = {f.name: f.dataType for f in schema.fields}
    return df.withColumns({m: F.lit(None).cast(types[m]) for m in missing}), missing


def coalesce_drift(df: DataFrame, target: str, pattern: str) -> DataFrame:
    """One column from drifting names (``CO_ESCOLA``, ``CO_ESCOLA_EDUCACENSO_2021``).

    Every column whose name fully matches ``pattern`` (a regex) is
    coalesced, in frame order, into ``target``; the candidates are dropped.
    """
    rx = re.compile(pattern)
    cands = [c for c in df.columns if rx.fullmatch(c)]
    if not cands:
        return df.withColumn(target, F.lit(None).cast("string"))
    merged = F.coalesce(*[F.col(c).cast("string") for c in cands]) if len(cands) > 1 else F.col(cands[0])
    rest = [c for c in df.columns if c not in cands]
    return df.select(*rest, merged.alias(target))


def subset(df: DataFrame, keep: Iterable[str] | None = None, drop: Iterable[str] | None = None) -> DataFrame:
    """Column subset by keep list or drop list."""
    if keep is not None:
        return df.select(*[c for c in keep])
    return df.drop(*(drop or []))


def decode(c: Column | str, labels: Mapping[object, str], default: str | None = None) -> Column:
    """Code -> label through a literal map (no join; the map is in the plan)."""
    col = F.col(c) if isinstance(c, str) else c
    pairs: list[Column] = []
    for k, v in labels.items():
        pairs += [F.lit(k), F.lit(v)]
    looked = F.try_element_at(F.create_map(*pairs), col) if pairs else F.lit(None).cast("string")
    return F.coalesce(looked, F.lit(default)) if default is not None else looked


def stamp(df: DataFrame, column: str = "last_updated") -> DataFrame:
    """P10: ``last_updated`` stamp for aggregate tables."""
    return df.withColumn(column, F.current_timestamp())


def drop_empty(df: DataFrame, ignore: Iterable[str] = LINEAGE_COLUMNS) -> DataFrame:
    """Drop rows whose data columns are all null or blank text."""
    data = [c for c in df.columns if c not in set(ignore)]
    if not data:
        return df
    empty = [
        (F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")) for c in data
    ]
    all_empty = empty[0]
    for e in empty[1:]:
        all_empty = all_empty & e
    return df.filter(~all_empty)


def flatten(df: DataFrame, column: str, schema: T.StructType | str, prefix: str = "", explode_arrays: bool = False) -> DataFrame:
    """Parse a JSON text column and lift its fields to top-level columns."""
    parsed = F.from_json(F.col(column), schema)
    tmp = "__flat"
    out = df.withColumn(tmp, parsed).drop(column)
    st = out.schema[tmp].dataType
    if explode_arrays and isinstance(st, T.ArrayType):
        out = out.withColumn(tmp, F.explode_outer(tmp))
        st = out.schema[tmp].dataType
    if isinstance(st, T.StructType):
        fields = [F.col(f"{tmp}.`{f.name}`").alias(prefix + f.name) for f in st.fields]
        return out.select(*[c for c in out.columns if c != tmp], *fields)
    return out.withColumnRenamed(tmp, column)
