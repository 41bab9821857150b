"""The data contract: schema, keys and ordered rules (inventory F1-F5, Q1-Q7).

A ``Contract`` is plain data. ``strata.operators.quality.classify`` turns it
into one flagged DataFrame; nothing here touches data.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Failure reasons written to ``_dq_failure_reason``.
REASON_COERCION = "type_coercion_failed"
REASON_REQUIRED = "required_column_null:{col}"
REASON_DUPLICATE = "duplicate"
DEFAULT_RANGE_MESSAGE = "{col} failed validation"
DEFAULT_FK_MESSAGE = "{col} not in reference"

_NUM = re.compile(r"^-?\d+(\.\d+)?$")


def _sql_literal(v: str) -> str:
    v = v.strip()
    if _NUM.match(v):
        return v
    return "'" + v.replace("'", "''") + "'"


def _text_literal(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _quote(col: str) -> str:
    return "`" + col.replace("`", "``") + "`"


def parse_range(col: str, spec: str) -> str:
    """short range text to a SQL predicate.

    ``"1900..2100"`` -> ``col BETWEEN 1900 AND 2100``; ``"..100"`` and
    ``"5.."`` are open-ended; ``"a|b|c"`` -> ``col IN ('a','b','c')``.
    Anything else is taken as a SQL predicate already.
    """
    s = spec.strip()
    q = _quote(col)
    parts = [p.strip() for p in s.split("..")] if s.count("..") == 1 and "|" not in s else None
    if parts and (parts[0] or parts[1]) and not re.search(r"[\s()=<>']", parts[0] + parts[1]):
        lo, hi = parts
        if lo and hi:
            return f"{q} BETWEEN {_sql_literal(lo)} AND {_sql_literal(hi)}"
        if lo:
            return f"{q} >= {_sql_literal(lo)}"
        return f"{q} <= {_sql_literal(hi)}"
    if "|" in s and not re.search(r"[()=<>]|\bIN\b|\bOR\b", s, re.IGNORECASE):
        # members are text ("01" stays "01"); Spark casts them for numeric columns
        vals = ", ".join(_text_literal(v.strip()) for v in s.split("|"))
        return f"{q} IN ({vals})"
    return s


@dataclass(frozen=True)
class Rule:
    """One row-level check.

    ``kind`` is one of ``required``, ``range``, ``custom``, ``foreign_key``.
    Range and custom rules are SQL predicates; a null result passes (CHECK
    semantics), because nulls are the business of ``required`` rules.
    """

    kind: str
    column: str
    expr: str | None = None
    message: str | None = None
    reference: DataFrame | None = field(default=None, compare=False)
    reference_column: str | None = None
    allow_null: bool = False

    @staticmethod
    def required(column: str) -> "Rule":
        return Rule("required", column, message=REASON_REQUIRED.format(col=column))

    @staticmethod
    def range(column: str, spec: str, message: str | None = None) -> "Rule":
        return Rule(
            "range", column, parse_range(column, spec), message or DEFAULT_RANGE_MESSAGE.format(col=column)
        )

    @staticmethod
    def isin(column: str, values: Iterable[object], message: str | None = None) -> "Rule":
        vals = ", ".join(str(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else _text_literal(str(v)) for v in values)
        return Rule("range", column, f"{_quote(column)} IN ({vals})", message or DEFAULT_RANGE_MESSAGE.format(col=column))

    @staticmethod
    def custom(column: str, expr: str, message: str | None = None) -> "Rule":
        return Rule("custom", column, expr, message or DEFAULT_RANGE_MESSAGE.format(col=column))

    @staticmethod
    def foreign_key(
        column: str,
        reference: DataFrame,
        reference_column: str | None = None,
        message: str | None = None,
        allow_null: bool = False,
    ) -> "Rule":
        return Rule(
            "foreign_key",
            column,
            message=message or DEFAULT_FK_MESSAGE.format(col=column),
            reference=reference,
            reference_column=reference_column or column,
            allow_null=allow_null,
        )

    def predicate(self) -> Column:
        """Null-safe pass condition for range/custom rules."""
        assert self.expr is not None
        return F.coalesce(F.expr(self.expr), F.lit(True))


@dataclass
class Contract:
    """Silver data contract for one dataset.

    ``schema`` is the target (coerced) schema; ``coercers`` overrides the
    cast per column; ``rename`` maps source to target names before casting.
    ``dedup_order`` lists order columns for keep-first (by default the
    ingestion date, where there is one; oldest first); a deterministic row hash breaks remaining ties.
    """

    slug: str
    schema: T.StructType | None = None
    primary_keys: list[str] = field(default_factory=list)
    dedup_keys: list[str] = field(default_factory=list)
    dedup_order: list[Column | str] | None = None
    required_columns: list[str] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    rename: dict[str, str] = field(default_factory=dict)
    coercers: dict[str, Callable[[Column], Column]] = field(default_factory=dict)
    dedup_before_required: bool = False
    # "row": whole-row hash breaks ties (stable choice between runs);
    # "order": key + order columns only (no extra columns scanned)
    dedup_tie_break: str | list[str] = "row"

    @property
    def table_name(self) -> str:
        """Slug as a SQL identifier (hyphens are not valid there)."""
        return re.sub(r"[^0-9A-Za-z_]", "_", self.slug)

    def all_rules(self) -> list[Rule]:
        req = [Rule.required(c) for c in self.required_columns]
        return req + [r for r in self.rules if r.kind != "required"] + [
            r for r in self.rules if r.kind == "required" and r.column not in self.required_columns
        ]

    def validate(self, spark: SparkSession) -> None:
        """Analyse every rule expression against the target schema.

        A bad expression fails here, before any data is read.
        """
        if self.schema is None:
            return
        empty = spark.createDataFrame([], self.schema)
        for r in self.rules:
            if r.expr is not None:
                try:
                    empty.select(F.expr(r.expr)).schema
                except Exception as e:  # analysis error
                    raise ValueError(f"rule on {r.column!r} does not analyse: {r.expr!r}: {e}") from e
            if r.column not in self.schema.fieldNames():
                raise ValueError(f"rule column {r.column!r} is not in the target schema")
        for c in list(self.dedup_keys) + list(self.required_columns) + list(self.primary_keys):
            if c not in self.schema.fieldNames():
                raise ValueError(f"key column {c!r} is not in the target schema")

    @staticmethod
    def from_yaml(
        text_or_path: str,
        schema: T.StructType | None = None,
        references: Mapping[str, DataFrame] | None = None,
    ) -> "Contract":
        """Build from a YAML contract (file path or YAML text); see ``from_dict``."""
        import os

        import yaml  # PyYAML

        text = open(text_or_path, encoding="utf-8").read() if os.path.exists(text_or_path) else text_or_path
        return Contract.from_dict(yaml.safe_load(text), schema, references)

    @staticmethod
    def from_dict(
        spec: Mapping[str, object],
        schema: T.StructType | None = None,
        references: Mapping[str, DataFrame] | None = None,
    ) -> "Contract":
        """Build from the YAML shape: slug, primary_keys, dedup_keys,
        required_columns, value_ranges {col: spec}, foreign_keys {col: ref},
        custom_rules [{column, expr, message}].

        ``references`` resolves a foreign-key target (a path or name) to a
        DataFrame; the caller loads reference tables.
        """
        ds = spec.get("dataset", spec)  # type: ignore[assignment]
        assert isinstance(ds, Mapping)
        rules: list[Rule] = []
        for col, rng in dict(ds.get("value_ranges") or {}).items():
            if isinstance(rng, Mapping):
                rules.append(Rule.range(col, str(rng["expr"]), rng.get("message")))
            else:
                rules.append(Rule.range(col, str(rng)))
        refs = dict(references or {})
        for col, target in dict(ds.get("foreign_keys") or {}).items():
            if isinstance(target, Mapping):
                ref = refs[target["table"]]
                rules.append(
                    Rule.foreign_key(col, ref, target.get("column"), target.get("message"), bool(target.get("allow_null", False)))
                )
            else:
                rules.append(Rule.foreign_key(col, refs[str(target)]))
        for cr in list(ds.get("custom_rules") or []):
            rules.append(Rule.custom(cr["column"], cr["expr"], cr.get("message")))
        return Contract(
            slug=str(ds.get("slug", "dataset")),
            schema=schema,
            primary_keys=list(ds.get("primary_keys") or []),
            dedup_keys=list(ds.get("dedup_keys") or ds.get("primary_keys") or []),
            required_columns=list(ds.get("required_columns") or []),
            rules=rules,
            rename=dict(ds.get("rename") or {}),
        )
