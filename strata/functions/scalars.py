"""Scalar column functions (inventory X1-X17).

All of them return ``Column`` expressions built from ``pyspark.sql.functions``
so they stay inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words a Silver boolean column accepts (compared after
# lower-casing and trimming). Anything else becomes null.
TRUE_WORDS = ("yes", "true", "1", "s", "sim")
FALSE_WORDS = ("no", "false", "0", "n", "nao", "não")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_bool(c: Column | str) -> Column:
    """yes/no words to boolean, case-insensitive; unknown words -> null."""
    w = F.lower(F.trim(_col(c).cast("string")))
    return (
        F.when(w.isin(*TRUE_WORDS), F.lit(True))
        .when(w.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def to_decimal_br(c: Column | str, precision: int = 18, scale: int = 4) -> Column:
    """Comma-decimal text ("1.234,56") to ``DecimalType(p, s)``.

    When the text holds a comma, dots are thousands separators and are
    removed before the comma becomes the decimal point; text without a
    comma ("10.5") is cast as it is. Unparseable text gives null.
    """
    s = F.trim(_col(c).cast("string"))
    normal = F.when(
        s.contains(","), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    ).otherwise(s)
    return normal.try_cast(T.DecimalType(precision, scale))


def safe_cast(c: Column | str, dtype: T.DataType | str, fmt: str | None = None) -> Column:
    """Cast that yields null instead of failing (ANSI mode is on in Spark 4).

    ``fmt`` applies to date and timestamp targets (``try_to_date`` /
    ``try_to_timestamp`` patterns).
    """
    col = _col(c)
    if isinstance(dtype, str):
        dtype = T._parse_datatype_string(dtype)
    if fmt is not None and isinstance(dtype, T.DateType):
        return F.try_to_date(col.cast("string"), fmt)
    if fmt is not None and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.try_to_timestamp(col.cast("string"), F.lit(fmt)).cast(dtype)
    if isinstance(dtype, T.BooleanType):
        return to_bool(col)
    return col.try_cast(dtype)


def basename(c: Column | str) -> Column:
    """Last path (or URL) segment after the final '/'."""
    return F.element_at(F.split(_col(c), "/"), -1)


def new_batch_id() -> str:
    """One batch id per run, made on the driver (not one per row)."""
    return str(uuid.uuid4())


def run_timestamp() -> _dt.datetime:
    """X8 companion: one check time per run, fixed on the driver (UTC, naive)."""
    return _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None, microsecond=0)


_GRAINS = {"year", "quarter", "month", "week", "day", "hour", "minute", "second"}


def trunc_date(c: Column | str, grain: str, as_date: bool = True) -> Column:
    """Truncate to a calendar grain; returns a date (or timestamp_ntz)."""
    grain = grain.lower()
    if grain not in _GRAINS:
        raise ValueError(f"unknown grain {grain!r}; expected one of {sorted(_GRAINS)}")
    t = F.date_trunc(grain, _col(c))
    return t.cast("date") if as_date else t.cast("timestamp_ntz")


def to_utc(c: Column | str, fmt: str | None = None) -> Column:
    """ISO-8601 text (with or without offset) to a UTC timestamp; bad text -> null.

    The session time zone is pinned to UTC by ``strata.session``.
    """
    s = _col(c).cast("string")
    return F.try_to_timestamp(s, F.lit(fmt)) if fmt else F.try_to_timestamp(s)


def pct(c: Column | str, total: Column, digits: int = 6) -> Column:
    """Percent of ``total``, e.g. a scalar subquery of the sum
    (``strata.operators.aggregates.pct_of_total`` builds it)."""
    return F.round(F.lit(100.0) * _col(c) / total, digits)


def json_field(c: Column | str, path: str, dtype: T.DataType | str = "string") -> Column:
    """One field of a JSON text column, safely cast."""
    raw = F.get_json_object(_col(c), path)
    return raw if dtype in ("string", T.StringType()) else raw.try_cast(dtype)


def keeps_leading_zeros(c: Column | str, width: int) -> Column:
    """True when an identifier is text of the given width (zero padded)."""
    col = _col(c).cast("string")
    return (F.length(col) == width) & col.rlike("^[0-9]+$")


def is_digits(c: Column | str) -> Column:
    """Non-empty text made only of digits."""
    return _col(c).cast("string").rlike("^[0-9]+$")
