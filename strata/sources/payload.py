"""JSON payload unwrapping (inventory S6, S18, X16, P12).

A payload document becomes rows without leaving the JVM: the text is
parsed to a VARIANT, the record list is picked by shape, and exploded.

Shapes, first match wins:
  * a root array                           -> one row per element
  * an object with a list under ``data``, ``results``, ``items`` or
    ``records`` (in that order; the first key holding a list)   -> its elements
  * any other object                       -> one row
  * a scalar or malformed text             -> one row with an error, no record
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Object keys that may hold the record list, in order.
LIST_KEYS = ("data", "results", "items", "records")

ERROR_COLUMN = "_payload_error"


def payload_records(text: Column) -> tuple[Column, Column]:
    """(array of records as VARIANT or null, error text or null) for a payload."""
    v = F.try_parse_json(text)
    as_obj = F.try_variant_get(v, "$", "map<string,variant>")
    arr = F.coalesce(
        F.try_variant_get(v, "$", "array<variant>"),
        *[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in LIST_KEYS],
        F.when(as_obj.isNotNull(), F.array(v)),
    )
    err = F.when(v.isNull() & text.isNotNull(), F.lit("malformed_json")).when(
        arr.isNull(), F.lit("unexpected_shape")
    )
    return arr, err


def explode_payload(df: DataFrame, column: str, record: str = "record") -> DataFrame:
    """One row per record; ``record`` is the record as JSON text.

    Error rows (scalar root, malformed text) are kept with a null record
    and ``_payload_error`` set, so Silver can quarantine them; an empty
    list yields no rows.
    """
    arr, err = payload_records(F.col(column))
    staged = df.withColumns({"_arr": arr, ERROR_COLUMN: err})
    items = F.when(F.col("_arr").isNull(), F.array(F.lit(None).cast("variant"))).otherwise(F.col("_arr"))
    out = staged.select(*[c for c in df.columns if c != column], F.explode(items).alias("_rec"), ERROR_COLUMN)
    return out.select(
        *[c for c in out.columns if c not in ("_rec", ERROR_COLUMN)],
        F.to_json(F.col("_rec")).alias(record),
        ERROR_COLUMN,
    )


def records_as_columns(df: DataFrame, record: str, schema: T.StructType | str) -> DataFrame:
    """Lift a JSON record column into typed top-level columns."""
    parsed = F.from_json(F.col(record), schema)
    staged = df.withColumn("_parsed", parsed)
    st = staged.schema["_parsed"].dataType
    assert isinstance(st, T.StructType)
    return staged.select(
        *[c for c in df.columns if c != record], *[F.col(f"_parsed.`{f.name}`").alias(f.name) for f in st.fields]
    )
