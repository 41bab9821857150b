"""Gold aggregates and profile measures (inventory A1-A15).

Every aggregate is a ``groupBy().agg()`` so Spark plans a partial
(map-side) aggregate before the shuffle: a hot group collapses to one row
per map task before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.functions.scalars import trunc_date

# measure kind -> builder(column) ; "money_sum" sums exactly as DECIMAL(18,2)
_MEASURES = {
    "sum": lambda c: F.sum(c),
    "money_sum": lambda c: F.sum(c.cast(T.DecimalType(18, 2))).cast("double"),
    "count": lambda c: F.count(c),
    "count_all": lambda c: F.count(F.lit(1)),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "approx_count_distinct": lambda c: F.approx_count_distinct(c),
}


@dataclass(frozen=True)
class Measure:
    """One output column: ``alias = kind(column)``, optionally rounded."""

    alias: str
    kind: str
    column: str | None = None
    digits: int | None = None

    def build(self) -> Column:
        if self.kind not in _MEASURES:
            raise ValueError(f"unknown measure kind {self.kind!r}")
        c = F.col(f"`{self.column}`") if self.column else F.lit(1)
        out = _MEASURES[self.kind](c)
        if self.digits is not None:
            out = F.round(out, self.digits)
        return out.alias(self.alias)


@dataclass
class Aggregate:
    """Gold aggregate definition (name, grain, measures, use case) for R3."""

    name: str
    dims: list[str]
    measures: list[Measure]
    use_case: str = ""
    description: str = field(default="")

    def build(self, df: DataFrame) -> DataFrame:
        return aggregate(df, self.dims, self.measures)


def aggregate(df: DataFrame, dims: Sequence[str | Column], measures: Sequence[Measure | Column]) -> DataFrame:
    """A1/A2: group by dimensions with sum/count/avg/min/max/distinct measures."""
    ms = [m.build() if isinstance(m, Measure) else m for m in measures]
    return df.groupBy(*dims).agg(*ms)


def total(df: DataFrame, dims: Sequence[str], column: str, alias: str = "total", money: bool = False) -> DataFrame:
    """A3: group total of a column."""
    return aggregate(df, dims, [Measure(alias, "money_sum" if money else "sum", column)])


def average(df: DataFrame, dims: Sequence[str], column: str, alias: str = "average", digits: int | None = None) -> DataFrame:
    """A4: average of a column by dimensions."""
    return aggregate(df, dims, [Measure(alias, "avg", column, digits)])


def time_series(
    df: DataFrame,
    ts: str,
    grain: str,
    measures: Sequence[Measure | Column],
    dims: Sequence[str] = (),
    period: str = "period",
) -> DataFrame:
    """A5: measures by truncated date (and optional dimensions)."""
    return df.groupBy(trunc_date(ts, grain).alias(period), *dims).agg(
        *[m.build() if isinstance(m, Measure) else m for m in measures]
    )


def cohort(
    df: DataFrame,
    entity: str,
    ts: str,
    grain: str = "day",
    cohort_col: str = "cohort",
    offset_col: str = "day_n",
    count_col: str = "users",
) -> DataFrame:
    """Entities active ``offset`` periods after their first period.

    Rows are first reduced to distinct (entity, period) pairs by a partial
    aggregate, so an entity with a huge share of rows collapses map-side;
    after that each entity has at most one row per period, and the first
    period is a window over that bounded set. The result counts distinct
    entities per (cohort, offset) as plain row counts.
    """
    if grain not in ("day", "week", "month", "quarter", "year"):
        raise ValueError(f"cohort grain {grain!r}: periods are days, weeks, months, quarters or years")
    period = trunc_date(ts, grain) if grain != "day" else F.to_date(F.col(ts))
    pairs = df.select(F.col(entity).alias("_e"), period.alias("_p")).where(F.col("_e").isNotNull() & F.col("_p").isNotNull()).distinct()
    first = pairs.withColumn("_c", F.min("_p").over(Window.partitionBy("_e")))
    if grain in ("day", "week"):
        off = F.datediff(F.col("_p"), F.col("_c"))
        if grain == "week":
            off = F.floor(off / 7)
    elif grain == "month":
        off = F.floor(F.months_between(F.col("_p"), F.col("_c")))
    elif grain == "quarter":
        off = (F.year("_p") - F.year("_c")) * 4 + F.quarter("_p") - F.quarter("_c")
    else:
        off = F.year("_p") - F.year("_c")
    return (
        first.groupBy(F.col("_c").alias(cohort_col), off.cast("bigint").alias(offset_col))
        .agg(F.count(F.lit(1)).alias(count_col))
    )


def distribution(df: DataFrame, column: str, width: float, bucket: str = "bucket", count_col: str = "n") -> DataFrame:
    """Counts per fixed-width bucket ``floor(x / width)``."""
    return df.groupBy(F.floor(F.col(column) / F.lit(width)).cast("bigint").alias(bucket)).agg(
        F.count(F.lit(1)).alias(count_col)
    )


def counts(df: DataFrame, distinct: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Total rows and distinct counts of chosen columns in one aggregate."""
    fn = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(F.count(F.lit(1)).alias("rows"), *[fn(F.col(c)).alias(f"distinct_{c}") for c in distinct])


def reason_counts(quarantine: DataFrame, reason: str = "_dq_failure_reason") -> DataFrame:
    """Quarantined rows per failure reason."""
    return quarantine.groupBy(F.col(reason).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A10: one row: total and null count of every column (one scan)."""
    cols = list(columns) if columns is not None else df.columns
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{c}") for c in cols],
    )


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Distinct count per column; approximate (HyperLogLog++) by default."""
    cols = list(columns) if columns is not None else df.columns
    fn = F.count_distinct if exact else F.approx_count_distinct
    return df.agg(*[fn(F.col(f"`{c}`")).alias(f"distinct_{c}") for c in cols])


def _countable(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is not None:
        return list(columns)
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.StringType, T.BooleanType, T.IntegralType, T.DateType))]


def skipped_columns(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 50) -> DataFrame:
    """(col, distinct_approx) of the columns that ``value_counts`` leaves out."""
    cols = _countable(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "col string, distinct_approx long")
    one = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in cols])
    return one.unpivot([], [F.col(f"`{c}`") for c in cols], "col", "distinct_approx").where(F.col("distinct_approx") > max_distinct)


def value_counts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    max_distinct: int | None = 50,
) -> DataFrame:
    """(column, value, n) for low-cardinality columns.

    Columns above ``max_distinct`` (approximate distinct count, one scan)
    are left out; ``skipped_columns`` lists them with their counts. Pass
    ``columns`` and ``max_distinct=None`` to choose columns directly. Values are unpivoted as text and counted by a partial
    aggregate.
    """
    cols = _countable(df, columns)
    if max_distinct is not None and cols:
        row = distinct_counts(df, cols).first()
        assert row is not None
        cols = [c for c in cols if row[f"distinct_{c}"] <= max_distinct]
    if not cols:
        schema = "col string, v string, n long"
        return df.sparkSession.createDataFrame([], schema)
    long = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in cols]).unpivot([], cols, "col", "v")
    return long.groupBy("col", "v").agg(F.count(F.lit(1)).alias("n"))


def value_distribution(df: DataFrame, columns: Sequence[str] | None = None, max_distinct: int = 50) -> DataFrame:
    """A12, nothing left out in silence: (col, v, n, listed, distinct_approx).

    Columns of up to ``max_distinct`` values (approximate count) have a row per
    value with its count; each other column has one row with ``listed`` false
    and null ``v`` and ``n``. One scan finds the columns, one counts.
    """
    cols = _countable(df, columns)
    if not cols:
        return df.sparkSession.createDataFrame([], "col string, v string, n long, listed boolean, distinct_approx long")
    row = distinct_counts(df, cols).first()
    assert row is not None
    found = [(c, int(row[f"distinct_{c}"])) for c in cols]
    approx = df.sparkSession.createDataFrame(found, "col string, distinct_approx long")
    counts = value_counts(df, [c for c, k in found if k <= max_distinct], None)
    listed = F.col("distinct_approx") <= max_distinct
    return approx.join(counts, "col", "left").select("col", "v", "n", listed.alias("listed"), "distinct_approx")


def summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, nulls, min, max, mean, stddev per numeric column, one scan.

    Returns one row per column: (column, count, nulls, min, max, mean, stddev).
    """
    cols = list(columns) if columns is not None else [
        f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)
    ]
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, count long, nulls long, min double, max double, mean double, stddev double")
    stats = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        stats.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(x).alias("count"),
                F.count_if(x.isNull()).alias("nulls"),
                F.min(x).alias("min"),
                F.max(x).alias("max"),
                F.avg(x).alias("mean"),
                F.stddev(x).alias("stddev"),
            ).alias(f"s{len(stats)}")
        )
    one = df.agg(*stats)
    return one.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(len(cols))])).alias("s")).select("s.*")


def cast_failures(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Per target column, values present in the source that fail the cast.

    One aggregate: for every column whose type changes, count rows where
    the source is not null and ``try_cast`` gives null.
    """
    from strata.functions.scalars import safe_cast

    aggs = []
    for f in schema.fields:
        if f.name not in df.columns or df.schema[f.name].dataType == f.dataType:
            continue
        src = F.col(f"`{f.name}`")
        aggs.append(F.count_if(src.isNotNull() & safe_cast(src, f.dataType).isNull()).alias(f.name))
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, failures long")
    wide = df.agg(*aggs)
    return wide.unpivot([], wide.columns, "column", "failures")


def pct_of_total(df: DataFrame, column: str, alias: str = "pct", digits: int = 6) -> DataFrame:
    """X15 over an aggregated frame: ``100 * x / sum(x)``.

    The total is a scalar subquery (one small aggregate, computed once),
    so no window collects the frame into one partition.
    """
    tot = df.select(F.sum(F.col(column))).scalar()
    return df.withColumn(alias, F.round(F.lit(100.0) * F.col(column) / tot, digits))
