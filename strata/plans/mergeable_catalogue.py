"""Driver keys for stored states that merge: bitmaps, sketches, fingerprints,
and for the guarded join. Each derives its stored tables from a whole given
table, in batches where merging is the point."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import bitmaps as B
from strata.operators import fingerprints as P
from strata.operators import sketches as K
from strata.operators.aggregates import value_distribution
from strata.operators.joins import check_unique, checked_denormalise
from strata.plans.catalogue import table
from strata.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def a6_bitmap_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Distinct customers per month and per year from one table of
    daily bitmaps, stored in a batch per order status."""
    out = scratch_dir(spark, "a6bits")
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    for r in o.select("o_orderstatus").distinct().collect():  # a few statuses
        B.append_bitmaps(o.where(F.col("o_orderstatus").eqNullSafe(r[0])), out, f"s{r[0]}", ["day"], "o_custkey")
    daily = B.stored_bitmaps(spark, out)
    month = B.distinct_per(daily, [F.date_format("day", "yyyy-MM").alias("period")], "customers")
    year = B.distinct_per(daily, [F.date_format("day", "yyyy").alias("period")], "customers")
    return month.unionByName(year)


def r5_merged_profile(spark: SparkSession, d: str) -> DataFrame:
    """The profile of orders merged from the profiles of three
    batches; estimates are held against exact counts of the whole table."""
    out = scratch_dir(spark, "r5profile")
    o = table(spark, d, "orders")
    batch = F.pmod(F.xxhash64("o_orderkey"), F.lit(3))
    for i in range(3):
        K.append_profile(o.where(batch == i), out, f"b{i}")
    m = K.merged_profile(spark, out)
    exact = o.agg(*[F.count_distinct(f"`{c}`").alias(c) for c in o.columns]).unpivot([], o.columns, "col", "exact")
    mid = {r["col"]: r["q50"] for r in m.where("q50 IS NOT NULL").select("col", "q50").collect()}  # one number a column
    share = o.agg(*[F.struct(F.avg((F.col(c) < q).cast("int")).alias("below"), F.avg((F.col(c) <= q).cast("int")).alias("upto")).alias(c) for c, q in mid.items()])
    ranks = share.unpivot([], list(mid), "col", "at")
    j = m.join(exact, "col").join(ranks, "col", "left")
    near = F.abs(F.col("distinct_estimate") - F.col("exact")) <= F.greatest(F.lit(1.0), 4 * K.HLL_RSE * F.col("exact"))
    median = F.coalesce((F.col("at.below") <= 0.52) & (F.col("at.upto") >= 0.48), F.lit(True))
    text = F.col("col").isin("o_orderstatus", "o_orderpriority")
    return j.select(
        "col", "rows", "nulls", "low", "high",
        F.when(text, F.col("first_text")).alias("first_text"), F.when(text, F.col("last_text")).alias("last_text"),
        near.alias("distinct_near"), median.alias("median_near"),
    )


def a12_with_skipped(spark: SparkSession, d: str) -> DataFrame:
    """Value distribution of orders, the columns left out listed in it."""
    return value_distribution(table(spark, d, "orders")).select("col", "v", "n", "listed")


def w9_fingerprint_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lost, doubled, altered and added rows between lineitem and a
    copy with a few planted changes, found by range fingerprints."""
    src, out = scratch_dir(spark, "w9src"), scratch_dir(spark, "w9out")
    li = table(spark, d, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    pick = F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") % 1000)
    copy = li.where(F.coalesce(pick != 1, F.lit(True)))
    copy = copy.withColumn("l_quantity", F.when(pick == 3, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")))
    copy = copy.unionByName(li.where(pick == 2)).unionByName(li.where(pick == 4).withColumn("l_linenumber", F.lit(-1)))
    P.write_by_range(li, src, keys, 32)
    P.write_by_range(copy, out, keys, 32)
    return P.reconcile_rows(spark, src, out, keys)


def j4_checked_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their customers through the guarded join; ``refused``
    says that the same join on a repeated key raises."""
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    c = table(spark, d, "customer")
    try:
        checked_denormalise(c, o, "c_custkey", ["o_orderkey"])
        refused = False
    except ValueError:
        refused = True
    joined = checked_denormalise(o, c, "c_custkey", ["c_name", "c_mktsegment"])
    return joined.select("o_orderkey", "c_custkey", "c_name", "c_mktsegment", F.lit(refused).alias("refused"))


def j4_repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    """Customers that would fan out a join of orders."""
    return check_unique(table(spark, d, "orders"), ["o_custkey"])


QUERIES: dict[str, Query] = {
    "a6_bitmap_rollup": a6_bitmap_rollup,
    "a12_with_skipped": a12_with_skipped,
    "j4_checked_join": j4_checked_join,
    "j4_repeated_keys": j4_repeated_keys,
    "r5_merged_profile": r5_merged_profile,
    "w9_fingerprint_rows": w9_fingerprint_rows,
}

_ORDER_TEXT = " UNION ALL ".join(
    f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS v, count(*) AS n, true AS listed FROM orders GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority")
)
_ORDER_SKIPPED = " UNION ALL ".join(f"SELECT '{c}', NULL, NULL, false" for c in ("o_orderkey", "o_custkey"))


def _profile_sql(c: str, number: bool, text: bool) -> str:
    low, high = (f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)") if number else ("NULL", "NULL")
    first, last = (f"min({c})", f"max({c})") if text else ("NULL", "NULL")
    return (
        f"SELECT '{c}' AS col, count(*) AS rows, count(*) FILTER ({c} IS NULL) AS nulls, {low} AS low, {high} AS high,"
        f" {first} AS first_text, {last} AS last_text, true AS distinct_near, true AS median_near FROM orders"
    )


ORACLE: dict[str, str] = {
    "a6_bitmap_rollup": "SELECT strftime(o_orderdate,'%Y-%m') AS period,count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1 UNION ALL SELECT strftime(o_orderdate,'%Y'),count(DISTINCT o_custkey) FROM orders GROUP BY 1",
    "a12_with_skipped": f"{_ORDER_TEXT} UNION ALL {_ORDER_SKIPPED}",
    "j4_checked_join": "SELECT o_orderkey,o_custkey AS c_custkey,c_name,c_mktsegment,true AS refused FROM orders LEFT JOIN customer ON o_custkey=c_custkey",
    "j4_repeated_keys": "SELECT o_custkey,count(*) AS n FROM orders GROUP BY 1 HAVING count(*)>1",
    "r5_merged_profile": " UNION ALL ".join(
        _profile_sql(c, c in ("o_orderkey", "o_custkey", "o_totalprice"), c in ("o_orderstatus", "o_orderpriority"))
        for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    ),
    "w9_fingerprint_rows": """WITH s AS (SELECT *, CASE WHEN l_linenumber=1 THEN l_orderkey%1000 END AS pick FROM lineitem),
        o AS (SELECT * REPLACE (CASE WHEN pick=3 THEN l_quantity+1 ELSE l_quantity END AS l_quantity) FROM s WHERE pick IS DISTINCT FROM 1
            UNION ALL SELECT * FROM s WHERE pick=2
            UNION ALL SELECT * REPLACE (-1 AS l_linenumber) FROM s WHERE pick=4),
        c AS (SELECT * EXCLUDE (pick), 1 AS ns, 0 AS no FROM s UNION ALL SELECT * EXCLUDE (pick), 0, 1 FROM o),
        r AS (SELECT * EXCLUDE (ns, no), sum(ns) AS ns, sum(no) AS no FROM c GROUP BY ALL),
        k AS (SELECT l_orderkey, l_linenumber, CAST(sum(greatest(ns-no,0)) AS BIGINT) AS missing, CAST(sum(greatest(no-ns,0)) AS BIGINT) AS surplus,
            sum(ns) AS ns, sum(CASE WHEN ns=0 THEN no ELSE 0 END) AS unknown FROM r GROUP BY 1,2)
        SELECT l_orderkey, l_linenumber, CASE WHEN surplus=0 THEN 'lost' WHEN missing=0 AND ns=0 THEN 'added'
            WHEN missing=0 AND unknown=0 THEN 'doubled' ELSE 'altered' END AS kind, missing, surplus FROM k WHERE missing>0 OR surplus>0""",
}
