"""Driver query catalogue: inventory operators run over the given tables.

Each entry is ``(spark, sf_dir) -> DataFrame`` built from library
operators (nothing here re-implements an operator); ``ORACLE`` holds the
equivalent DuckDB SQL with identical column names. Nulls, orphans and
bad text the tables do not contain are derived inside the query
(``nullif``, a filtered reference), as the SQL does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.contract import Contract, Rule
from strata.functions.columns import decode
from strata.functions.scalars import basename, json_field, to_bool, to_decimal_br
from strata.operators import aggregates as A
from strata.operators import audits as Q
from strata.operators import windows as W
from strata.operators.dedup import dedup, duplicate_groups
from strata.operators.filters import contains_any
from strata.operators.joins import denormalise, fk_orphans, fk_valid, star
from strata.operators.quality import REASON, classify, outcome_counts

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


LINE_KEYS = ["l_orderkey", "l_linenumber"]
# (l_shipdate, l_partkey, l_suppkey) orders every key group totally, so the
# tie-break hash needs only key and order columns and the scans stay pruned.
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey"]
LINE_TIE = "order"


# --- Silver: dedup and rules ------------------------------------------------


def w1_dedup_kept(spark: SparkSession, d: str) -> DataFrame:
    kept, _ = dedup(table(spark, d, "lineitem"), LINE_KEYS, LINE_ORDER, tie_break=LINE_TIE)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def q3_duplicates(spark: SparkSession, d: str) -> DataFrame:
    _, dups = dedup(table(spark, d, "lineitem"), LINE_KEYS, LINE_ORDER, tie_break=LINE_TIE)
    return dups.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "_dq_failure_reason")


# A third of all line items share one derived key: the hot-key case.


def _hot_keyed_lineitem(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    hk = F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return li.select(hk.cast("long").alias("hk"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


def w1_dedup_hot_key(spark: SparkSession, d: str) -> DataFrame:
    """W1 with one key holding a third of the rows: keep-first."""
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"]
    kept, _ = dedup(_hot_keyed_lineitem(spark, d), ["hk"], order, tie_break="order")
    return kept.select("hk", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def q9_hot_key_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Q9 over the hot-keyed line items: dedup inside the classifier."""
    li = table(spark, d, "lineitem")
    hk = F.when(F.col("l_orderkey") % 3 == 0, F.lit(-1)).otherwise(F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    c = Contract(
        "lineitem_hot",
        dedup_keys=["hk"],
        dedup_order=["l_shipdate", "l_partkey", "l_suppkey", "l_orderkey", "l_linenumber"],
        rules=[Rule.range("l_quantity", "5..45")],
        dedup_tie_break="order",
    )
    return outcome_counts(classify(li.withColumn("hk", hk.cast("long")), c))


def q1_required(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.nullif(F.col("l_linenumber"), F.lit(7)).alias("l_linenumber"))
    flagged = classify(li, Contract("lineitem", required_columns=["l_linenumber"]))
    return outcome_counts(flagged).withColumnRenamed("reason", "outcome")


def q2_coercion(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(
        F.when(F.col("event_id") % 10 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("raw")
    )
    schema = T.StructType([T.StructField("raw", T.IntegerType())])
    flagged = classify(ev, Contract("events", schema=schema))
    return flagged.agg(
        F.count_if(F.col(REASON) == "type_coercion_failed").alias("bad"),
        F.count(F.col("raw")).alias("ok"),
    )


def _kept_counts(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy(F.col(REASON).isNull().alias("kept")).agg(F.count(F.lit(1)).alias("n"))


def q4_range_nullsafe(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select(F.nullif(F.col("l_quantity"), F.lit(10.0)).alias("q"))
    return _kept_counts(classify(li, Contract("lineitem", rules=[Rule.range("q", "5..45")])))


def f3_membership(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderstatus")
    return _kept_counts(classify(o, Contract("orders", rules=[Rule.range("o_orderstatus", "F|O")])))


def q6_custom(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_size")
    return _kept_counts(classify(p, Contract("part", rules=[Rule.custom("p_size", "p_size % 3 = 0", "p_size not divisible by 3")])))


def _solvent_customers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").filter(F.col("c_acctbal") >= 0)


def q5_fk_quarantine(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return fk_orphans(o, "o_custkey", _solvent_customers(spark, d), "c_custkey")


def j2_fk_kept(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return fk_valid(o, "o_custkey", _solvent_customers(spark, d), "c_custkey")


def lineitem_contract(spark: SparkSession, d: str) -> Contract:
    sup = table(spark, d, "supplier").filter(F.col("s_acctbal") >= 0)
    return Contract(
        "lineitem",
        dedup_keys=LINE_KEYS,
        dedup_order=LINE_ORDER,
        rules=[Rule.range("l_quantity", "5..45"), Rule.foreign_key("l_suppkey", sup, "s_suppkey")],
        dedup_tie_break=LINE_TIE,
    )


def q9_outcomes(spark: SparkSession, d: str) -> DataFrame:
    flagged = classify(table(spark, d, "lineitem"), lineitem_contract(spark, d))
    return outcome_counts(flagged)


# --- scalar functions --------------------------------------------------------


def x1_bool_words(spark: SparkSession, d: str) -> DataFrame:
    w = (
        F.when(F.col("l_returnflag") == "R", F.lit("SIM"))
        .when(F.col("l_returnflag") == "A", F.lit("Não"))
        .otherwise(F.lit("talvez"))
    )
    li = table(spark, d, "lineitem").select(to_bool(w).alias("b"))
    return li.groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def x2_comma_decimal(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    raw = F.concat(
        F.floor(k / 1000).cast("string"), F.lit("."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(",50")
    )
    return table(spark, d, "orders").select("o_orderkey", to_decimal_br(raw).cast("double").alias("v"))


def x16_json(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events")
    return ev.groupBy(json_field("props", "$.k", "int").alias("k")).agg(F.count(F.lit(1)).alias("n"))


def x6_basename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", basename("url").alias("base"))


def p9_code_label(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select("o_orderkey", decode("o_orderstatus", {"F": "filled", "O": "open"}, default="unknown").alias("status"))


def f8_contains(spark: SparkSession, d: str) -> DataFrame:
    return contains_any(table(spark, d, "documents"), "text", ["ã", "é"]).select("doc_id")


# --- Gold aggregates --------------------------------------------------------


def a1_by_flag(spark: SparkSession, d: str) -> DataFrame:
    return A.aggregate(
        table(spark, d, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            A.Measure("total", "money_sum", "l_extendedprice"),
            A.Measure("row_count", "count_all"),
            A.Measure("avg_qty", "avg", "l_quantity", digits=6),
            A.Measure("min_qty", "min", "l_quantity"),
            A.Measure("max_qty", "max", "l_quantity"),
        ],
    )


def a2_yearly(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return A.aggregate(
        o,
        [F.year("o_orderdate").alias("yr")],
        [A.Measure("customers", "count_distinct", "o_custkey"), A.Measure("n", "count_all")],
    )


def a5_monthly(spark: SparkSession, d: str) -> DataFrame:
    return A.time_series(table(spark, d, "orders"), "o_orderdate", "month", [A.Measure("n", "count_all")], period="month")


def a6_cohort(spark: SparkSession, d: str) -> DataFrame:
    return A.cohort(table(spark, d, "events"), "user_id", "ts", "day")


def a7_distribution(spark: SparkSession, d: str) -> DataFrame:
    return A.distribution(table(spark, d, "orders"), "o_totalprice", 50000)


def w2_rank(spark: SparkSession, d: str) -> DataFrame:
    per_nation = A.aggregate(table(spark, d, "customer"), ["c_nationkey"], [A.Measure("n", "count_all")])
    return W.rank_all(per_nation, [("n", "desc"), "c_nationkey"], "rank")


def w3_top10(spark: SparkSession, d: str) -> DataFrame:
    tot = A.total(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "total", money=True)
    return W.top_n(tot, [("total", "desc"), "o_custkey"], 10)


def w4_gaps(spark: SparkSession, d: str) -> DataFrame:
    return W.gaps(table(spark, d, "orders"), "o_orderdate")


def j3_denormalise(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    out = star(
        c,
        [
            (table(spark, d, "nation"), "c_nationkey", ["n_name", "n_regionkey"], "n_nationkey"),
            (table(spark, d, "region"), "n_regionkey", ["r_name"], "r_regionkey"),
        ],
    )
    return out.select("c_custkey", "n_name", "r_name")


def j3_partial_fk(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return denormalise(docs, table(spark, d, "labels"), "doc_id", ["quality"])


def j4_fanout(spark: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(table(spark, d, "lineitem"), LINE_KEYS)


def a12_value_dist(spark: SparkSession, d: str) -> DataFrame:
    return A.value_counts(table(spark, d, "documents"), ["lang", "source"], max_distinct=None)


def a10_null_counts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    j = denormalise(docs, table(spark, d, "labels"), "doc_id", ["quality"])
    return A.null_counts(j, ["lang", "quality"])


def r2_reason_share(spark: SparkSession, d: str) -> DataFrame:
    per_type = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return A.pct_of_total(per_type, "n", "pct", 6)


def q14_grain(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    agg = li.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    return Q.grain_stats(agg, li, ["l_returnflag", "l_linestatus"])


def q17_smoke(spark: SparkSession, d: str) -> DataFrame:
    return Q.smoke(
        {"orders": table(spark, d, "orders"), "nation": table(spark, d, "nation")},
        {"orders": (1000, 2_000_000), "nation": (25, 25)},
    )


def w7_union_missing(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type")
    cv = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), "role")
    return W.union_all(ev, cv)


def q21_samples(spark: SparkSession, d: str) -> DataFrame:
    ev = table(spark, d, "events").filter(F.col("value") < 1).select("event_type", "event_id")
    return W.top_n_per_group(ev, ["event_type"], ["event_id"], 3)


def flagship_gold(spark: SparkSession, d: str) -> DataFrame:
    """Bronze lineage -> Silver (dedup, range, FK to orders) -> Gold by flag/status."""
    from strata.plans.stages import flagship

    return flagship(spark, d)


QUERIES: dict[str, Query] = {
    "w1_dedup_kept": w1_dedup_kept,
    "q3_duplicates": q3_duplicates,
    "q1_required": q1_required,
    "q2_coercion": q2_coercion,
    "q4_range_nullsafe": q4_range_nullsafe,
    "f3_membership": f3_membership,
    "q6_custom": q6_custom,
    "q5_fk_quarantine": q5_fk_quarantine,
    "j2_fk_kept": j2_fk_kept,
    "q9_outcomes": q9_outcomes,
    "x1_bool_words": x1_bool_words,
    "x2_comma_decimal": x2_comma_decimal,
    "a1_by_flag": a1_by_flag,
    "a2_yearly": a2_yearly,
    "a5_monthly": a5_monthly,
    "a6_cohort": a6_cohort,
    "a7_distribution": a7_distribution,
    "w2_rank": w2_rank,
    "w3_top10": w3_top10,
    "w4_gaps": w4_gaps,
    "j3_denormalise": j3_denormalise,
    "j3_partial_fk": j3_partial_fk,
    "j4_fanout": j4_fanout,
    "a12_value_dist": a12_value_dist,
    "a10_null_counts": a10_null_counts,
    "x16_json": x16_json,
    "r2_reason_share": r2_reason_share,
    "q14_grain": q14_grain,
    "q17_smoke": q17_smoke,
    "w7_union_missing": w7_union_missing,
    "p9_code_label": p9_code_label,
    "q21_samples": q21_samples,
    "x6_basename": x6_basename,
    "f8_contains": f8_contains,
    "flagship_gold": flagship_gold,
    "w1_dedup_hot_key": w1_dedup_hot_key,
    "q9_hot_key_outcomes": q9_hot_key_outcomes,
}

_HOT = "CASE WHEN l_orderkey%3=0 THEN -1 ELSE l_orderkey*10+l_linenumber END"

ORACLE: dict[str, str] = {
    "w1_dedup_hot_key": f"SELECT CAST({_HOT} AS BIGINT) AS hk,l_orderkey,l_linenumber,l_partkey,l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY {_HOT} ORDER BY l_shipdate,l_partkey,l_suppkey,l_orderkey,l_linenumber)=1",
    "q9_hot_key_outcomes": f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY {_HOT} ORDER BY l_shipdate,l_partkey,l_suppkey,l_orderkey,l_linenumber)>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' ELSE 'kept' END AS reason FROM lineitem) GROUP BY 1",
    "w1_dedup_kept": "SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey)=1",
    "q3_duplicates": "SELECT l_orderkey,l_linenumber,l_partkey,l_suppkey,'duplicate' AS _dq_failure_reason FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey)>1",
    "q1_required": "SELECT CASE WHEN l_linenumber=7 THEN 'required_column_null:l_linenumber' ELSE 'kept' END AS outcome, count(*) AS n FROM lineitem GROUP BY 1",
    "q2_coercion": "SELECT count(*) FILTER (WHERE raw IS NOT NULL AND TRY_CAST(raw AS INT) IS NULL) AS bad, count(TRY_CAST(raw AS INT)) AS ok FROM (SELECT CASE WHEN event_id%10=0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS raw FROM events)",
    "q4_range_nullsafe": "SELECT coalesce(q BETWEEN 5 AND 45, true) AS kept, count(*) AS n FROM (SELECT nullif(l_quantity,10) AS q FROM lineitem) GROUP BY 1",
    "f3_membership": "SELECT o_orderstatus IN ('F','O') AS kept, count(*) AS n FROM orders GROUP BY 1",
    "q6_custom": "SELECT p_size%3=0 AS kept, count(*) AS n FROM part GROUP BY 1",
    "q5_fk_quarantine": "SELECT o_orderkey,o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey=o.o_custkey AND c.c_acctbal>=0)",
    "j2_fk_kept": "SELECT o_orderkey,o_custkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey=o.o_custkey AND c.c_acctbal>=0)",
    "q9_outcomes": "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN rn>1 THEN 'duplicate' WHEN NOT l_quantity BETWEEN 5 AND 45 THEN 'l_quantity failed validation' WHEN hit IS NULL THEN 'l_suppkey not in reference' ELSE 'kept' END AS reason FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn, s.s_suppkey AS hit FROM lineitem l LEFT JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal>=0) s ON l.l_suppkey=s.s_suppkey)) GROUP BY 1",
    "x1_bool_words": "SELECT CASE WHEN lower(w) IN ('yes','true','1','s','sim') THEN true WHEN lower(w) IN ('no','false','0','n','nao','não') THEN false END AS b, count(*) AS n FROM (SELECT CASE l_returnflag WHEN 'R' THEN 'SIM' WHEN 'A' THEN 'Não' ELSE 'talvez' END AS w FROM lineitem) GROUP BY 1",
    "x2_comma_decimal": "SELECT o_orderkey, CAST(TRY_CAST(CASE WHEN contains(r,',') THEN replace(replace(r,'.',''),',','.') ELSE r END AS DECIMAL(18,4)) AS DOUBLE) AS v FROM (SELECT o_orderkey, (o_orderkey//1000)||'.'||lpad(CAST(o_orderkey%1000 AS VARCHAR),3,'0')||',50' AS r FROM orders)",
    "a1_by_flag": "SELECT l_returnflag,l_linestatus,CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total,count(*) AS row_count,round(avg(l_quantity),6) AS avg_qty,min(l_quantity) AS min_qty,max(l_quantity) AS max_qty FROM lineitem GROUP BY 1,2",
    "a2_yearly": "SELECT CAST(year(o_orderdate) AS INT) AS yr,count(DISTINCT o_custkey) AS customers,count(*) AS n FROM orders GROUP BY 1",
    "a5_monthly": "SELECT CAST(date_trunc('month',o_orderdate) AS DATE) AS month,count(*) AS n FROM orders GROUP BY 1",
    "a6_cohort": "SELECT f.c AS cohort,CAST(e.ts AS DATE)-f.c AS day_n,count(DISTINCT e.user_id) AS users FROM events e JOIN (SELECT user_id,min(CAST(ts AS DATE)) AS c FROM events GROUP BY 1) f USING(user_id) GROUP BY 1,2",
    "a7_distribution": "SELECT CAST(floor(o_totalprice/50000) AS BIGINT) AS bucket,count(*) AS n FROM orders GROUP BY 1",
    "w2_rank": "SELECT c_nationkey,n,row_number() OVER (ORDER BY n DESC,c_nationkey) AS rank FROM (SELECT c_nationkey,count(*) AS n FROM customer GROUP BY 1)",
    "w3_top10": "SELECT o_custkey,CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1 ORDER BY 2 DESC,1 LIMIT 10",
    "w4_gaps": "SELECT d AS gap_start,nxt AS gap_end FROM (SELECT d,lead(d) OVER (ORDER BY d) AS nxt FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)) WHERE nxt-d>1",
    "j3_denormalise": "SELECT c.c_custkey,n.n_name,r.r_name FROM customer c LEFT JOIN nation n ON c.c_nationkey=n.n_nationkey LEFT JOIN region r ON n.n_regionkey=r.r_regionkey",
    "j3_partial_fk": "SELECT d.doc_id,l.quality FROM documents d LEFT JOIN labels l ON d.doc_id=l.doc_id",
    "j4_fanout": "SELECT l_orderkey,l_linenumber,count(*) AS n FROM lineitem GROUP BY 1,2 HAVING count(*)>1",
    "a12_value_dist": "SELECT 'lang' AS col,lang AS v,count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source',source,count(*) FROM documents GROUP BY 2",
    "a10_null_counts": "SELECT count(*) AS rows,count(*) FILTER (WHERE lang IS NULL) AS null_lang,count(*) FILTER (WHERE quality IS NULL) AS null_quality FROM documents LEFT JOIN labels USING(doc_id)",
    "x16_json": "SELECT CAST(json_extract_string(props,'$.k') AS INT) AS k,count(*) AS n FROM events GROUP BY 1",
    "r2_reason_share": "SELECT event_type,count(*) AS n,round(100.0*count(*)/sum(count(*)) OVER (),6) AS pct FROM events GROUP BY 1",
    "q14_grain": "SELECT count(*) AS agg_rows,(SELECT count(DISTINCT (l_returnflag,l_linestatus)) FROM lineitem) AS keys,count(*) FILTER (WHERE l_returnflag IS NULL OR l_linestatus IS NULL) AS null_dims FROM (SELECT l_returnflag,l_linestatus FROM lineitem GROUP BY 1,2)",
    "q17_smoke": "SELECT 'orders' AS t,count(*) AS n,count(*) BETWEEN 1000 AND 2000000 AS ok FROM orders UNION ALL SELECT 'nation',count(*),count(*) BETWEEN 25 AND 25 FROM nation",
    "w7_union_missing": "SELECT user_id AS id,event_type,NULL AS role FROM events UNION ALL BY NAME SELECT conv_id AS id,NULL AS event_type,role FROM conversations",
    "p9_code_label": "SELECT o_orderkey,CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' ELSE 'unknown' END AS status FROM orders",
    "q21_samples": "SELECT event_type,event_id FROM events WHERE value<1 QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id)<=3",
    "x6_basename": "SELECT page_id,split_part(url,'/',-1) AS base FROM pages",
    "f8_contains": "SELECT doc_id FROM documents WHERE text LIKE '%ã%' OR text LIKE '%é%'",
    "flagship_gold": "SELECT l_returnflag,l_linestatus,CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price,count(*) AS row_count,round(avg(l_quantity),6) AS avg_qty,min(l_quantity) AS min_qty,max(l_quantity) AS max_qty FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey,l_linenumber ORDER BY l_shipdate,l_partkey,l_suppkey) AS rn FROM lineitem l) x WHERE rn=1 AND l_quantity BETWEEN 5 AND 45 AND EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey=x.l_orderkey) GROUP BY 1,2",
}
