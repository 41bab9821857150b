"""Incremental keep-first against ranking all rows at once."""

import random

from pyspark.sql import functions as F

from strata.operators.dedup import dedup
from strata.operators.incremental import judge_batch, merge_first, winners
from tests.conftest import SF0001

ROWS = "k string, d int, v int"


def test_batches_equal_a_full_rebuild(spark, tmp_dir):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", f"k{rnd.randrange(30)}"]), rnd.randrange(9), i) for i in range(400)]
    rows += rows[:7]  # exact copies, also across batches
    parts = [rows[:150], rows[150:160], [], rows[160:]]
    table = "strata_first_test"
    for e, part in enumerate(parts):
        for _ in range(2 if e == 1 else 1):  # one batch is delivered twice
            merge_first(spark.createDataFrame(part, ROWS), f"b{e}", table, f"{tmp_dir}/w", f"{tmp_dir}/q", ["k"], ["d"], f"{tmp_dir}/s{e}")
    kept, dups = dedup(spark.createDataFrame(rows, ROWS), ["k"], ["d"])
    got = winners(spark, table, ["k"], ["d"])
    assert sorted(got.collect()) == sorted(kept.select("k", "d", "v").collect())
    lost = spark.read.parquet(f"{tmp_dir}/q").select("k", "d", "v")
    assert sorted(lost.collect()) == sorted(dups.select("k", "d", "v").collect())
    assert spark.table(table).where("_merge_batch = 'b1'").count() <= 10  # replaced, not doubled
    spark.sql(f"DROP TABLE {table}")


def _leaves(plan):
    """(scan line, shuffled) per file scan: is there an exchange between it and the join?"""
    depth, out, path = 0, [], []
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-|*"))
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, line))
        if "FileScan" in line:
            names = [text for _, text in path]
            join = max(k for k, text in enumerate(names) if "Join" in text)
            out.append((line, any("Exchange hashpartitioning" in text for text in names[join:])))
    return out


def test_stored_rows_are_not_shuffled(spark, tmp_dir):
    li = spark.read.parquet(f"{SF0001}/lineitem.parquet")
    keys, order = ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"]
    table = "strata_first_plan"
    merge_first(li.where("l_partkey % 2 = 0"), "b0", table, f"{tmp_dir}/w", f"{tmp_dir}/q", keys, order, f"{tmp_dir}/s")
    li.where("l_partkey % 2 = 1").write.parquet(f"{tmp_dir}/b1")
    # no size decides for a broadcast here
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = judge_batch(spark.read.parquet(f"{tmp_dir}/b1"), keys, order, spark.table(table))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    scans = [(line, shuffled) for line, shuffled in _leaves(plan) if "Bucketed: true" in line]
    assert scans and not any(shuffled for _, shuffled in scans), plan
    spark.sql(f"DROP TABLE {table}")


def test_batch_is_ranked_and_shuffled_once(spark, tmp_dir, monkeypatch):
    from strata.operators import incremental as I

    plans = []
    real = I._judge_ranked

    def noted(flagged, *args):
        plans.append(flagged._jdf.queryExecution().executedPlan().toString())
        return real(flagged, *args)

    monkeypatch.setattr(I, "_judge_ranked", noted)
    table = "strata_first_once"
    for e, part in enumerate([[("a", 1, 1), ("b", 2, 2)], [("a", 0, 3), ("a", 5, 4), ("c", 1, 5)]]):
        merge_first(spark.createDataFrame(part, ROWS), f"b{e}", table, f"{tmp_dir}/w", f"{tmp_dir}/q", ["k"], ["d"], f"{tmp_dir}/s{e}")
    # with stored rows, first and later rows of the batch come from one stored ranking
    assert "FileScan" in plans[-1] and "Exchange" not in plans[-1]
    assert sorted(winners(spark, table, ["k"], ["d"]).collect()) == [("a", 0, 3), ("b", 2, 2), ("c", 1, 5)]
    assert sorted(r["v"] for r in spark.read.parquet(f"{tmp_dir}/q").collect()) == [1, 4]
    spark.sql(f"DROP TABLE {table}")


def test_join_to_the_winners_carries_no_order_or_hash(spark, tmp_dir):
    from strata.operators.dedup import flag_first

    spark.createDataFrame([("a", 1, 1), ("a", 1, 2), ("b", 0, 3)], ROWS).write.parquet(f"{tmp_dir}/t")
    df = flag_first(spark.read.parquet(f"{tmp_dir}/t"), ["k"], ["d"])
    joined = next(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "_win" in line and "Aggregate" in line)
    assert "min(" in joined and "._orid AS _win" in joined
    assert sorted(r["k"] for r in df.where("_is_first").collect()) == ["a", "b"]
