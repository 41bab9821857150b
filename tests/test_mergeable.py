"""States that merge: bitmaps, sketches, fingerprints; listed distributions."""

import random

import pytest
from pyspark.sql import functions as F

from strata.operators import bitmaps as B
from strata.operators import fingerprints as P
from strata.operators import sketches as K
from strata.operators.aggregates import value_distribution


def test_bitmaps_roll_up_exactly_over_batches(spark, tmp_dir):
    rnd = random.Random(1)
    ids = [-5, 0, 1, 32767, 32768, 2**40, None]
    rows = [(rnd.choice("ab"), rnd.randrange(4), rnd.choice(ids + list(range(50)))) for _ in range(500)] + [("only null", 0, None)]
    for i, part in enumerate((rows[:200], rows[200:], rows[200:])):  # the last batch comes twice
        B.append_bitmaps(spark.createDataFrame(part, "g string, day int, id long"), f"{tmp_dir}/b", f"b{min(i, 1)}", ["g", "day"], "id")
    stored = B.stored_bitmaps(spark, f"{tmp_dir}/b")
    df = spark.createDataFrame(rows, "g string, day int, id long")
    for by in (["g", "day"], ["g"], ["day"], []):
        want = df.groupBy(*by).agg(F.count_distinct("id").alias("n"))
        assert sorted(B.distinct_per(stored, by).collect()) == sorted(want.collect())
    with pytest.raises(ValueError, match="whole numbers"):
        B.id_bitmaps(df, ["day"], "g")


def test_bitmaps_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "g string, id int")
    assert B.distinct_per(B.id_bitmaps(empty, ["g"], "id"), ["g"]).collect() == []


def test_merged_profile_is_within_the_stated_error(spark, tmp_dir):
    df = spark.range(20000).select(
        "id", (F.col("id") % 7000).alias("m"), F.when(F.col("id") % 10 != 0, F.concat(F.lit("t"), F.col("id") % 300)).alias("t"),
        F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(-0.0)).otherwise(F.lit(0.0)).alias("f"),
        F.lit(None).cast("int").alias("nothing"),
    )
    for i, part in enumerate((df.where("id < 5000"), df.where("id >= 5000"), df.where("id < 5000"), df.limit(0))):
        K.append_profile(part, f"{tmp_dir}/p", f"b{i % 2 if i < 3 else 9}")
    got = {r["col"]: r for r in K.merged_profile(spark, f"{tmp_dir}/p").collect()}
    assert {c: (r["rows"], r["nulls"]) for c, r in got.items()} == {
        "id": (20000, 0), "m": (20000, 0), "t": (20000, 2000), "f": (20000, 0), "nothing": (20000, 20000)}
    for c, exact in (("id", 20000), ("m", 7000), ("t", 270), ("f", 2), ("nothing", 0)):
        assert abs(got[c]["distinct_estimate"] - exact) <= 4 * K.HLL_RSE * exact
    assert (got["id"]["low"], got["id"]["high"]) == (0.0, 19999.0)
    assert abs(got["id"]["q50"] - 10000) < 400 and abs(got["id"]["q25"] - 5000) < 400
    assert got["f"]["q50"] == 0.0 and got["nothing"]["q50"] is None and got["t"]["first_text"] == "t1"
    listed = {r["col"]: r["listed"] for r in K.low_cardinality(spark, f"{tmp_dir}/p").collect()}
    assert listed == {"id": False, "m": False, "t": False, "f": True, "nothing": True}


def test_distribution_lists_the_columns_left_out(spark):
    df = spark.range(100).select("id", (F.col("id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("none"))
    got = {(r["col"], r["v"]): (r["n"], r["listed"]) for r in value_distribution(df, max_distinct=10).collect()}
    assert got == {("id", None): (None, False), ("even", "true"): (50, True), ("even", "false"): (50, True), ("none", None): (100, True)}
    assert value_distribution(df.select(F.col("id").cast("double"))).count() == 0


def _differences(a, b):
    from collections import Counter

    ca, cb = Counter(a), Counter(b)
    out = {}
    for k in {r[0] for r in [*ca, *cb]}:
        rows = {r for r in [*ca, *cb] if r[0] == k}
        missing, surplus = sum(max(ca[r] - cb[r], 0) for r in rows), sum(max(cb[r] - ca[r], 0) for r in rows)
        if missing or surplus:
            has = any(ca[r] for r in rows)
            unknown = any(cb[r] and not ca[r] for r in rows)
            out[k] = ("lost" if not surplus else "altered" if missing or (has and unknown) else "added" if not has else "doubled", missing, surplus)
    return out


def test_fingerprints_find_exactly_the_differences(spark, tmp_dir):
    rnd = random.Random(2)
    a = [(rnd.randrange(300), rnd.choice([None, "x", "y", ""]), rnd.choice([None, "x", "y", ""])) for _ in range(600)] + [(None, None, None)] * 3
    b = a[5:] + [a[10]] * 2 + [(900, "x", None)]
    b[20] = (b[20][0], "changed", None)
    b[30] = (b[30][0], b[30][2], b[30][1])  # nulls and texts change places
    b.remove((None, None, None))
    rnd.shuffle(b)
    schema = "k int, p string, q string"
    P.write_by_range(spark.createDataFrame(a, schema), f"{tmp_dir}/a", ["k"], 64)
    P.write_by_range(spark.createDataFrame(b, schema).select("q", "k", "p"), f"{tmp_dir}/b", ["k"], 64)
    out = P.reconcile_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", ["k"])
    assert {r["k"]: (r["kind"], r["missing"], r["surplus"]) for r in out.collect()} == _differences(a, b)
    unequal = P.differing_ranges(spark, f"{tmp_dir}/a", f"{tmp_dir}/b").count()
    assert 0 < unequal < 20  # of 64
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("IN (" in line.split("PartitionFilters: ")[1].split("]")[0] for line in scans)


def test_equal_and_empty_tables_read_no_rows(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, p string")
    P.write_by_range(df, f"{tmp_dir}/a", ["k"], 8)
    P.write_by_range(df.orderBy(F.desc("k")), f"{tmp_dir}/b", ["k"], 8)
    assert P.reconcile_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/b", ["k"]).collect() == []
    P.write_by_range(df.distinct(), f"{tmp_dir}/c", ["k"], 8)  # one copy fewer
    assert [tuple(r) for r in P.reconcile_rows(spark, f"{tmp_dir}/a", f"{tmp_dir}/c", ["k"]).collect()] == [(1, "lost", 1, 0)]
    P.write_by_range(df.limit(0), f"{tmp_dir}/e", ["k"], 8)
    got = P.reconcile_rows(spark, f"{tmp_dir}/e", f"{tmp_dir}/a", ["k"]).collect()
    assert sorted(map(tuple, got)) == [(1, "added", 0, 2), (2, "added", 0, 1)]
    with pytest.raises(ValueError, match="ranges"):
        P.write_by_range(df, f"{tmp_dir}/x", ["k"], 0)
