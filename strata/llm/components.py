"""Connected components of a graph given as an edge table.

Alternating large-star and small-star rounds (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Every round is two joins of
the edges with one row per node (null-safe, so the aggregate's side gets an
exchange of its own and a node with very many neighbours is split by the
skew-join rule), and the edge count never grows. Each round
is cut by ``checkpoint()``; only one count and one sum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (a, b) with b < a in every row."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("m", "a").alias("m"))
        out = both.join(low, F.col("a").eqNullSafe(F.col("n"))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        low = edges.groupBy("a").agg(F.min("b").alias("m"))
        hop = edges.join(low.withColumnRenamed("a", "n"), F.col("a").eqNullSafe(F.col("n")))
        out = hop.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            low.select("a", F.col("m").alias("b"))
        )
    return out.where("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
    return int(row["n"]), int(row["s"] or 0)


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of an edge; root is the component's least node.

    Nodes without an edge to another node get no row; null ends and
    self-loops are ignored. Raises if ``max_rounds`` do not suffice, which
    needs a path of about 2**max_rounds nodes.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct().checkpoint()
    before = _state(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        e = _star(_star(e, large=True), large=False).checkpoint()
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
