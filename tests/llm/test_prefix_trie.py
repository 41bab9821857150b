"""Conversation prefix trie against plain prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from strata.llm.prefix_trie import Shard, TrieOptions, Tst, encoded, median_order, rebuilt, trie_nodes

CONVS = "conv_id bigint, turn bigint, role string, text string"


def turns_of(rows):
    """conv_id -> its (role, text) in order."""
    out = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            tie = hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest()
            out.setdefault(c, []).append((t is not None, t or 0, tie, r, x))
    return {c: [v[3:] for v in sorted(own)] for c, own in out.items()}


def rebuild(own):
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + seq[h:]
    return out


def brute(convs):
    members = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        childless = [q for q in below if not any(len(x) == len(q) + 1 and x[:-1] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in sorted(own) if len(convs[c]) == len(p))
        parent = min(members[p[:-1]]) if p else None
        kids = sum(len(q) == len(p) + 1 for q in below)
        out.append((min(own), len(p), parent, len(own), kids, len(childless), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert frame.columns == names
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def some(seed, convs, turns=6, kinds=3):
    rnd = random.Random(seed)
    return [
        (c, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", None]), rnd.choice(["", None, "hi", "né", "ok " * 3][:kinds + 1]))
        for c in rnd.sample(range(900), convs)
        for t in range(rnd.randint(1, turns))
    ]


def test_median_order_is_a_permutation():
    for n in (0, 1, 2, 7, 40):
        order = list(median_order(n))
        assert sorted(order) == list(range(n)) and (not order or order[0] == n // 2)


def test_tree_is_balanced_and_finds_paths_again():
    tree = Tst()
    seqs = [[k, 5] for k in range(1, 128)]
    paths = {k: tree.insert(seqs[k]) for k in median_order(len(seqs))}
    assert all(tree.insert(seqs[k]) == p for k, p in paths.items())
    depth, at = 0, tree.down[0]
    while at:
        depth, at = depth + 1, tree.high[at]
    assert depth <= 7
    order = tree.upwards()
    assert sorted(order) == list(range(len(tree.turn))) and order[-1] == 0
    assert all(order.index(k) < order.index(tree.parent[k]) for k in range(1, len(tree.turn)))


def test_very_long_path_needs_no_recursion():
    n = 50_000
    path = {"seq": list(range(n)), "chars": [1] * n, "n": [0] * n + [2], "least": [None] * n + [4], "ends": [None] * n + [4]}
    path |= {name: [0] * (n + 1) for name in ("kids", "leaves", "saved")}
    shard = Shard([path])
    assert shard.total["saved"][0] == n and shard.total["leaves"][0] == 1 and shard.total["n"][0] == 2


@pytest.mark.parametrize("shard_turns", [3, 40, 100_000])
def test_equals_plain_prefixes(spark, shard_turns):
    rows = some(shard_turns, 130)
    got = trie_nodes(encoded(spark.createDataFrame(rows, CONVS)), TrieOptions(shard_turns))
    assert rows_of(got) == brute(turns_of(rows))


def test_rebuilt_conversations(spark):
    rows = some(7, 200) + [(5, 0, "user", "x"), (105, 0, "user", "x"), (100, 1, "a", "b"), (-7, 1, "a", "b")]
    own = encoded(spark.createDataFrame(rows, CONVS))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    base = F.col("conv_id") - F.pmod("conv_id", F.lit(100))
    got = trie_nodes(rebuilt(own, heads, base), TrieOptions(50))
    want = rebuild(turns_of(rows))
    assert [] in want.values()  # a conversation without turns is a member of the root
    assert rows_of(got) == brute(want)


def test_hot_conversation_and_repeated_rows(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(150) for t in range(3)]
    rows += [(200, 0, "user", "t0"), (200, 0, "user", "t0"), (None, 0, "user", "t0"), (201, None, "user", None)]
    got = trie_nodes(encoded(spark.createDataFrame(rows, CONVS)), TrieOptions(20))
    assert rows_of(got) == brute(turns_of(rows))


def test_empty_table_and_more_columns(spark):
    assert trie_nodes(encoded(spark.createDataFrame([], CONVS))).collect() == []
    df = spark.createDataFrame([(1, 0, "u", "a", 9, "d")], CONVS + ", seq int, digest string")
    assert [r.depth for r in trie_nodes(encoded(df)).orderBy("depth").collect()] == [0, 1]
