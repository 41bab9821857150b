"""Prefix trie of conversations: ternary search trees over turn ids per shard.

A node is a distinct sequence of a conversation's first turns; its members
are the conversations that start with it, the root's all.

1. Turns become ids of a stored dictionary of distinct (role, text), so
   texts travel once; a conversation is an array of ids, and equal ones
   are one path with a count (combined map-side).
2. Paths are sorted by range into shards. Each shard inserts its paths into
   a ternary search tree, the median first and then the medians of both
   halves, and walks it with a stack: members, children, childless nodes
   and saved tokens add up from the last turn to the first.
3. Nodes on a shard's first and last path may go on in another shard. They
   leave it as paths with what the shard knows below them, and all others
   are final. The boundary paths are a far smaller set of the same kind;
   the same step merges them, until one shard holds what is left.

A shard holds about ``shard_turns`` ids; a single conversation must fit in
a task with some 100 bytes a turn, texts not included.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .frames import release_memory


@dataclass(frozen=True)
class TrieOptions:
    shard_turns: int = 20_000


DEFAULT = TrieOptions()

# A path: turn ids and their code points; then, for the root and each turn's
# node, what is known besides the paths below: members, least of them, id of
# the group that ends there, children, childless nodes, saved tokens.
_STATE = ("n", "least", "ends", "kids", "leaves", "saved")


def encoded(conversations: DataFrame) -> DataFrame:
    """(conv_id, seq): each conversation as an array of (id, chars) of its turns.

    Turns are ordered by turn (nulls first), then by the SHA-256 of role and
    text; null role or text is empty; a turn recorded twice is there twice.
    Rows without a conv_id belong to no conversation.
    """
    spark = conversations.sparkSession
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        "conv_id", "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"), F.length(text).cast("bigint").alias("chars")
    )
    path = scratch_dir(spark, "turn-dictionary")
    words = turns.groupBy("digest").agg(F.first("chars").alias("chars"))
    words.select(F.col("digest").alias("d_digest"), F.monotonically_increasing_id().alias("id"), "chars").write.parquet(path)
    # null-safe, so that a frequent turn can be split by adaptive execution
    coded = turns.drop("chars").join(spark.read.parquet(path), F.col("digest").eqNullSafe(F.col("d_digest")))
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "digest", "id", "chars")
    rows = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(order)).alias("turns"))
    return rows.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("seq"))


def rebuilt(seqs: DataFrame, heads: Column, base: Column) -> DataFrame:
    """Replace the first ``heads`` turns of every conversation by those of the
    conversation ``base``: all it has if fewer, none if there is no such one."""
    own = seqs.select("conv_id", "seq", heads.cast("int").alias("h"), base.alias("base"))
    source = seqs.select(F.col("conv_id").alias("b_id"), F.col("seq").alias("b_seq"))
    joined = own.join(source, F.col("base") == F.col("b_id"), "left")
    none = F.array().cast(seqs.schema["seq"].dataType)
    head = F.slice(F.coalesce("b_seq", none), F.lit(1), F.col("h"))
    return joined.select("conv_id", F.concat(head, F.slice("seq", F.col("h") + 1, F.greatest(F.size("seq") - F.col("h"), F.lit(0)))).alias("seq"))


class Tst:
    """Ternary search tree over integer sequences; node 0 is the root path.

    ``low``, ``high`` and ``down`` are links to smaller and larger siblings
    and to the first child; 0 is none."""

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.down = [0], [0], [0], [0]
        self.parent, self.depth = [0], [0]

    def insert(self, seq: list[int]) -> list[int]:
        """The nodes along ``seq``, the root first; missing ones are made."""
        path = [0]
        for turn in seq:
            above = path[-1]
            at, link = self.down[above], (self.down, above)
            while at and self.turn[at] != turn:
                side = self.low if turn < self.turn[at] else self.high
                link, at = (side, at), side[at]
            if not at:
                at = len(self.turn)
                self.turn.append(turn)
                self.low.append(0)
                self.high.append(0)
                self.down.append(0)
                self.parent.append(above)
                self.depth.append(self.depth[above] + 1)
                link[0][link[1]] = at
            path.append(at)
        return path

    def upwards(self) -> list[int]:
        """All nodes, each after its whole subtree, by a walk with a stack."""
        out, stack = [], [0]
        while stack:
            at = stack.pop()
            out.append(at)
            child = [self.down[at]] if self.down[at] else []
            while child:
                c = child.pop()
                stack.append(c)
                child += [x for x in (self.low[c], self.high[c]) if x]
        out.reverse()
        return out


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle first, then the middles of both halves, and so on."""
    spans = [(0, n)]
    while spans:
        a, b = spans.pop()
        if a < b:
            mid = (a + b) // 2
            yield mid
            spans += [(mid + 1, b), (a, mid)]


def _least(a, b):  # noqa: ANN001, ANN202
    return b if a is None else a if b is None else min(a, b)


class Shard:
    """The trie of a shard's paths, with what adds up at every node."""

    def __init__(self, paths: list[dict]):
        tree = self.tree = Tst()
        self.paths: list[list[int]] = [[]] * len(paths)
        blank = {name: None if name in ("least", "ends") else 0 for name in _STATE}
        columns: dict[str, list] = {name: [] for name in _STATE}
        chars: list[int] = []
        for k in median_order(len(paths)):
            p = paths[k]
            nodes = self.paths[k] = tree.insert(p["seq"])
            more = len(tree.turn) - len(chars)
            chars += [0] * more
            for name, column in columns.items():
                column += [blank[name]] * more
            for d, at in enumerate(nodes):
                if d:
                    chars[at] = p["chars"][d - 1]
                for name in ("n", "kids", "leaves", "saved"):
                    columns[name][at] += p[name][d]
                columns["least"][at] = _least(columns["least"][at], p["least"][d])
                columns["ends"][at] = _least(columns["ends"][at], p["ends"][d])
        self.own = {name: list(c) for name, c in columns.items()}
        n, least, kids, leaves, saved = (columns[name] for name in ("n", "least", "kids", "leaves", "saved"))
        self.total = columns
        self.order = tree.upwards()
        for at in self.order:
            if not kids[at]:
                leaves[at] = 1
            saved[at] += (n[at] - 1) * chars[at]
            if at:
                up = tree.parent[at]
                n[up] += n[at]
                least[up] = _least(least[up], least[at])
                kids[up] += 1
                leaves[up] += leaves[at]
                saved[up] += saved[at]

    def boundary(self) -> set[int]:
        return {*self.paths[0], *self.paths[-1]}

    def open_paths(self, paths: list[dict]) -> Iterator[dict]:
        """The first and the last path, with what the shard adds to their
        nodes from the nodes off them; each node's share is given once."""
        edge = self.boundary()
        known = {at: {name: self.own[name][at] for name in _STATE} for at in edge}
        for at in self.order:
            up = self.tree.parent[at]
            if at not in edge and up in edge:
                k = known[up]
                k["n"] += self.total["n"][at]
                k["least"] = _least(k["least"], self.total["least"][at])
                k["kids"] += 1
                k["leaves"] += self.total["leaves"][at]
                k["saved"] += self.total["saved"][at]
        none = {"n": 0, "least": None, "ends": None, "kids": 0, "leaves": 0, "saved": 0}
        for which in (0, -1) if len(paths) > 1 else (0,):
            states = [known.pop(at, none) for at in self.paths[which]]
            yield {"seq": paths[which]["seq"], "chars": paths[which]["chars"], **{name: [s[name] for s in states] for name in _STATE}}


def _key(above: bytes, turn: int) -> bytes:
    return hashlib.blake2b(above + struct.pack("<q", turn), digest_size=16).digest()


ROOT_KEY = b"\0" * 16


_NODE = ["least", "depth", "parent", "n", "kids", "leaves", "saved", "ends", "key", "parent_key"]


def _walker(first: bool, last: bool):  # noqa: ANN202
    """Shards to final nodes and open paths (only nodes if ``last``). Nodes of
    boundary paths carry a key of their sequence, by which the nodes that
    other shards made below them find their parent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        paths: list[dict] = []
        for batch in batches:
            schema = batch.schema
            paths += batch.to_pylist()
        if not paths:
            return
        id_type = schema.field("least").type.value_type
        shard = Shard(paths)
        tree, total = shard.tree, shard.total
        edge = shard.boundary()
        keys = {0: ROOT_KEY}
        for at in sorted(edge) if first else range(len(tree.turn)):  # parents have smaller numbers
            if at:
                keys[at] = _key(keys[tree.parent[at]], tree.turn[at])
        final = shard.order if last else [at for at in shard.order if at not in edge]
        kinds = [id_type, pa.int32(), id_type, *[pa.int64()] * 4, id_type, pa.binary(), pa.binary()]
        absent = pa.nulls(1, pa.struct([(f.name, f.type) for f in schema]))
        for a in range(0, len(final), 10_000):
            rows = []
            for at in final[a : a + 10_000]:
                up = tree.parent[at]
                closed = last or up not in edge
                rows.append(
                    (
                        total["least"][at], tree.depth[at], total["least"][up] if at and closed else None,
                        *(total[name][at] for name in ("n", "kids", "leaves", "saved", "ends")),
                        None if first else keys[at], None if closed else keys[up],
                    )
                )
            node = pa.StructArray.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_NODE)
            yield pa.RecordBatch.from_arrays([node, pa.concat_arrays([absent] * len(rows))], names=["node", "path"])
        if not last:
            for p in shard.open_paths(paths):
                path = pa.array([p], type=absent.type)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.struct(list(zip(_NODE, kinds, strict=True)))), path], names=["node", "path"])
        release_memory()

    return run


def _end_digests(groups: DataFrame, members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) per group of equal conversations: SHA-256 of their
    ids, ascending, comma-joined. Ids are sorted by range first and joined in
    pieces, so the task that hashes a group reads a row per piece."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, ids = batch.column("ends"), batch.column("conv_id").to_pylist()
            own = ends.to_pylist()
            cuts = [0, *[k for k in range(1, len(own)) if own[k] != own[k - 1]], len(own)] if own else [0]
            yield pa.RecordBatch.from_arrays(
                [
                    ends.take(pa.array(cuts[:-1], type=pa.int64())),
                    batch.column("conv_id").take(pa.array(cuts[:-1], type=pa.int64())),
                    pa.array([",".join(map(str, ids[a:b])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], type=pa.string()),
                ],
                names=["ends", "start", "ids"],
            )

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = digest = kind = None
        for batch in batches:
            kind = batch.schema.field("ends").type
            done: list = []
            for group, ids in zip(batch.column("ends").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if group != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = group, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], type=kind), pa.array([d[1] for d in done])], names=["ends", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], type=kind), pa.array([digest.hexdigest()])], names=["ends", "ends_sha256"])

    id_type = members.schema["conv_id"].dataType.simpleString()
    spread = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = members.join(groups.select(F.col("seq").alias("g_seq"), F.col("least").alias("ends")), F.col("seq").eqNullSafe(F.col("g_seq"))).select("ends", "conv_id")
    joined = (
        own.repartitionByRange(spread, "ends", "conv_id").sortWithinPartitions("ends", "conv_id").mapInArrow(pieces, f"ends {id_type}, start {id_type}, ids string")
    )
    return joined.repartition(spread, "ends").sortWithinPartitions("ends", "start").mapInArrow(hashes, f"ends {id_type}, ends_sha256 string")


def trie_nodes(seqs: DataFrame, opt: TrieOptions = DEFAULT) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, seq as ``encoded``
    gives it): conv_id (least member), depth, parent_conv_id (null for the
    root), n_convs, n_children, n_leaves (childless nodes in its subtree,
    itself included), saved_tokens (over its subtree, members less one times
    code points of the last turn) and ends_sha256 (ids of the members that
    end here, ascending, comma-joined).

    A conversation without turns is a member of the root alone. Equal
    conversations end at one node. conv_ids are unique in ``seqs``. No
    conversations, no rows.
    """
    spark = seqs.sparkSession
    seqs = seqs.checkpoint()
    members = seqs.select("conv_id", F.col("seq.id").alias("seq"))
    groups = seqs.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least")).checkpoint()
    last = F.size("seq")
    blank = {"n": F.lit(0).cast("bigint"), "least": F.lit(None).cast(seqs.schema["conv_id"].dataType)}

    def at_end(value: Column, other: Column) -> Column:
        return F.concat(F.array_repeat(other, last), F.array(value))

    paths = groups.select(
        F.col("seq.id").alias("seq"),
        F.col("seq.chars").alias("chars"),
        at_end(F.col("n"), blank["n"]).alias("n"),
        at_end(F.col("least"), blank["least"]).alias("least"),
        at_end(F.col("least"), blank["least"]).alias("ends"),
        *[F.array_repeat(blank["n"], last + 1).alias(name) for name in ("kids", "leaves", "saved")],
    )
    id_type = seqs.schema["conv_id"].dataType.simpleString()
    node_type = (
        f"struct<least:{id_type},depth:int,parent:{id_type},n:bigint,kids:bigint,leaves:bigint,saved:bigint,"
        f"ends:{id_type},key:binary,parent_key:binary>"
    )
    path_type = paths.schema.simpleString()
    nodes = None
    before = None
    while True:
        turns = paths.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
        shards = -(-turns // opt.shard_turns)
        if before is not None:  # boundary paths are far fewer; never as many shards again
            shards = min(shards, before // 4)
        single = shards <= 1
        dealt = paths.coalesce(1) if single else paths.repartitionByRange(shards, "seq")
        level = dealt.sortWithinPartitions("seq").mapInArrow(_walker(nodes is None, single), f"node {node_type}, path {path_type}").checkpoint()
        own = level.where("node is not null").select("node.*")
        nodes = own if nodes is None else nodes.unionByName(own)
        if single:
            break
        paths = level.where("path is not null").select("path.*")
        before = shards
    known = nodes.where("key is not null").select(F.col("key").alias("k_key"), F.col("least").alias("k_least"))
    named = nodes.join(known, F.col("parent_key").eqNullSafe(F.col("k_key")) & F.col("parent_key").isNotNull(), "left")
    digests = _end_digests(groups.select(F.col("seq.id").alias("seq"), "least"), members).select(F.col("ends").alias("e_ends"), "ends_sha256")
    full = named.join(digests, F.col("ends") == F.col("e_ends"), "left")
    return full.select(
        F.col("least").alias("conv_id"),
        F.col("depth").cast("bigint").alias("depth"),
        F.coalesce("parent", "k_least").alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.col("kids").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
