"""URL filter: a trie over reversed host labels and path segments.

A rule allows or blocks a host with all its subdomains, for urls whose path
starts with the rule's path. The trie's first levels are the host's labels
from the right, below them the path's segments; the deepest rule on a
url's way wins (more host labels first, then the longer path; of equal
rules, block). Rules are dealt into shards of at most ``shard_rules``, so
the broadcast trie has a proven size for any number of rules; urls pass
through one shard after another and keep the best match so far. There is
no shuffle, so a hot host needs no care.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, with_types

ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_rest(url: str | Column) -> Column:
    """What follows the first ``://``; empty for null or where there is none."""
    u = F.col(url) if isinstance(url, str) else url
    at = F.instr(u, "://")
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise(F.lit(""))


def url_host(url: str | Column) -> Column:
    return F.translate(F.regexp_extract(url_rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: str | Column) -> Column:
    return F.regexp_extract(url_rest(url), "^[^/?#]*([^?#]*)", 1)


class Trie:
    """Node: (next labels or segments, path root, rule). A path prefix that
    ends inside a segment is kept at its last whole segment."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]) -> None:
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault("labels", {}).setdefault(label, {})
            node = node.setdefault("paths", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault("segments", {}).setdefault(segment, {})
            old = node.setdefault("rules", {}).get(rest)
            node["rules"][rest] = BLOCK if BLOCK in (verdict, old) else verdict

    @staticmethod
    def _longest(node: dict, path: str) -> tuple[int, str, str] | None:
        """The longest rule path that ``path`` starts with: length, it, verdict."""
        best = None
        at = 0
        while node is not None:
            for rest, verdict in node.get("rules", {}).items():
                end = at + len(rest)
                if (best is None or end > best[0]) and path.startswith(rest, at):
                    best = (end, path[:end], verdict)
            cut = path.find("/", at)
            if cut < 0:
                break
            node = node.get("segments", {}).get(path[at:cut])
            at = cut + 1
        return best

    def match(self, host: str, path: str) -> tuple[int, int, str, str] | None:
        """(host labels, path length, rule text, verdict) of the rule that wins."""
        labels = host.split(".")
        node, best = self.root, None
        for depth, label in enumerate(reversed(labels), 1):
            node = node.get("labels", {}).get(label)
            if node is None:
                break
            if "paths" in node:
                got = self._longest(node["paths"], path)
                if got:
                    best = (depth, got[0], ".".join(labels[-depth:]) + got[1], got[2])
        return best


def judge_urls(df: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = ALLOW, shard_rules: int = 200_000) -> DataFrame:
    """``df`` with host, path, rule (its host and path, null if none fits)
    and verdict (the rule's, else ``default``).

    ``rules``: (verdict, host, path). Hosts compare in lower case (ASCII),
    paths as they are. A null url, or one without ``://``, has an empty
    host and path and no rule. All input columns stay; columns of the added
    names are replaced.
    """
    added = ("host", "path", "rule", "verdict")
    keep = kept_columns(df, added)
    src = only(df, keep)
    state = df.select(
        *[F.col(f"`{c}`") for c in keep],
        url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("verdict"),
        F.lit(0).alias("__depth"),
        F.lit(-1).alias("__length"),
    )
    schema = with_types(src.schema, "host string, path string, rule string, verdict string, __depth int, __length int")
    context = df.sparkSession.sparkContext

    def through(frame: DataFrame, shard: list[tuple[str, str, str]]) -> DataFrame:
        held = context.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trie = Trie(held.value)
            for batch in batches:
                got = [batch.column(c).to_pylist() for c in ("host", "path", "rule", "verdict", "__depth", "__length")]
                for k, (host, path) in enumerate(zip(got[0], got[1], strict=True)):
                    m = trie.match(host, path)
                    if m and ((m[0], m[1]) > (got[4][k], got[5][k]) or ((m[0], m[1]) == (got[4][k], got[5][k]) and m[3] == BLOCK)):
                        got[4][k], got[5][k], got[2][k], got[3][k] = m
                new = [pa.array(v, type=pa.string()) for v in got[:4]] + [pa.array(v, type=pa.int32()) for v in got[4:]]
                names = [*keep, "host", "path", "rule", "verdict", "__depth", "__length"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *new], names=names)

        return frame.mapInArrow(run, schema)

    shard: list[tuple[str, str, str]] = []
    for verdict, host, path in rules:
        if verdict not in (ALLOW, BLOCK):
            raise ValueError(f"unknown verdict {verdict!r}")
        shard.append((verdict, host.translate(str.maketrans(_UPPER, _LOWER)), path))
        if len(shard) == shard_rules:
            state = through(state, shard)
            shard = []
    if shard:
        state = through(state, shard)
    return state.select(
        *[F.col(f"`{c}`") for c in keep], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")
    )
