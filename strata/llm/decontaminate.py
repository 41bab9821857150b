"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the test items (``textops`` words) form one suffix
automaton, in which every run of words of any item leads to a state. A
document's words are streamed through it, which gives at each word the
length of the longest run ending there that some item contains. A run is
contaminated when it is a window of an item: ``length`` consecutive words,
or, for a shorter item, ``coverage`` of its words (all of them at 1.0).

Items are dealt into shards of at most ``shard_words`` words (an item with
more is cut into parts that overlap by a window), so the automaton that is
broadcast has a proven size whatever the benchmark's; documents pass
through one shard after another and keep what earlier shards found, with
no shuffle. Words that no item has end every run, so only stretches of
known words that are long enough for a window are walked at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, release_memory
from .textops import TO_WORDS, texts_of

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


@dataclass(frozen=True)
class DecontaminationOptions:
    length: int = 10
    coverage: float = 1.0
    # A document with a larger share of its words in contaminated spans goes.
    max_share: float = 0.5
    shard_words: int = 100_000
    shard_bytes: int = 4 << 20
    # Shards that one job passes through before the state is written.
    shards_per_job: int = 4


DEFAULT = DecontaminationOptions()


class Automaton:
    """Suffix automaton of several word sequences; states are numbers."""

    def __init__(self, items: list[tuple[str, list[bytes]]], opt: DecontaminationOptions) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.size = [0]
        # state -> {window size: ids of the items whose windows of that size end there}
        self.windows: dict[int, dict[int, set[str]]] = {}
        self.shortest = 0
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        for item, codes in coded:
            window = self._window(len(codes), opt)
            self.shortest = min(self.shortest or window, window)
            state = 0
            for k, c in enumerate(codes):
                state = self.next[state][c]
                while self.size[self.link[state]] >= window:
                    state = self.link[state]
                if k + 1 >= window:
                    self.windows.setdefault(state, {}).setdefault(window, set()).add(item)

    @staticmethod
    def _window(n: int, opt: DecontaminationOptions) -> int:
        return max(1, min(opt.length, int(np.ceil(opt.coverage * n - 1e-9))))

    def _extend(self, last: int, c: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        if c in nxt[last]:
            q = nxt[last][c]
            return q if size[q] == size[last] + 1 else self._split(last, c, q)
        new = len(nxt)
        nxt.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[new] = q if size[q] == size[p] + 1 else self._split(p, c, q)
        return new

    def _split(self, p: int, c: int, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        copy = len(nxt)
        nxt.append(dict(nxt[q]))
        size.append(size[p] + 1)
        link.append(link[q])
        link[q] = copy
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = copy
            p = link[p]
        return copy

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged contaminated word spans of a text, and the items found."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = np.concatenate(([False], codes >= 0, [False]))
        edge = np.flatnonzero(known[1:] != known[:-1])
        begin, end = edge[0::2], edge[1::2]
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        nxt, link, size, windows = self.next, self.link, self.size, self.windows
        for a, b in zip(begin.tolist(), end.tolist(), strict=True):
            if b - a < self.shortest:
                continue
            state = length = 0
            for at, c in enumerate(codes[a:b].tolist(), a):
                while state and c not in nxt[state]:
                    state = link[state]
                    length = size[state]
                step = nxt[state].get(c)
                if step is None:
                    continue
                state, length = step, length + 1
                if length < self.shortest:
                    continue
                longest = 0
                up = state
                while up > 0:
                    for w, items in windows.get(up, {}).items():
                        if w <= length:
                            found |= items
                            longest = max(longest, w)
                    up = link[up]
                if longest:
                    lo = at + 1 - longest
                    if spans and spans[-1][1] >= lo:
                        spans[-1] = (min(spans[-1][0], lo), at + 1)
                        while len(spans) > 1 and spans[-2][1] >= spans[-1][0]:
                            top = spans.pop()
                            spans[-1] = (min(spans[-1][0], top[0]), top[1])
                    else:
                        spans.append((lo, at + 1))
        return spans, found


def _merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted([*a, *b]):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def item_words(text: bytes) -> list[bytes]:
    return text.translate(TO_WORDS).split()


def benchmark_shards(benchmark: DataFrame, opt: DecontaminationOptions = DEFAULT) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark as lists of (item id, words), each within the shard bounds.

    Only one shard is on the driver at a time. A long item is cut on the
    executors into parts that overlap by a window less one word, so no
    window is lost; its parts keep its id. An item without an id counts
    under the empty id."""
    part = min(opt.shard_words // 4, 10_000)
    src = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    length, coverage = opt.length, opt.coverage

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, parts, sizes = [], [], []
            for item, text in zip(batch.column("item").to_pylist(), texts_of(batch.column("text")), strict=True):
                words = text.translate(TO_WORDS).split()
                # parts are windows of the long item only if they are no short items themselves
                step = part if len(words) > part and coverage * part >= length else max(1, len(words))
                for at in range(0, len(words), step):
                    own = words[max(0, at - length + 1) : at + step]
                    names.append(item)
                    parts.append(b" ".join(own))
                    sizes.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, type=pa.string()), pa.array(parts, type=pa.binary()), pa.array(sizes, type=pa.int64())],
                names=["item", "words", "n"],
            )

    # repeated items would all be dealt to one shard
    parts = src.mapInArrow(cut, "item string, words binary, n bigint").distinct().checkpoint()
    total = parts.agg(F.sum("n").alias("n"), F.sum(F.length("words")).alias("b")).first()
    if not total["n"]:
        return
    shards = 1
    if total["n"] > opt.shard_words or total["b"] > opt.shard_bytes:
        # dealt by hash to twice as many shards as would do, so each stays within bounds
        shards = 2 * max(-(-total["n"] // opt.shard_words), -(-total["b"] // opt.shard_bytes))
    for k in range(shards):
        own = parts.where(F.pmod(F.xxhash64("item", "words"), F.lit(shards)) == k) if shards > 1 else parts
        yield [(r["item"], bytes(r["words"]).split(b" ")) for r in own.collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, opt: DecontaminationOptions = DEFAULT) -> DataFrame:
    """``docs`` with n_words, spans (merged contaminated word spans, end
    exclusive), n_hit (words in them) and items (ids of the items found,
    as sorted strings).

    A null text has no words. All input columns stay; columns of the added
    names are replaced. An empty benchmark finds nothing.
    """
    added = ("n_words", "spans", "n_hit", "items")
    keep = kept_columns(docs, added)
    others = [c for c in keep if c != "text"]
    state = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
        F.col("text").cast("binary").alias("text"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    state_type = state.schema
    context = docs.sparkSession.sparkContext

    def through(frame: DataFrame, shard: list[tuple[str, list[bytes]]]) -> DataFrame:
        held = context.broadcast(shard)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(held.value, opt)
            for batch in batches:
                sizes, spans, items = [], [], []
                old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for text, before, named in zip(texts_of(batch.column("text")), old_spans, old_items, strict=True):
                    words = text.translate(TO_WORDS).split()
                    new, found = automaton.find(words)
                    if new:
                        before = [x for s in _merge(list(zip(before[::2], before[1::2], strict=True)), new) for x in s]
                        named = sorted(found | set(named))
                    sizes.append(len(words))
                    spans.append(before)
                    items.append(named)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row"),
                        batch.column("text"),
                        pa.array(sizes, type=pa.int64()),
                        pa.array(spans, type=pa.list_(pa.int32())),
                        pa.array(items, type=pa.list_(pa.string())),
                    ],
                    names=["row", "text", "n_words", "spans", "items"],
                )
            del automaton
            release_memory()

        return frame.mapInArrow(run, state_type)

    used = 0
    for shard in benchmark_shards(benchmark, opt):
        if used and used % opt.shards_per_job == 0:
            state = state.checkpoint()
        state = through(state, shard)
        used += 1
    if not used:
        state = through(state, [])
    pairs = F.transform(
        F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1),
        lambda k: F.struct(F.get("spans", 2 * k).alias("start"), F.get("spans", 2 * k + 1).alias("end")),
    )
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = state.withColumn("spans", F.when(F.size("spans") > 0, pairs).otherwise(none))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = [F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"row.c{others.index(c)}").alias(c) for c in keep]
    return out.withColumn("n_hit", hit).select(*kept, *added)


def cut_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from each span's first to its last word."""
    words = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for lo, hi in spans:
        out.append(text[at : words[lo][0]])
        at = words[hi - 1][1]
    return b"".join([*out, text[at:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, opt: DecontaminationOptions = DEFAULT) -> DataFrame:
    """``docs`` with contaminated spans cut out of the text.

    Documents of which more than ``max_share`` of the words are contaminated
    are dropped; all others stay, those without a hit unchanged (a null
    text too). Where n_chars exists, it follows the new text.
    """
    # columns travel under names of their own, so that none clashes
    inner = {c: "text" if c == "text" else f"kept{k}" for k, c in enumerate(docs.columns)}
    found = find_contamination(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()]), benchmark, opt)
    kept = found.where(F.col("n_hit") <= opt.max_share * F.col("n_words")).select(*inner.values(), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = batch.column("spans").to_pylist()
            for k, s in enumerate(spans):
                if s:
                    cut = [(x["start"], x["end"]) for x in s]
                    texts[k] = cut_spans(texts[k].encode(), cut).decode("utf-8", "replace")
            cols = [pa.array(texts, type=pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)
        release_memory()

    clean = kept.mapInArrow(run, kept.schema)
    if "n_chars" in inner:
        own = inner["n_chars"]
        cut_size = F.length("text").cast(docs.schema["n_chars"].dataType)
        clean = clean.withColumn(own, F.when(F.size("spans") > 0, cut_size).otherwise(F.col(own)))
    return clean.select(*[F.col(n).alias(c) for c, n in inner.items()])
