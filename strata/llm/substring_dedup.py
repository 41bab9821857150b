"""Substring deduplication by Rabin-Karp hashes of word windows.

Words are runs of anything but ASCII white space, unchanged. A window is
``window`` (50) consecutive words of one document. A word is removed when a
window that covers it also starts in a document with a smaller id; windows
are judged on the input, not on what is left.

1. Every task turns texts into word hashes and, by prefix sums, into the
   Rabin-Karp hash of every window. A window's *anchor* is the least hash
   of the runs of ``window // 2`` words inside it, so equal windows have
   equal anchors. Consecutive windows with the same anchor are one *run*;
   its key combines the hashes of all its windows. A run is a row: about
   one for every 13 words, whatever the text.
2. Runs are counted in Spark. An anchor that occurs in one document only
   proves that none of its windows repeats; all other runs are counted by
   (anchor, key). A run that also is in a document of smaller id repeats
   with all its windows.
3. Where an anchor has runs of different keys (the texts part ways near
   it), the least holder of each key sends its single windows along, which
   are counted by (anchor, window hash).
4. Repeated runs and windows of a document merge into maximal intervals of
   words, which are removed.

All counts are map-side combined minimums, so a passage that a third of
all documents share is one row per task before the shuffle; what is joined
back are narrow rows, on null-safe keys, so that adaptive execution can
split a hot key. Memory is bounded by one document. Two windows are taken
as equal when anchor and window hash are (128 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_dir
from .frames import kept_columns, release_memory
from .textops import NOT_SPACE, Words, mix64, power_tables, row_slices, texts_of, word_hash, words_of


@dataclass(frozen=True)
class SubstringOptions:
    window: int = 50

    def __post_init__(self) -> None:
        if self.window < 2:
            raise ValueError("a window has two words at least")

    @property
    def anchor(self) -> int:
        return self.window // 2


DEFAULT = SubstringOptions()


class Windows:
    """Rabin-Karp hashes over the words of several texts."""

    def __init__(self, words: Words):
        self.words = words
        hashes = word_hash(words)
        mul, self._inverse = power_tables(len(hashes))
        self._codes = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(hashes * mul[: len(hashes)], out=self._codes[1:])

    def hashes(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each position on."""
        n = len(self._codes) - size
        if n <= 0:
            return np.zeros(0, dtype=np.uint64)
        return mix64((self._codes[size:] - self._codes[:-size]) * self._inverse[:n])


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` consecutive ones."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(w: Words, opt: SubstringOptions = DEFAULT) -> tuple[np.ndarray, ...]:
    """(text, pos, n, anchor, key) of the runs of windows in ``w``; ``pos`` is
    the first window's word in its text, ``n`` the number of windows."""
    none = np.zeros(0, dtype=np.int64)
    if len(w.start) < opt.window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    rolled = Windows(w)
    full = rolled.hashes(opt.window)
    low = _sliding_min(rolled.hashes(opt.anchor), opt.window - opt.anchor + 1)
    at = np.arange(len(full))
    own = w.doc[: len(full)]
    inside = at + opt.window <= w.first[own + 1]
    new = inside.copy()
    new[1:] &= ~(inside[:-1] & (low[1:] == low[:-1]))
    start = np.flatnonzero(new)
    if not len(start):
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, start)
    n = np.diff(np.concatenate((begin, [len(at)])))
    step = np.arange(len(at)) - np.repeat(begin, n)
    key = np.add.reduceat(mix64(full[at] + mix64(step.astype(np.uint64) + np.uint64(1))), begin)
    text = own[start]
    return text, start - w.first[text], n, low[start], mix64(key ^ n.astype(np.uint64))


def _runs(opt: SubstringOptions):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in row_slices(texts):
                text, pos, n, anchor, key = window_runs(words_of(texts[a:b], NOT_SPACE, lower=False), opt)
                rows = pa.array(text + a)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").take(rows),
                        batch.column("tk").take(rows),
                        pa.array(pos.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                        pa.array(anchor.view(np.int64)),
                        pa.array(key.view(np.int64)),
                    ],
                    names=["id", "tk", "pos", "n", "anchor", "key"],
                )
        release_memory()

    return run


def _single_windows(opt: SubstringOptions):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            marks = batch.column("marks").to_pylist()
            rows, first, anchors, hashes = [], [], [], []
            for row, text in enumerate(texts):
                full = Windows(words_of([text], NOT_SPACE, lower=False)).hashes(opt.window).view(np.int64)
                for m in marks[row]:
                    rows.append(row)
                    first.append(m["pos"])
                    anchors.append(m["anchor"])
                    hashes.append(full[m["pos"] : m["pos"] + m["n"]])
            at = np.concatenate(([0], np.cumsum([len(h) for h in hashes]))).astype(np.int32)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.int64)
            take = pa.array(rows, type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(take),
                    batch.column("tk").take(take),
                    pa.array(first, type=pa.int32()),
                    pa.array(anchors, type=pa.int64()),
                    pa.ListArray.from_arrays(pa.array(at), pa.array(flat)),
                ],
                names=["id", "tk", "pos", "anchor", "hashes"],
            )
        release_memory()

    return run


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, text): the hash of the text tells rows with one id apart."""
    text = F.col(f"`{text_col}`").cast("binary")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("tk"), text.alias("text"))


def _stored(frame: DataFrame, name: str) -> DataFrame:
    """Write ``frame`` to the shared scratch folder and read it back."""
    spark = frame.sparkSession
    path = scratch_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def repeated_windows(docs: DataFrame, opt: SubstringOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tk, spans) of the documents with windows that a smaller id holds.

    ``tk`` is ``xxhash64`` of the text's bytes; ``spans`` an array of (pos, n):
    n consecutive repeated windows from word pos on, unordered.
    """
    src = _keyed(docs, id_col, text_col).where("id is not null and text is not null")
    id_type = src.schema["id"].dataType.simpleString()
    runs = _stored(src.mapInArrow(_runs(opt), f"id {id_type}, tk bigint, pos int, n int, anchor bigint, key bigint"), "window-runs")
    shared = (
        runs.groupBy("anchor")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), (F.min("key") != F.max("key")).alias("parts"))
        .where("low < high")
        .select(F.col("anchor").alias("s_anchor"), "parts")
    )
    # null-safe joins: the counts then have an exchange of their own, and
    # adaptive execution can split a hot anchor or run
    held = _stored(runs.join(shared, F.col("anchor").eqNullSafe(F.col("s_anchor"))).drop("s_anchor"), "shared-runs")
    least = held.groupBy(F.col("anchor").alias("l_anchor"), F.col("key").alias("l_key")).agg(F.min("id").alias("least"))
    same = F.col("anchor").eqNullSafe(F.col("l_anchor")) & F.col("key").eqNullSafe(F.col("l_key"))
    judged = held.join(least, same).select("id", "tk", "pos", "n", "anchor", "parts", (F.col("id") > F.col("least")).alias("whole"))
    judged = _stored(judged.where("whole or parts"), "judged-runs")

    open_runs = judged.where("not whole").groupBy(F.col("id").alias("o_id"), F.col("tk").alias("o_tk"))
    open_runs = open_runs.agg(F.collect_set(F.struct("pos", "n", "anchor")).alias("marks"))
    wanted = src.join(open_runs, F.col("id").eqNullSafe(F.col("o_id")) & F.col("tk").eqNullSafe(F.col("o_tk"))).select("id", "tk", "text", "marks")
    single = _stored(
        wanted.mapInArrow(_single_windows(opt), f"id {id_type}, tk bigint, pos int, anchor bigint, hashes array<bigint>"), "single-windows"
    ).select("id", "tk", "anchor", "pos", F.posexplode("hashes").alias("k", "h"))
    first = single.groupBy(F.col("anchor").alias("f_anchor"), F.col("h").alias("f_h")).agg(F.min("id").alias("least"), F.max("id").alias("high"))
    on = F.col("anchor").eqNullSafe(F.col("f_anchor")) & F.col("h").eqNullSafe(F.col("f_h"))
    again = single.join(first.where("least < high").drop("high"), on).where("id > least")
    spans = judged.where("whole").select("id", "tk", "pos", "n").unionByName(
        again.select("id", "tk", (F.col("pos") + F.col("k")).alias("pos"), F.lit(1).alias("n"))
    )
    return spans.groupBy("id", "tk").agg(F.collect_set(F.struct("pos", "n")).alias("spans"))


def merge_spans(spans: list[tuple[int, int]], window: int) -> list[tuple[int, int]]:
    """Maximal (start, end) word intervals covered by runs (pos, n) of windows."""
    out: list[list[int]] = []
    for pos, n in sorted(spans):
        end = pos + n - 1 + window
        if out and pos <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([pos, end])
    return [(a, b) for a, b in out]


def _removed(opt: SubstringOptions):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, gone, kept, cuts = [], [], [], []
            spans = batch.column("spans").to_pylist()
            for text, found in zip(batch.column("text").to_pylist(), spans, strict=True):
                words = (text or b"").split()
                cut = merge_spans([(s["pos"], s["n"]) for s in found], opt.window) if found else []
                counts.append(len(words))
                gone.append(sum(b - a for a, b in cut))
                cuts.append([{"start": a, "end": b} for a, b in cut])
                at = 0
                parts = []
                for a, b in [*cut, (len(words), len(words))]:
                    parts += words[at:a]
                    at = b
                kept.append(None if text is None else b" ".join(parts))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row"),
                    pa.array(kept, type=pa.binary()),
                    pa.array(counts, type=pa.int64()),
                    pa.array(gone, type=pa.int64()),
                    pa.array(cuts, type=pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["row", "kept", "n_words", "n_removed", "spans"],
            )
        release_memory()

    return run


def remove_repeats(docs: DataFrame, opt: SubstringOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows removed from the text.

    The text becomes its kept words, joined by one space. Added columns:
    n_words (of the input), n_removed and spans (the maximal removed word
    intervals, end exclusive); input columns of these names are replaced.

    A null text stays null and has no words; a text of fewer words than a
    window has none. A row without an id compares with no other: it
    loses nothing and causes no removal. Rows that share an id cause no
    removal in each other; repeated rows give repeated results. An empty
    table gives an empty one.
    """
    added = ("n_words", "n_removed", "spans")
    keep = kept_columns(docs, added)
    others = [c for c in keep if c != text_col]
    text = F.col(f"`{text_col}`").cast("binary")
    src = docs.select(
        F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.xxhash64(text).alias("tk"),
        text.alias("text"),
    )
    found = repeated_windows(docs, opt, id_col, text_col).select(F.col("id").alias("f_id"), F.col("tk").alias("f_tk"), "spans")
    joined = src.join(found, F.col("id").eqNullSafe(F.col("f_id")) & F.col("tk").eqNullSafe(F.col("f_tk")), "left").select("row", "text", "spans")
    row_type = src.schema["row"].dataType.simpleString()
    out = joined.mapInArrow(_removed(opt), f"row {row_type}, kept binary, n_words bigint, n_removed bigint, spans array<struct<start:int,end:int>>")
    cols = [F.col("kept").cast("string").alias(c) if c == text_col else F.col(f"row.c{others.index(c)}").alias(c) for c in keep]
    return out.select(*cols, *added)
