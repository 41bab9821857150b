"""N-gram Jaccard self-join by MinHash banding.

Texts are words (``textops``: lower-cased ASCII, runs of letters, digits
and non-ASCII) and n-grams of five words; a text of one to four words is
one gram. Two texts are linked when the Jaccard similarity of their full
gram sets is at least ``threshold`` (0.8).

1. One pass over the documents gives each text's class key (MD5 of its
   words), its band hashes and its size. Copies of a word sequence share a
   key, so they are one class from here on, however many there are; the
   aggregate to classes is combined map-side.
2. Band hashes of the classes are shuffled; band and row counts follow
   from the target recall at the threshold (``choose_bands``). Buckets
   with one class go.
3. The members of a hot group of near copies meet in most bands, in large
   buckets. Large buckets that share classes are joined into one group
   where comparing the group's classes once is less work than comparing
   them bucket by bucket; its classes are then sent once, not per band.
4. A large bucket or group is cut into blocks by a hash of the key, and
   every pair of blocks is a work unit of its own, so no task holds a whole
   hot bucket, and pairs are never written out. A class is in as many
   units as its group has blocks (``block_classes``, ``block_bytes``), so
   the rows sent are linear up to that size; the comparisons of a group
   are pairs by nature, and are made as matrix products.
5. In a bucket's unit a pair belongs to the first band in which it meets,
   and to none if its group has it, so it is counted once. Only classes
   with such a pair there get their text sent along (narrow rows first,
   texts after); pairs are verified on the full gram sets.
6. Units return, per class, its number of verified links, and the edges of
   a star for each locally connected part; sums and connected components
   over these give the result. Both grow with the classes, not with the
   pairs.

Every link between two different texts that share a band is found; at the
threshold itself a pair shares one with ``target_recall`` (0.999), and
with more for more similar pairs; inside a hot group every link is found.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .frames import release_memory
from .textops import gram_hash, mix64, normalised, row_slices, texts_of, word_hash, words_of


def choose_bands(threshold: float = 0.8, target_recall: float = 0.999, max_hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most selective banding of at most ``max_hashes``
    functions under which a pair at the threshold meets with ``target_recall``."""
    for rows in range(max_hashes, 0, -1):
        miss = 1.0 - threshold**rows
        bands = 1 if miss <= 0 else math.ceil(math.log(1.0 - target_recall) / math.log(miss))
        if bands * rows <= max_hashes:
            return bands, rows
    raise ValueError("max_hashes is too small for this recall")


@dataclass(frozen=True)
class JoinOptions:
    threshold: float = 0.8
    gram_words: int = 5
    target_recall: float = 0.999
    max_hashes: int = 128
    # Size of a block of a large bucket or group; a unit holds two blocks.
    block_classes: int = 4096
    block_bytes: int = 4 << 20
    # Buckets of more classes may be joined into groups.
    hot_classes: int = 256


DEFAULT = JoinOptions()


def _grams(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    w = words_of(texts)
    return gram_hash(word_hash(w), w.first, size)


def text_key(text_col: str) -> Column:
    """Hash of a text's bytes, null for a null text; with the id it names a row."""
    text = F.col(f"`{text_col}`").cast("binary")
    return F.when(text.isNotNull(), F.xxhash64(text))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, text): the hash of the text tells rows with one id apart."""
    return docs.select(F.col(f"`{id_col}`").alias("id"), text_key(text_col).alias("tk"), F.col(f"`{text_col}`").cast("binary").alias("text"))


def signatures(docs: DataFrame, opt: JoinOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, tk (hash of the text, null for a null one), class key,
    n_bytes of its text and its band hashes.

    The key is null, and the bands too, for a text without words.
    """
    bands, rows = choose_bands(opt.threshold, opt.target_recall, opt.max_hashes)
    size = opt.gram_words
    src = _keyed(docs, id_col, text_col)
    id_type = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mul = mix64(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
        seed = mix64(np.arange(1, rows + 1, dtype=np.uint64) << np.uint64(32)) | np.uint64(1)
        for batch in batches:
            texts = texts_of(batch.column("text"))
            keys: list[bytes | None] = []
            sigs: list[np.ndarray] = []
            for a, b in row_slices(texts):
                part = texts[a:b]
                grams, at = _grams(part, size)
                has = np.diff(at) > 0
                sig = np.zeros((len(part), bands), dtype=np.uint64)
                if len(grams):
                    starts = at[:-1][has]
                    for k in range(bands):
                        code = np.full(len(starts), k + 1, dtype=np.uint64)
                        for r in range(rows):
                            low = np.minimum.reduceat(grams * mul[k * rows + r], starts)
                            code = mix64(low ^ (code * seed[r]))
                        sig[has, k] = code
                sigs.append(sig)
                keys += [hashlib.md5(normalised(t)).digest() if h else None for t, h in zip(part, has, strict=True)]
            sig = np.concatenate(sigs) if sigs else np.zeros((0, bands), dtype=np.uint64)
            null = np.array([k is None for k in keys], dtype=bool)
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(0, len(keys) + 1, dtype=np.int32) * bands), pa.array(sig.view(np.int64).ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("tk"),
                    pa.array(keys, type=pa.binary()),
                    pa.array([len(t) for t in texts], type=pa.int64()),
                    pa.array(lists.to_pylist(), type=pa.list_(pa.int64()), mask=null) if null.any() else lists,
                ],
                names=["id", "tk", "key", "n_bytes", "bands"],
            )
        release_memory()

    return src.mapInArrow(run, f"id {id_type}, tk bigint, key binary, n_bytes bigint, bands array<bigint>")


_UNIT = ["band", "h", "lo", "hi"]


def _units(members: DataFrame, opt: JoinOptions) -> DataFrame:
    """Give every class of a bucket or group of ``m`` classes its work units:
    a row per block of the other side, with (band, h, lo, hi) and ``own``."""
    blocks = F.greatest(F.ceil(F.col("m") / opt.block_classes), F.ceil(F.col("bytes") / opt.block_bytes), F.lit(1)).cast("int")
    return (
        members.withColumn("nb", blocks)
        .withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .select(*_UNIT, "own", "key", "grp")
    )


def hot_groups(members: DataFrame, opt: JoinOptions = DEFAULT) -> DataFrame:
    """(g_key, grp, m, bytes): the classes of large buckets that are compared
    group by group. ``grp`` names one of the group's buckets, ``m`` and
    ``bytes`` are the group's size.

    Large buckets are joined where they share classes; a group is taken if
    the square of its size is at most the sum over its buckets.
    """
    name = F.concat_ws(":", "band", "h")
    large = members.where(F.col("m") > opt.hot_classes).select("key", name.alias("bucket"), "m", "n_bytes").checkpoint()
    per_class = large.groupBy("key").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"), F.first("n_bytes").alias("n_bytes")).checkpoint()
    edges = per_class.select(F.col("buckets")[0].alias("a"), F.explode("buckets").alias("b")).distinct()
    parts = connected_components(edges, "a", "b").select(F.col("node").alias("p_node"), "root")
    named = per_class.withColumn("first", F.col("buckets")[0]).join(parts, F.col("first").eqNullSafe(F.col("p_node")), "left")
    classes = named.select("key", F.coalesce("root", "first").alias("grp"), "n_bytes")
    work = large.select("bucket", "m").distinct().join(parts, F.col("bucket") == F.col("p_node"), "left")
    work = work.groupBy(F.coalesce("root", "bucket").alias("w_grp")).agg(F.sum(F.col("m").cast("double") * F.col("m")).alias("work"))
    size = classes.groupBy(F.col("grp").alias("s_grp")).agg(F.count(F.lit(1)).alias("m"), F.sum("n_bytes").alias("bytes"))
    taken = size.join(work, F.col("s_grp") == F.col("w_grp")).where(F.col("m").cast("double") * F.col("m") <= F.col("work")).select("s_grp", "m", "bytes")
    return classes.join(taken, F.col("grp").eqNullSafe(F.col("s_grp"))).select(F.col("key").alias("g_key"), "grp", "m", "bytes")


def _by_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Split a stream sorted by unit into the units (rows of one as batches)."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in _UNIT]
        change = np.zeros(n, dtype=bool)
        change[0] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [*np.flatnonzero(change).tolist(), n]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            unit = tuple(int(c[a]) for c in cols)
            if unit != current:
                if held:
                    yield current, held
                held, current = [], unit
            held.append(batch.slice(a, b - a))
    if held:
        yield current, held


# Entries of a working matrix: rows of a tile times columns.
TILE = 1 << 19


class Unit:
    """The classes of a work unit: which pairs belong to it."""

    def __init__(self, unit: tuple, table: pa.Table):
        self.band, _, self.lo, self.hi = unit
        self.own = table.column("own").to_numpy()
        self.size = len(self.own)
        if self.band >= 0:
            bands = table.column("bands").combine_chunks()
            self.bands = bands.flatten().to_numpy(zero_copy_only=False).reshape(self.size, -1)[:, : self.band]
            group = table.column("grp").combine_chunks().dictionary_encode()
            self.group = group.indices.fill_null(-1).to_numpy(zero_copy_only=False)

    def tiles(self) -> Iterator[tuple[int, int]]:
        step = max(1, TILE // max(self.size, 1))
        for a in range(0, self.size, step):
            yield a, min(a + step, self.size)

    def pairs(self, a: int, b: int) -> np.ndarray:
        """For rows a:b against all rows from a on: the pairs of this unit
        (of its two blocks, in no earlier band together, not in one group)."""
        rest = slice(a, self.size)
        out = np.arange(a, self.size)[None, :] > np.arange(a, b)[:, None]
        if self.lo != self.hi:
            out &= self.own[rest][None, :] != self.own[a:b, None]
        if self.band >= 0:
            for k in range(self.bands.shape[1]):
                out &= self.bands[rest, k][None, :] != self.bands[a:b, k][:, None]
            if (self.group >= 0).any():
                out &= (self.group[rest][None, :] != self.group[a:b, None]) | (self.group[a:b, None] < 0)
        return out


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each unit that take part in a pair which belongs to it."""
    for unit, rows in _by_unit(batches):
        table = pa.Table.from_batches(rows).combine_chunks()
        held = Unit(unit, table)
        take = np.zeros(held.size, dtype=bool)
        for a, b in held.tiles():
            pairs = held.pairs(a, b)
            take[a:b] |= pairs.any(axis=1)
            take[a:] |= pairs.any(axis=0)
        if take.any():
            yield from table.filter(pa.array(take)).to_batches()
    release_memory()


class GramSets:
    """Gram sets of several texts; sizes of intersections as matrix products.

    Grams of one text alone are left out: no intersection has them."""

    def __init__(self, sets: list[np.ndarray]):
        self.count = np.array([len(s) for s in sets], dtype=np.int64)
        row = np.repeat(np.arange(len(sets)), self.count)
        _, gram, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = holders[gram] > 1
        row, gram = row[common], (np.cumsum(holders > 1) - 1)[gram[common]]
        order = np.argsort(gram, kind="stable")
        self._row, self._gram = row[order], gram[order]
        self._grams = int(gram.max()) + 1 if len(gram) else 0

    def common(self, a: int, b: int) -> np.ndarray:
        """Sizes of the intersections of sets a:b with all from a on."""
        n = len(self.count) - a
        out = np.zeros((b - a, n), dtype=np.float32)
        step = max(1, TILE // max(n, 1))
        for low in range(0, self._grams, step):
            x, y = np.searchsorted(self._gram, [low, low + step])
            row, gram = self._row[x:y] - a, self._gram[x:y] - low
            inside = row >= 0
            has = np.zeros((n, min(step, self._grams - low)), dtype=np.float32)
            has[row[inside], gram[inside]] = 1
            out += has[: b - a] @ has.T
        return out


def _stars(links: list[np.ndarray], size: int) -> np.ndarray:
    """The least row linked with each row, directly or through others; row i
    of the symmetric relation is the bits of ``links[i]`` (null: none)."""
    head = np.arange(size)
    seen = np.zeros(size, dtype=bool)
    for start in range(size):
        if seen[start] or links[start] is None:
            continue
        seen[start] = True
        stack = [start]
        while stack:
            i = stack.pop()
            head[i] = start
            new = np.flatnonzero(np.unpackbits(links[i], count=size).astype(bool) & ~seen)
            seen[new] = True
            stack += new.tolist()
    return head


def _verifier(opt: JoinOptions):  # noqa: ANN202
    size, threshold = opt.gram_words, opt.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit, rows in _by_unit(batches):
            table = pa.Table.from_batches(rows)
            keys = table.column("key").to_pylist()
            texts = table.column("text").to_pylist()
            held = Unit(unit, table)
            sets = []
            for a, b in row_slices(texts):
                grams, starts = _grams(texts[a:b], size)
                sets += [np.unique(grams[x:y]) for x, y in zip(starts[:-1], starts[1:], strict=True)]
            grams = GramSets(sets)
            count = grams.count
            n = len(keys)
            linked = np.zeros((n, (n + 7) // 8), dtype=np.uint8)
            for a, b in held.tiles():
                both = grams.common(a, b).astype(np.float64)
                near = both >= threshold * (count[a:][None, :] + count[a:b, None] - both) - 1e-9
                full = np.zeros((b - a, n), dtype=bool)
                full[:, a:] = near & held.pairs(a, b)
                linked[a:b] |= np.packbits(full, axis=1)
                for j in np.flatnonzero(full.any(axis=0)):  # the other half of the relation
                    other = np.zeros(n, dtype=bool)
                    other[a:b] = full[:, j]
                    linked[j] |= np.packbits(other)
            links = np.bitwise_count(linked).sum(axis=1).astype(np.int64)
            hit = np.flatnonzero(links)
            if len(hit):
                head = _stars([linked[i] if links[i] else None for i in range(n)], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in hit], type=pa.binary()),
                        pa.array([keys[head[i]] for i in hit], type=pa.binary()),
                        pa.array(links[hit]),
                    ],
                    names=["key", "head", "links"],
                )
        release_memory()

    return run


def _work_units(classes: DataFrame, opt: JoinOptions) -> DataFrame:
    """Rows of the work units that need a text: unit, own, key, grp, rep, bands."""
    banded = classes.select("key", "n_bytes", F.posexplode("bands").alias("band", "h"))
    buckets = (
        banded.groupBy("band", "h")
        .agg(F.count(F.lit(1)).alias("m"), F.sum("n_bytes").alias("bytes"))
        .where("m > 1")
        .select(F.col("band").alias("b_band"), F.col("h").alias("b_h"), "m", "bytes")
    )
    # null-safe, so that the counts get an exchange of their own and adaptive
    # execution can split a bucket that holds a large share of the rows
    on = F.col("band").eqNullSafe(F.col("b_band")) & F.col("h").eqNullSafe(F.col("b_h"))
    members = banded.join(buckets, on).select("key", "n_bytes", "band", "h", "m", "bytes").checkpoint()
    groups = hot_groups(members, opt).checkpoint()
    at = F.split("grp", ":")
    named = classes.select("key", "rep", "bands")
    in_group = _units(
        groups.select(F.col("g_key").alias("key"), "grp", "m", "bytes", (-1 - at[0].cast("int")).alias("band"), at[1].cast("bigint").alias("h")), opt
    )
    in_group = in_group.join(named.drop("bands"), "key").select(*_UNIT, "own", "key", "grp", "rep", F.lit(None).cast("array<bigint>").alias("bands"))
    apart = members.join(groups.select("g_key", "grp"), F.col("key").eqNullSafe(F.col("g_key")), "left")
    apart = apart.where(f"grp is null or m <= {opt.hot_classes}")
    narrow = _units(apart, opt).join(named, "key").select(*_UNIT, "own", "key", "grp", "rep", "bands")
    spread = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = narrow.repartition(spread, *_UNIT).sortWithinPartitions(*_UNIT, "key").mapInArrow(_needed, narrow.schema)
    return met.unionByName(in_group).checkpoint()


def ngram_join(
    docs: DataFrame, opt: JoinOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, classes, edges) of the similarity join.

    ``rows``: (id, tk, key) for each input row, null key for texts without
    words; tk is ``xxhash64`` of the text's bytes. ``classes``: one row per
    distinct word sequence, with key, rep (its least id, nulls last, and the
    tk there), n_rows and n_links (how many other classes reach the
    threshold). ``edges``: (key, head) pairs whose connected components are
    those of the link graph.
    """
    sig = signatures(docs, opt, id_col, text_col).checkpoint()
    classes = (
        sig.where("key is not null")
        .groupBy("key")
        .agg(
            F.min(F.struct(F.col("id").isNull().alias("none"), "id", "tk")).alias("rep"),
            F.count(F.lit(1)).alias("n_rows"),
            F.max("n_bytes").alias("n_bytes"),
            F.first("bands").alias("bands"),
        )
        .checkpoint()
    )
    needed = _work_units(classes, opt)
    # one text per representative, however often its row is repeated
    wanted = needed.select(F.col("rep.id").alias("w_id"), F.col("rep.tk").alias("w_tk")).distinct()
    texts = _keyed(docs, id_col, text_col)
    texts = texts.join(wanted, F.col("id").eqNullSafe(F.col("w_id")) & F.col("tk").eqNullSafe(F.col("w_tk")), "left_semi")
    texts = texts.groupBy(F.col("id").alias("t_id"), F.col("tk").alias("t_tk")).agg(F.first("text").alias("text"))
    wide = needed.join(texts, F.col("rep.id").eqNullSafe(F.col("t_id")) & F.col("rep.tk").eqNullSafe(F.col("t_tk")))
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        wide.select(*_UNIT, "own", "key", "grp", "bands", "text")
        .repartition(spread, *_UNIT)
        .sortWithinPartitions(*_UNIT, "key")
        .mapInArrow(_verifier(opt), "key binary, head binary, links bigint")
        .checkpoint()
    )
    linked = found.groupBy("key").agg(F.sum("links").alias("n_links"))
    table = classes.select("key", "rep", "n_rows").join(linked, "key", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0)))
    return sig.select("id", "tk", "key"), table, found.select("key", "head")


def near_duplicates(
    docs: DataFrame, opt: JoinOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: id, class_id, copy_of, n_copies, n_links.

    ``copy_of`` is the least id among the rows with the same words,
    ``n_copies`` their number, ``n_links`` the number of *different* word
    sequences at or above the threshold. ``class_id`` is the least id of
    the connected group over copies and links.

    A null or empty text, or one without words, is linked to nothing: its
    row has its own id as class_id and copy_of, n_copies 1 and n_links 0.
    Rows with a null id count as copies like others; if a whole group has
    no id its class_id is null. Repeated rows give repeated results; an
    empty table gives an empty one; other columns are not read.
    """
    rows, ids = grouped_rows(docs, opt, id_col, text_col)
    none = F.col("key").isNull()
    worded = rows.where(~none).join(ids, F.col("key").eqNullSafe(F.col("c_key")))
    out = ["id", "class_id", "copy_of", "n_copies", "n_links"]
    worded = worded.select("id", F.col("first.id").alias("class_id"), F.col("rep.id").alias("copy_of"), "n_copies", "n_links")
    alone = rows.where(none).select(
        "id", F.col("id").alias("class_id"), F.col("id").alias("copy_of"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links")
    )
    return worded.select(*out).unionByName(alone).withColumnRenamed("id", id_col)


def grouped_rows(
    docs: DataFrame, opt: JoinOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): (id, tk, key) of each input row as ``ngram_join`` has
    them; and per class c_key, first (none, id, tk: the least row of its
    connected group, null ids last), rep (its own least row), n_copies, n_links."""
    rows, classes, edges = ngram_join(docs, opt, id_col, text_col)
    parts = connected_components(edges, "key", "head")
    grouped = classes.join(parts.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = grouped.where("n_links > 0").groupBy("root").agg(F.min("rep").alias("least"))
    ids = grouped.join(least, "root", "left").select(
        F.col("key").alias("c_key"),
        F.when(F.col("n_links") > 0, F.col("least")).otherwise(F.col("rep")).alias("first"),
        "rep",
        F.col("n_rows").alias("n_copies"),
        "n_links",
    )
    return rows, ids
