"""Ranked lexical search by presence masks.

Terms are runs of ASCII letters, digits and non-ASCII characters with A-Z
lower-cased. Every query is ranked against all documents; the score is a
saturated term frequency with integer arithmetic (see ``score_part``).

1. One pass turns each document into the query terms that it holds, with
   their counts (terms are matched by 64-bit hashes against the sorted
   vocabulary of the queries), and its length. The table is stored. Number
   of documents and terms and the document frequencies are counted from it
   in Spark.
2. A second pass takes blocks of documents. For each query, bitmap
   operations over the postings of its terms give every document's mask of
   matched terms; documents are grouped by mask. A mask's highest possible
   score follows from the block's best part of each of its terms. Masks are
   evaluated by descending bound until the ``k``-th best score found in the
   task is above all bounds left, so skipped masks can't hold a result.
3. Each task returns ``k`` rows per query at most; Spark ranks these.

Equal queries are searched once. Queries are dealt into shards of bounded
size, one pass of the corpus each, so what is broadcast does not grow with
the queries or the corpus. No document leaves its task but for the results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_dir
from .frames import release_memory
from .textops import normalised, row_slices, texts_of, word_hash, words_of


@dataclass(frozen=True)
class SearchOptions:
    k: int = 20
    # Documents of a block, in which masks are grouped.
    block_docs: int = 8192
    block_postings: int = 1_000_000
    # Size of a shard of queries: words, repeats included, and their bytes.
    shard_words: int = 100_000
    shard_bytes: int = 4 << 20


DEFAULT = SearchOptions()


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def score_part(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The factor of a term's weight: tf against the document's relative length."""
    m = 100 - 25 + (25 * n * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


@dataclass
class Query:
    """A query's distinct terms as vocabulary numbers, and their repeats."""

    key: int
    terms: np.ndarray
    repeats: np.ndarray


class Block:
    """Postings of a block of documents: documents and score parts by term."""

    def __init__(self, n: np.ndarray, sizes: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int):
        self.size = len(n)
        doc = np.repeat(np.arange(len(n)), sizes)
        part = score_part(counts, n[doc], n_docs, n_terms)
        order = np.argsort(terms, kind="stable")  # documents stay ascending within a term
        self.docs, self.parts, terms = doc[order], part[order], terms[order]
        self._names, first = np.unique(terms, return_index=True)
        self._first = np.concatenate((first, [len(terms)]))
        self._best = np.maximum.reduceat(self.parts, first) if len(first) else first

    def posting(self, term: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Documents with ``term``, their parts, and the best of these."""
        at = int(np.searchsorted(self._names, term))
        if at == len(self._names) or self._names[at] != term:
            return self.docs[:0], self.parts[:0], 0
        a, b = self._first[at], self._first[at + 1]
        return self.docs[a:b], self.parts[a:b], int(self._best[at])

    def masks(self, postings: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Presence bitmaps: one row per document, 64 of the terms a column."""
        out = np.zeros((self.size, (len(postings) + 63) // 64), dtype=np.uint64)
        for j, (docs, _, _) in enumerate(postings):
            out[docs, j // 64] |= np.uint64(1) << np.uint64(j % 64)
        return out

    def search(self, query: Query, weights: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of at least ``floor`` and above 0 that may be
        among the best ``k``, ties at the last place included."""
        held = [self.posting(t) for t in query.terms]
        factors = weights[query.terms] * query.repeats
        masks = self.masks(held)
        found = np.flatnonzero(masks.any(axis=1))
        if not len(found):
            return found, found
        if masks.shape[1] == 1:
            kinds, group = np.unique(masks[found, 0], return_inverse=True)
            kinds = kinds[:, None]
        else:
            kinds, group = np.unique(masks[found], axis=0, return_inverse=True)
            group = group.ravel()
        bits = np.stack([(kinds[:, j // 64] >> np.uint64(j % 64)) & np.uint64(1) for j in range(len(held))], axis=1).astype(bool)
        bound = bits @ np.array([f * best for f, (_, _, best) in zip(factors.tolist(), held, strict=True)], dtype=np.int64)
        by_group = np.argsort(group, kind="stable")
        first = np.concatenate((np.searchsorted(group[by_group], np.arange(len(kinds))), [len(found)]))
        docs: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        best = np.zeros(0, dtype=np.int64)  # the best k scores so far
        floor = max(floor, 1)
        for g in np.argsort(-bound, kind="stable"):
            if bound[g] < floor:
                break
            own = found[by_group[first[g] : first[g + 1]]]
            total = np.zeros(len(own), dtype=np.int64)
            for j in np.flatnonzero(bits[g]):
                where, parts, _ = held[j]
                total += factors[j] * parts[np.searchsorted(where, own)]
            keep = total >= floor
            docs.append(own[keep])
            scores.append(total[keep])
            best = np.sort(np.concatenate((best, total[keep])))[-k:]
            if len(best) == k:
                floor = max(floor, int(best[0]))
        if not docs:
            return found[:0], found[:0]
        doc, score = np.concatenate(docs), np.concatenate(scores)
        keep = score >= floor
        return doc[keep], score[keep]


def _indexer(vocabulary: np.ndarray):  # noqa: ANN202
    """Per document: n (its terms) and the query terms it holds, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, number = np.sort(vocabulary), np.argsort(vocabulary)
        size = np.uint64(max(len(names), 1))
        for batch in batches:
            texts = texts_of(batch.column("text"))
            for a, b in row_slices(texts):
                w = words_of(texts[a:b])
                hashes = word_hash(w)
                at = np.searchsorted(names, hashes)
                hit = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == hashes) if len(names) else at[:0]
                code, count = np.unique(w.doc[hit].astype(np.uint64) * size + number[at[hit]].astype(np.uint64), return_counts=True)
                doc = (code // size).astype(np.int64)
                offsets = pa.array(np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(a, b - a),
                        pa.array(w.count()),
                        pa.ListArray.from_arrays(offsets, pa.array((code % size).astype(np.int32))),
                        pa.ListArray.from_arrays(offsets, pa.array(count.astype(np.int64))),
                    ],
                    names=["id", "n", "terms", "counts"],
                )
        release_memory()

    return run


def _searcher(queries: list[Query], weights: np.ndarray, n_docs: int, n_terms: int, opt: SearchOptions):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # per query the task's best rows so far: (score, id) with the ids as Arrow arrays
        best: dict[int, tuple[np.ndarray, pa.Array]] = {}

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            ids = table.column("id").combine_chunks()
            sizes = np.diff(np.concatenate(([0], np.cumsum(table.column("terms").combine_chunks().value_lengths().to_numpy()))))
            flat = [pa.chunked_array([c.flatten() for c in table.column(name).chunks]).to_numpy() for name in ("terms", "counts")]
            block = Block(table.column("n").to_numpy(), sizes, flat[0], flat[1], n_docs, n_terms)
            for q, query in enumerate(queries):
                old = best.get(q)
                floor = int(old[0].min()) if old is not None and len(old[0]) >= opt.k else 0
                doc, score = block.search(query, weights, opt.k, floor)
                if not len(doc):
                    continue
                own = ids.take(pa.array(doc))
                if old is not None:
                    score, own = np.concatenate((old[0], score)), pa.concat_arrays([old[1], own])
                if len(score) > opt.k:  # ties go by id, nulls last
                    order = pc.sort_indices(
                        pa.table({"s": -score, "id": own}), sort_keys=[("s", "ascending"), ("id", "ascending")], null_placement="at_end"
                    ).slice(0, opt.k)
                    score, own = score[order.to_numpy()], own.take(order)
                best[q] = (score, own)

        held: list[pa.RecordBatch] = []
        docs = postings = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            docs += batch.num_rows
            postings += len(batch.column("terms").flatten())
            if docs >= opt.block_docs or postings >= opt.block_postings:
                search(held)
                held, docs, postings = [], 0, 0
        if held:
            search(held)
        for q, (score, own) in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([queries[q].key] * len(score), type=pa.int64()), own, pa.array(score)], names=["q", "id", "score"]
            )
        release_memory()

    return run


def _query_words(items: DataFrame, text_col: str) -> DataFrame:
    """(own row, key, words): the query's words, in order and joined by a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [normalised(t) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item"), pa.array(words, type=pa.binary())], names=["item", "words"])

    src = items.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(items.columns)]).alias("item"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    kind = src.schema["item"].dataType.simpleString()
    return src.mapInArrow(run, f"item {kind}, words binary").where("octet_length(words) > 0").withColumn("key", F.xxhash64("words"))


def search(
    docs: DataFrame, items: DataFrame, opt: SearchOptions = DEFAULT, id_col: str = "doc_id", text_col: str = "text", query_col: str = "text"
) -> DataFrame:
    """The best ``k`` documents of every row of ``items``: its columns, then
    rank (from 1), ``doc`` (the document's id) and score (above 0).

    Equal scores rank by ascending id, null ids last; among rows that share
    an id the order is arbitrary but ranks stay unique. Every row of
    ``docs`` is a document of its own, also a repeated one. A null or empty
    text has no terms: such a document is not counted and not found, such a
    query has no result. Repeated queries give repeated results. Empty
    tables give an empty result.
    """
    spark = docs.sparkSession
    asked = _query_words(items, query_col).checkpoint()
    distinct = asked.groupBy("words").agg(F.first("key").alias("key")).checkpoint()
    total = distinct.agg(F.sum(F.size(F.split(F.col("words").cast("string"), " "))).alias("n"), F.sum(F.octet_length("words")).alias("b")).first()
    shards = 1
    if (total["n"] or 0) > opt.shard_words or (total["b"] or 0) > opt.shard_bytes:
        shards = 2 * max(-(-total["n"] // opt.shard_words), -(-total["b"] // opt.shard_bytes))
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    found = spark.createDataFrame([], f"q bigint, id {id_type}, score bigint")
    sizes = None
    for shard in range(shards):
        own = distinct.where(F.pmod(F.hash("key"), F.lit(shards)) == shard) if shards > 1 else distinct
        words = {r["key"]: bytes(r["words"]).split(b" ") for r in own.select("key", "words").collect()}
        names = sorted({w for ws in words.values() for w in ws})
        if not names:
            continue
        number = {w: k for k, w in enumerate(names)}
        queries = []
        for key, ws in words.items():
            terms, repeats = np.unique([number[w] for w in ws], return_counts=True)
            queries.append(Query(key, terms, repeats.astype(np.int64)))
        path = scratch_dir(spark, "query-terms")
        src.mapInArrow(_indexer(word_hash(words_of(names))), f"id {id_type}, n bigint, terms array<int>, counts array<bigint>").write.parquet(path)
        index = spark.read.parquet(path)
        if sizes is None:
            sizes = index.where("n > 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not sizes["docs"]:
            break
        weights = np.full(len(names), term_weight(sizes["docs"], 0), dtype=np.int64)
        for r in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the shard
            weights[r["t"]] = term_weight(sizes["docs"], r["count"])
        best = index.where("size(terms) > 0").mapInArrow(_searcher(queries, weights, sizes["docs"], sizes["terms"], opt), f"q bigint, id {id_type}, score bigint")
        found = found.unionByName(best)
    # every task may hold k rows of a query: these are ranked in parts first
    best_first = [F.desc("score"), F.asc_nulls_last("id")]
    part = F.pmod(F.hash("id"), F.lit(64))
    fewer = found.withColumn("rank", F.row_number().over(Window.partitionBy("q", part).orderBy(*best_first))).where(F.col("rank") <= opt.k)
    top = fewer.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*best_first))).where(F.col("rank") <= opt.k)
    joined = asked.select("item", "key").join(top, F.col("key") == F.col("q"))
    return joined.select(
        *[F.col(f"item.c{k}").alias(c) for k, c in enumerate(items.columns)], "rank", F.col("id").alias("doc"), "score"
    )
