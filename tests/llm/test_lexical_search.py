"""Ranked lexical search against a plain scan of all documents."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from strata.llm.lexical_search import Block, Query, SearchOptions, search, term_weight

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(bool(b) for _, b in bags)
    n_terms = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for i, bag in bags:
            if not bag:
                continue
            m = 75 + (25 * sum(bag.values()) * n_docs) // n_terms
            s = sum(term_weight(n_docs, df[t]) * ((10**9 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in terms(text) if t in bag)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def check(spark, docs, items, opt):
    got = search(docs_of(spark, docs), items_of(spark, items), opt)
    assert sorted(((r.item_id, r["rank"], r.doc, r.score) for r in got.collect()), key=repr) == brute(docs, items, opt.k)


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(40)] + ["Ünï", "the", "THE", "7"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 30])))) for i in range(n)]
    items = [(q, ", ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12)))) for q in range(25)]
    return docs, items


@pytest.mark.parametrize("block", [7, 64, 8192])
def test_equals_plain_scan(spark, block):
    docs, items = corpus(block, 300)
    check(spark, docs, items, SearchOptions(k=5, block_docs=block))


def test_query_shards_give_the_same(spark):
    docs, items = corpus(4, 120)
    check(spark, docs, items, SearchOptions(k=20, shard_words=40))


def test_more_than_64_terms(spark):
    rnd = random.Random(8)
    words = [f"t{k}" for k in range(150)]
    docs = [(i, " ".join(rnd.sample(words, rnd.randint(1, 90)))) for i in range(80)]
    check(spark, docs, [(1, " ".join(words)), (2, " ".join(words[::2] * 3))], SearchOptions(k=7, block_docs=16))


def test_ties_nulls_repeats_and_long_texts(spark):
    docs = [(None, "red fox"), (3, "red fox"), (3, "red fox"), (1, "Red, fox!"), (9, None), (8, ""), (7, "..."), (5, "blue " * 30_000 + "fox")]
    docs += [(k, "green tree") for k in range(100, 140)]
    items = [(1, "fox"), (1, "fox"), (None, "red fox fox"), (2, None), (3, ""), (4, "unknown"), (5, "tree")]
    check(spark, docs, items, SearchOptions(k=20))


def test_empty_tables_and_clashing_names(spark):
    none = search(docs_of(spark, []), items_of(spark, [(1, "a")]))
    assert none.collect() == [] and none.columns == ["item_id", "text", "rank", "doc", "score"]
    assert search(docs_of(spark, [(1, "a")]), items_of(spark, [])).collect() == []
    df = spark.createDataFrame([(1, "a b", 5, 6)], "id int, text string, q int, score int")
    assert [tuple(r) for r in search(df, items_of(spark, [(1, "a")]), id_col="id").select("item_id", "rank", "doc").collect()] == [(1, 1, 1)]


def test_masks_below_the_floor_are_skipped():
    # 3 documents hold both terms, 100 one: with k = 3 the mask of one term is never evaluated
    sizes = np.array([2] * 3 + [1] * 100)
    flat = np.array([0, 1] * 3 + [0] * 100)
    block = Block(np.full(103, 10), sizes, flat, np.ones(len(flat), dtype=np.int64), 103, 1030)
    doc, score = block.search(Query(1, np.array([0, 1]), np.array([1, 1])), np.array([50, 900]), 3, 0)
    assert sorted(doc.tolist()) == [0, 1, 2] and len(set(score.tolist())) == 1
