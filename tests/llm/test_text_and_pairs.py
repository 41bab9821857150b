"""N-gram join, components and text helpers against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import textops as X
from strata.llm.components import connected_components
from strata.llm.ngram_join import JoinOptions, choose_bands, near_duplicates, ngram_join

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def grams(text):
    w = (text or "").encode().translate(X.TO_WORDS).split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_links(texts):
    """links of each distinct word sequence, by brute force"""
    seqs = {}
    for t in texts:
        w = X.normalised((t or "").encode())
        if w:
            seqs[w] = grams(t)
    links = dict.fromkeys(seqs, 0)
    edges = []
    for a, b in itertools.combinations(seqs, 2):
        if len(seqs[a] & seqs[b]) >= 0.8 * len(seqs[a] | seqs[b]):
            links[a] += 1
            links[b] += 1
            edges.append((a, b))
    return links, edges


def test_words_match_plain_python():
    texts = [b"", b"Hello, W\xc3\xb6rld 12", b"  a--b  ", "één\x00Zwei".encode(), b"\xff\xfe raw"]
    w = X.words_of(texts)
    got = [[bytes(w.buf[w.start[i] : w.end[i]]) for i in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [t.translate(X.TO_WORDS).split() for t in texts]


def test_span_hash_is_equal_anywhere():
    w = X.words_of([b"abc x abc", b"xx abc abcd"])
    h = X.word_hash(w)
    assert h[0] == h[2] == h[4] and h[0] != h[5] and len({int(x) for x in h}) == 4


def test_banding_reaches_its_recall():
    bands, rows = choose_bands(0.8, 0.999, 128)
    assert bands * rows <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.999
    with pytest.raises(ValueError):
        choose_bands(0.1, 0.9999, 4)


@pytest.mark.parametrize("opt", [JoinOptions(block_classes=3), JoinOptions(hot_classes=2), JoinOptions(block_classes=3, hot_classes=1)])
def test_join_equals_brute_force(spark, opt):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(words) for _ in range(rnd.randint(1, 120))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            near = list(base)
            for _ in range(rnd.randint(0, 3)):
                near[rnd.randrange(len(near))] = rnd.choice(words)
            texts.append(" ".join(near).upper() if rnd.random() < 0.3 else ", ".join(near))
    texts += ["", None, "!!!", "!!!", "one", "one", "one two three four", "ONE two three. four"]
    # tiny blocks, so that pairs of blocks are exercised too
    got = near_duplicates(docs_of(spark, texts), opt).collect()
    links, edges = brute_links(texts)
    assert len(got) == len(texts)
    keys = [X.normalised((t or "").encode()) for t in texts]
    root = {k: k for k in links}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        root[find(a)] = find(b)
    group = {}
    for i, k in enumerate(keys):
        if k:
            group.setdefault(find(k), []).append(i)
    for r in got:
        k = keys[r.doc_id]
        if not k:
            assert (r.class_id, r.copy_of, r.n_copies, r.n_links) == (r.doc_id, r.doc_id, 1, 0)
        else:
            assert r.n_links == links[k]
            assert r.copy_of == keys.index(k) and r.n_copies == keys.count(k)
            assert r.class_id == min(group[find(k)])


def test_join_with_null_and_repeated_ids_and_clashing_columns(spark):
    a, b = "red green blue black white grey pink gold", "one two three four five six seven"
    df = docs_of(spark, [a, a, b, None, b, a], [None, 5, 7, None, 7, 7]).withColumnRenamed("lang", "key").withColumnRenamed("source", "bands")
    got = sorted(((r.doc_id, r.class_id, r.n_copies, r.n_links) for r in near_duplicates(df).collect()), key=repr)
    # row ids may repeat under different texts; classes go by the words
    assert got == sorted([(None, 5, 3, 0), (5, 5, 3, 0), (7, 7, 2, 0), (None, None, 1, 0), (7, 7, 2, 0), (7, 5, 3, 0)], key=repr)


def test_join_of_empty_table_and_long_text(spark):
    assert near_duplicates(docs_of(spark, []).where("doc_id < 0")).count() == 0
    rnd = random.Random(1)
    long = " ".join(f"t{rnd.randrange(10**6)}" for _ in range(60_000))
    got = near_duplicates(docs_of(spark, [long, long + " end", "x " * 50])).orderBy("doc_id").collect()
    assert [(r.class_id, r.n_links) for r in got] == [(0, 1), (0, 1), (2, 0)]


def test_hot_near_copies_emit_no_pairs(spark):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join([*base, f"x{k}"]) for k in range(300)]
    rows, classes, edges = ngram_join(docs_of(spark, texts), JoinOptions(block_classes=50))
    assert {r.n_links for r in classes.collect()} == {299}
    # edges are stars, not pairs: far fewer than 300 * 299 / 2
    assert edges.count() < 300 * 21


def near_copies(n, words=60):
    base = [f"w{k}" for k in range(words)]
    return [" ".join([f"x{k}" if p == k % words else w for p, w in enumerate(base)]) for k in range(n)]


def test_hot_group_is_sent_once(spark):
    from strata.llm.ngram_join import _work_units, signatures

    rows = {}
    for n in (500, 1000, 2000):
        sig = signatures(docs_of(spark, near_copies(n)))
        classes = sig.groupBy("key").agg(F.first("id").alias("rep"), F.max("n_bytes").alias("n_bytes"), F.first("bands").alias("bands")).checkpoint()
        rows[n] = _work_units(classes, JoinOptions()).count()
    # each class once in its group, and some more in the buckets of the few that are not hot
    assert rows[2000] <= 2.6 * rows[1000] <= 2.6 * 2.6 * rows[500] and rows[2000] < 2000 * 6


def test_links_of_a_hot_group_with_blocks(spark):
    texts = near_copies(420, 100) + [f"other {k} " * 9 for k in range(5)]
    links, _ = brute_links(texts)
    got = near_duplicates(docs_of(spark, texts), JoinOptions(block_classes=100, hot_classes=60)).collect()
    assert {r.doc_id: r.n_links for r in got} == {i: links[X.normalised(t.encode())] for i, t in enumerate(texts)}


def test_components_of_paths_stars_and_cycles(spark):
    e = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 150)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 1)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(e, "a long, b long"), "a", "b").collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 150), 100), 200: 200, 201: 200, 202: 200}
    none = connected_components(spark.createDataFrame([], "a long, b long"), "a", "b")
    assert none.count() == 0


def test_gram_hash_of_short_and_long_runs():
    w = X.words_of([b"a b", b"a b", b"b a", b"", b"a b c d e", b"a b c d e f"])
    g, at = X.gram_hash(X.word_hash(w), w.first, 5)
    assert np.diff(at).tolist() == [1, 1, 1, 0, 1, 2]
    assert g[0] == g[1] != g[2] and g[3] == g[4] != g[5]


def test_query_matches_brute_force(spark):
    from tests.conftest import SF0001

    from strata.llm.queries import QUERIES

    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op3_ngram_jaccard"](spark, SF0001)
    assert got.columns == ["doc_id", "class_id", "copy_of", "n_copies", "n_links"]
    links, _ = brute_links([d.text for d in docs])
    text = {d.doc_id: X.normalised((d.text or "").encode()) for d in docs}
    rows = got.collect()
    assert len(rows) == len(docs) and all(r.n_links == links.get(text[r.doc_id], 0) for r in rows)
    assert got.where(F.col("class_id") > F.col("doc_id")).count() == 0
