"""Decontamination against a brute-force window search."""

import random

import pytest

from strata.llm.decontaminate import Automaton, DecontaminationOptions, cut_spans, decontaminate, find_contamination, item_words
from strata.llm.queries import QUERIES
from tests.conftest import SF0001

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(words, items, length=10, coverage=1.0):
    import math

    hit, found = set(), set()
    for item, own in items:
        if not own:
            continue
        k = max(1, min(length, math.ceil(coverage * len(own) - 1e-9)))
        windows = {tuple(own[p : p + k]) for p in range(len(own) - k + 1)}
        for p in range(len(words) - k + 1):
            if tuple(words[p : p + k]) in windows:
                hit.update(range(p, p + k))
                found.add(item)
    return hit, found


@pytest.mark.parametrize("coverage", [1.0, 0.5])
def test_automaton_equals_brute_force(coverage):
    rnd = random.Random(5)
    opt = DecontaminationOptions(length=4, coverage=coverage)
    for _ in range(300):
        items = [(str(k), [rnd.choice([b"a", b"b", b"c", b"d"]) for _ in range(rnd.randint(0, 9))]) for k in range(rnd.randint(0, 5))]
        words = [rnd.choice([b"a", b"b", b"c", b"d", b"z"]) for _ in range(rnd.randint(0, 40))]
        spans, found = Automaton(items, opt).find(words)
        hit, want = brute(words, items, 4, coverage)
        assert found == want
        assert {i for lo, hi in spans for i in range(lo, hi)} == hit
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _bench(spark):
    return spark.createDataFrame(
        [(1, "Alpha beta gamma, delta epsilon zeta eta theta iota kappa lambda"), (2, "short ITEM"), (3, None), (4, ""), (11, "short item"), (None, "no id at all here")],
        "item_id bigint, text string",
    )


def test_spans_items_and_text(spark):
    ten = "alpha BETA gamma delta epsilon; zeta eta theta iota kappa"
    rows = [(0, f"before {ten} after"), (1, "a short item here"), (2, None), (3, ""), (4, "alpha beta gamma"), (5, "short\nItem"), (5, "short\nItem"), (None, "clean words only")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    got = {(r.doc_id, r.text): r for r in find_contamination(df, _bench(spark)).collect()}
    r = got[(0, rows[0][1])]
    assert (r.n_words, r.n_hit, r["items"], [tuple(s) for s in r.spans]) == (12, 10, ["1"], [(1, 11)])
    assert got[(1, "a short item here")]["items"] == ["11", "2"]
    assert got[(2, None)].n_words == 0 and got[(4, "alpha beta gamma")].n_hit == 0
    clean = sorted(((r.doc_id, r.text, r.n_chars) for r in decontaminate(df, _bench(spark), DecontaminationOptions(max_share=0.9)).collect()), key=repr)
    # only documents that are contaminated by more than the share go
    assert clean == sorted([(0, "before  after", 13), (1, "a  here", 7), (2, None, 0), (3, "", 0), (4, "alpha beta gamma", 16), (None, "clean words only", 16)], key=repr)


def test_shards_and_cut_items_change_nothing(spark):
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(rnd.randint(1, 80)))) for k in range(12)]
    texts = []
    for k in range(30):
        own = " ".join(word() for _ in range(rnd.randint(0, 50)))
        _, item = rnd.choice(items)
        texts.append((k, f"{own} {item}" if k % 2 else own))
    bench = spark.createDataFrame(items, "item_id int, text string")
    df = spark.createDataFrame(texts, "doc_id int, text string")
    small = DecontaminationOptions(shard_words=60, shards_per_job=2)
    for opt in (DecontaminationOptions(), small):
        for r in find_contamination(df, bench, opt).collect():
            hit, found = brute(item_words(r.text.encode()), [(str(i), item_words(t.encode())) for i, t in items])
            assert (r.n_hit, set(r["items"])) == (len(hit), found)


def test_empty_tables_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "short item", 5, "mine")], "doc_id int, text string, Spans int, other string")
    assert find_contamination(df, _bench(spark)).columns == ["doc_id", "text", "other", "n_words", "spans", "n_hit", "items"]
    none = _bench(spark).where("item_id < 0")
    r = find_contamination(df, none).first()
    assert (r.n_words, r.n_hit, r["items"]) == (2, 0, [])
    assert find_contamination(df.where("doc_id < 0"), _bench(spark)).count() == 0
    assert decontaminate(df, none).columns == df.columns


def test_cut_keeps_the_rest():
    assert cut_spans("One, two. Drei vier fünf!".encode(), [(1, 3)]) == "One,  vier fünf!".encode()


def test_query_equals_brute_force(spark):
    import hashlib

    bench = [(str(r.item_id), item_words(r.text.encode())) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    docs = {r.doc_id: item_words((r.text or "").encode()) for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    rows = QUERIES["op4_decontamination"](spark, SF0001).collect()
    assert len(rows) == len(docs)
    for r in rows:
        hit, found = brute(docs[r.doc_id], bench)
        ids = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(docs[r.doc_id]), len(hit), len(found), ids, bool(hit))


def test_clashing_names_and_repeated_items(spark):
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    names = ["doc_id", "text", "n_words", "items", "n_hit", "spans", "__text", "row", "n_chars"]
    df = spark.createDataFrame([(1, f"before {ten} after then more words to keep it all", "w", "i", "h", "s", "t", "r", 9), (2, "clean", "w", "i", "h", "s", "t", "r", 5)], names)
    out = decontaminate(df, _bench(spark), DecontaminationOptions(max_share=0.9))
    assert out.columns == names
    rows = sorted(out.collect())
    assert [tuple(r)[2:8] for r in rows] == [("w", "i", "h", "s", "t", "r")] * 2
    assert rows[0].n_chars == len(rows[0].text) < 60 and rows[1].n_chars == 5 and ten not in rows[0].text
    hits = find_contamination(df, _bench(spark)).collect()
    assert sorted(r.n_hit for r in hits) == [0, 10]


def test_a_third_of_the_benchmark_is_one_item(spark):
    from strata.llm.decontaminate import benchmark_shards

    rows = [(7, "one item that is there very often and has some words")] * 400 + [(k, f"item {k} " + "of its own " * 3) for k in range(800)]
    opt = DecontaminationOptions(shard_words=500)
    shards = list(benchmark_shards(spark.createDataFrame(rows, "item_id bigint, text string"), opt))
    assert sum(len(s) for s in shards) == 801
    assert all(sum(len(w) for _, w in s) <= opt.shard_words for s in shards)
