"""The corpus pipeline's stages against their operators and brute force."""

import hashlib

import pytest

import corpus_pipeline as C
from strata.llm.decontaminate import item_words
from strata.llm.queries import tokenizer_path
from strata.llm.textops import normalised
from strata.llm.token_counts import load_tokenizer
from tests.conftest import SF0001

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").cache()
    out = [docs]
    for _, stage in C.STAGES:
        out.append(stage(spark, out[-1], SF0001).cache())
    return out


def _rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages_are_the_named_ones():
    assert [n for n, _ in C.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "benchmark decontamination", "BPE encoding and decoding"]


def test_filters_keep_columns_and_rows_unchanged(steps):
    for before, after in zip(steps[:3], steps[1:4]):
        assert after.columns == before.columns
        old, new = _rows(before), _rows(after)
        assert after.count() == len(new) and all(old[i] == r for i, r in new.items())


def test_quality_keeps_the_clean_and_drops_the_bad(spark, steps):
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF0001}/labels.parquet").collect()}
    kept = set(_rows(steps[1]))
    good, bad = [i for i in label if label[i] == 1], [i for i in label if label[i] == 0]
    assert len([i for i in good if i in kept]) >= 0.95 * len(good)
    assert len([i for i in bad if i in kept]) <= 0.25 * len(bad)


def test_one_document_of_each_group_stays(steps):
    before, after = _rows(steps[2]), _rows(steps[3])
    grams = {}
    for i, r in before.items():
        w = normalised((r.text or "").encode()).split()
        grams[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(before)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if grams[a] and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert set(after) == {find(i) for i in ids}


def test_no_long_benchmark_run_is_left(spark, steps):
    bench = [item_words(r.text.encode()) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in bench for k in range(len(w) - 9)}
    has = lambda t: any(tuple(w[k : k + 10]) in windows for w in [item_words((t or "").encode())] for k in range(len(w) - 9))
    before, after = _rows(steps[3]), _rows(steps[4])
    assert steps[4].columns == steps[3].columns
    dirty = {i for i, r in before.items() if has(r.text)}
    assert dirty and not any(has(r.text) for r in after.values())
    assert all(after[i] == r for i, r in before.items() if i not in dirty)
    assert all(r.n_chars == len(r.text) for i, r in after.items() if i in dirty)


def test_last_stage_encodes_what_is_left(steps):
    tokenizer = load_tokenizer(tokenizer_path())
    left = _rows(steps[4])
    rows = _rows(steps[5])
    assert set(rows) == set(left)
    for i, r in rows.items():
        ids = tokenizer.encode(left[i].text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_run_equals_the_stages(spark, steps):
    got = {(r.doc_id, r.ids_sha256) for r in C.run(spark, SF0001).collect()}
    assert got == {(r.doc_id, r.ids_sha256) for r in steps[5].collect()}


def test_odd_documents_pass_through(spark):
    prose = "The wind came over the hill, and the rain followed it down to the old town by the river. Nobody went out that day."
    rows = [(0, prose, "en", "s", 1), (0, prose, "en", "s", 1), (None, None, None, None, None), (2, "", "en", "s", 0), (3, None, "xx", "s", 0), (4, prose.upper(), "en", "s", 1), (5, "y" * 200_000, "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "'mine' as quality", "1 as spans", "2 as n_tokens")
    for name, stage in C.STAGES[:4]:
        out = stage(spark, df, SF0001)
        assert out.columns == df.columns, name
        assert out.count() <= len(rows)
        assert stage(spark, df.where("doc_id < 0"), SF0001).count() == 0
    kept = C.near_duplicate_stage(spark, df, SF0001).collect()
    assert sorted((str(r.doc_id) for r in kept)) == ["0", "2", "3", "5", "None"]
    assert C.bpe_stage(spark, df, SF0001).count() == len(rows)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    words = "The wind came over the hill and the rain followed it down to the old town by the river and nobody went out that day".split()
    a, near = " ".join(words), " ".join([*words, "again"])
    rows = [(0, a), (None, a), (None, a), (None, ""), (1, a), (1, near), (7, "quite another text that stands alone here"), (7, "quite another text that stands alone here"), (8, None), (8, None)]
    df = spark.createDataFrame([(i, t, "en", f"s{k}", 1) for k, (i, t) in enumerate(rows)], DOCS)
    kept = C.near_duplicate_stage(spark, df, SF0001)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    assert got == sorted([(0, a), (None, ""), (7, rows[6][1]), (8, None), (8, None)], key=repr)
    none = [(None, a, "en", "s", 1)] * 40
    assert C.near_duplicate_stage(spark, spark.createDataFrame(none, DOCS), SF0001).count() == 1
