"""Substring deduplication against a brute-force window comparison."""

import random

import numpy as np
import pytest

from strata.llm.substring_dedup import SubstringOptions, Windows, _sliding_min, merge_spans, remove_repeats, window_runs
from strata.llm.textops import NOT_SPACE, words_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute(rows, window):
    """(kept text, n_words, removed positions) per row of (id, text)."""
    split = [(i, (t or "").split()) for i, t in rows]
    least = {}
    for i, ws in split:
        if i is not None:
            for p in range(len(ws) - window + 1):
                key = tuple(ws[p : p + window])
                least[key] = min(i, least.get(key, i))
    out = []
    for i, ws in split:
        gone = set()
        if i is not None:
            for p in range(len(ws) - window + 1):
                if least[tuple(ws[p : p + window])] < i:
                    gone.update(range(p, p + window))
        out.append((" ".join(w for p, w in enumerate(ws) if p not in gone), len(ws), gone))
    return out


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)


def check(spark, rows, window):
    got = remove_repeats(docs_of(spark, rows), SubstringOptions(window)).collect()
    want = brute(rows, window)
    left = sorted(((r.doc_id, r.text, r.n_words, r.n_removed, frozenset(p for s in r.spans for p in range(s.start, s.end))) for r in got), key=repr)
    right = sorted(((i, None if t is None else k, n, len(g), frozenset(g)) for (i, t), (k, n, g) in zip(rows, want, strict=True)), key=repr)
    assert left == right


def test_sliding_minimum():
    x = np.random.default_rng(1).integers(0, 1000, 57).astype(np.uint64)
    for width in (1, 2, 3, 7, 26, 57):
        assert _sliding_min(x, width).tolist() == [min(x[k : k + width]) for k in range(len(x) - width + 1)]


def test_runs_cover_every_window_once():
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))).encode() for _ in range(40)]
    opt = SubstringOptions(6)
    w = words_of(texts, NOT_SPACE, lower=False)
    text, pos, n, _, _ = window_runs(w, opt)
    got = sorted((int(t), int(p) + k) for t, p, m in zip(text, pos, n, strict=True) for k in range(m))
    assert got == [(d, p) for d, t in enumerate(texts) for p in range(len(t.split()) - 5)]


def test_equal_windows_have_equal_hashes():
    a, b = b"x y z a b c d", b"q a b c d"
    one, two = (Windows(words_of([t], NOT_SPACE, lower=False)).hashes(4) for t in (a, b))
    assert one[3] == two[1] and len({*one.tolist(), *two.tolist()}) == 5


def test_spans_merge():
    assert merge_spans([(10, 1), (0, 2), (4, 1), (30, 3)], 4) == [(0, 8), (10, 14), (30, 36)]


@pytest.mark.parametrize("window", [2, 5, 8])
def test_equals_brute_force(spark, window):
    rnd = random.Random(window)
    words = [f"w{k}" for k in range(60)]
    shared = [[rnd.choice(words) for _ in range(rnd.randint(4, 30))] for _ in range(6)]
    rows = []
    for i in range(120):
        ws = []
        for _ in range(rnd.randint(0, 4)):
            ws += [rnd.choice(words) for _ in range(rnd.randint(0, 12))]
            if rnd.random() < 0.6:
                passage = list(rnd.choice(shared))
                if rnd.random() < 0.4:
                    passage[rnd.randrange(len(passage))] = "Edited"
                ws += passage
        rows.append((i, "  ".join(ws)))
    rows += [(i, t) for i, (_, t) in zip(rnd.sample(range(200, 900), 25), rows)]
    rnd.shuffle(rows)
    check(spark, rows, window)


def test_periodic_texts_and_hot_passage(spark):
    rnd = random.Random(9)
    hot = " ".join(f"h{k}" for k in range(40))
    rows = [(i, f"a{i} " + hot + f" b{i}") for i in range(150)]
    rows += [(1000 + i, "la " * rnd.randint(1, 90)) for i in range(30)] + [(2000, "la li " * 60), (2001, "li la " * 50)]
    check(spark, rows, 8)


def test_nulls_repeats_empty_and_long(spark):
    a = " ".join(f"w{k % 91}" for k in range(300))
    long = " ".join(f"x{k % 7919}" for k in range(60_000))
    rows = [(None, a), (None, a), (5, a), (5, a), (5, "w1 " + a), (3, "w0 w1"), (3, None), (4, ""), (7, "  \n\t "), (9, a.upper()), (11, long), (12, "new " + long)]
    check(spark, rows, 20)


def test_empty_table_and_clashing_names(spark):
    assert remove_repeats(docs_of(spark, [])).collect() == []
    a = " ".join(f"w{k}" for k in range(60))
    names = ["id", "tk", "text", "row", "spans"]
    df = spark.createDataFrame([(1, 7, a, "r", "old"), (2, 8, a, "r", "old")], ", ".join(f"{n} {t}" for n, t in zip(names, ["int", "int", "string", "string", "string"])))
    got = sorted(remove_repeats(df, id_col="id").collect())
    assert [(r.id, r.tk, r.row, r.n_removed, r.text) for r in got] == [(1, 7, "r", 0, a), (2, 8, "r", 60, "")]
