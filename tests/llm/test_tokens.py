"""Token counts and BPE against the library."""

import hashlib
import random

import pytest

from strata.llm import pretokens as P
from strata.llm.bpe import Bpe, BpeOptions, decode_documents, encode_documents
from strata.llm.queries import QUERIES, tokenizer_path
from strata.llm.token_counts import CountOptions, Lengths, count_tokens, load_tokenizer, token_counts
from tests.conftest import SF0001

ODD = ["", None, " ", "don't I'll WE'VE x'll", "<|endoftext|>", "a<|startoftext|>b<|endoftext|><|endoftext|>", "ΑΣ ς İstanbul ﬁ Å é", "한국어 日本 🙂🙂", "a" * 5000, "!?" * 3000, "\x1c\x85 x", "1234567", "x" * 40 + "é" * 40]


@pytest.fixture(scope="module")
def library():
    return load_tokenizer(tokenizer_path())


@pytest.fixture(scope="module")
def bpe():
    return Bpe(tokenizer_path())


def test_every_safe_character_splits_as_in_the_library(library):
    splitter = P.Splitter(library)
    for c in P.SAFE:
        for around in ("%s", "a%sb", "%s%s", "'%s", "1%s", " %s ", "e%s", "!%s!"):
            text = around.replace("%s", c)
            normal = library.normalizer.normalize_str(text)
            made = [bytes(P._CHAR_TO_BYTE[x] for x in t).decode() for t, _ in library.pre_tokenizer.pre_tokenize_str(normal)]
            assert P._SPLIT.findall(text.lower()) == made == splitter.split(text), (hex(ord(c)), around)


def test_random_texts_encode_and_decode_as_the_library(library, bpe):
    rnd = random.Random(2)
    pools = [P.SAFE, "ab'stre lvmd ", "\n \t", "ñéß€🙂ΑΣς한́", "<|endoftext|>"]
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(pools)) for _ in range(rnd.randint(0, 60)))
        if rnd.random() < 0.2:
            text = text[:5] + "<|endoftext|>" + text[5:]
        ids = library.encode(text, add_special_tokens=False).ids
        assert bpe.encode(text) == ids
        assert bpe.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_are_never_inside_a_token(bpe):
    assert all(len(bpe.fragments(t.removesuffix("</w>"))) == 1 for t in list(bpe.ids)[:5000])
    assert any(len(bpe.fragments(P.to_alphabet(w))) > 1 for w in ("zxqjv", "ähnqx", "öß"))


def test_full_caches_change_nothing(library):
    small = Bpe(tokenizer_path(), room=3)
    lengths = Lengths({"the": 1}, library, 2)
    splitter = P.Splitter(library)
    for text in [*filter(None, ODD), "the quick brown fox jumps over lazy dogs again and again"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert small.encode(text) == ids
        assert count_tokens(text, splitter, lengths) == len(ids)


def test_documents_of_all_kinds(spark, library):
    df = spark.createDataFrame([(k, t, "keep") for k, t in enumerate(ODD)] + [(None, "the", "keep"), (0, "", "keep")], "doc_id bigint, text string, N_Tokens string")
    want = sorted(((k, len(library.encode(t or "", add_special_tokens=False).ids)) for k, t in [*enumerate(ODD), (None, "the"), (0, "")]), key=repr)
    counted = token_counts(df, tokenizer_path(), CountOptions(sample_rows=2))
    assert counted.columns == ["doc_id", "text", "n_tokens"]  # a clashing column is replaced
    assert sorted(((r.doc_id, r.n_tokens) for r in counted.collect()), key=repr) == want
    coded = encode_documents(df, tokenizer_path(), BpeOptions(cache_entries=5), ids=True, digests=True)
    for r in decode_documents(coded, tokenizer_path()).collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert r.token_ids == ids and r.n_tokens == len(ids)
        text = library.decode(ids, skip_special_tokens=False)
        assert r.decoded == text and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    empty = df.where("doc_id < 0")
    assert token_counts(empty, tokenizer_path()).count() == 0 and encode_documents(empty, tokenizer_path()).count() == 0


def test_queries_match_the_library(spark, library):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF0001}/documents.parquet").collect()}
    ids = dict(zip(docs, (e.ids for e in library.encode_batch(list(docs.values()), add_special_tokens=False)), strict=True))
    counts = QUERIES["op6_token_counts"](spark, SF0001).collect()
    assert len(counts) == len(docs)
    for r in counts:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), len(ids[r.doc_id]), len(ids[r.doc_id]) > 2048)
    coded = QUERIES["op10_bpe"](spark, SF0001).collect()
    assert len(coded) == len(docs)
    for r in coded:
        own = ids[r.doc_id]
        assert r.n_tokens == len(own) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(own, skip_special_tokens=False).encode()).hexdigest()
