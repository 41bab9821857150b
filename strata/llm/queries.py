"""Registered queries of the training-data operators, and their SQL.

Each query applies one operator, with its production parameters, to its
whole intended table and returns the full result. Keys without an entry
in ``ORACLE`` are tested against a brute-force version in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir
from . import quality_rules, queries_sql, toxicity, weak_quality
from .bpe import encode_documents
from .chat import render_perspectives
from .decontaminate import find_contamination
from .frames import text_batches
from .lexical_search import search
from .ngram_join import near_duplicates
from .prefix_trie import encoded, rebuilt, trie_nodes
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .url_filter import judge_urls
from .warc import archive_pages, read_records

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files' package keeps one (on every node)."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC, normalised, and read back through the index."""
    index = archive_pages(_table(spark, sf_dir, "pages"), scratch_dir(spark, "warc"))
    out = read_records(index, payloads=False)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from each participant's side, with learning masks."""
    return render_perspectives(_table(spark, sf_dir, "conversations"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at Jaccard 0.8 or more over word 5-grams, one row per document."""
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item."""
    found = find_contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts and the verdict of the calibrated n-gram classifier."""
    docs = _table(spark, sf_dir, "documents")
    model = quality_rules.train(docs, _table(spark, sf_dir, "labels"))
    out = quality_rules.apply_rules(docs.select("doc_id", "text"), model)
    return out.select("doc_id", *quality_rules.COUNTS, "base_failed", "quality", "kept")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text under the word-end BPE vocabulary."""
    out = token_counts(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return out.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > 2048).alias("over_limit"),
    )


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak label and verdict of the scorer it trains, for every document."""
    docs = _table(spark, sf_dir, "documents")
    out = weak_quality.classify(docs.select("doc_id", "text"), weak_quality.train(docs))
    return out.select("doc_id", "weak_label", "quality", F.col("good").alias("kept"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allow or block verdict of every page's url."""
    out = judge_urls(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, at the fixed cut and by language."""
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs.select("doc_id", "text", "lang"), model)
    return out.select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.3).cast("int").alias("predicted"),
        "toxicity_threshold",
        "toxic",
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole text and of what they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode_documents(docs, tokenizer_path(), ids=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of all conversations, their first turns taken from
    the conversation at the last multiple of 100."""
    own = encoded(_table(spark, sf_dir, "conversations"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    return trie_nodes(rebuilt(own, heads, F.col("conv_id") - F.col("conv_id") % 100))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the 50-word windows that a smaller doc_id holds."""
    out = remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    out = search(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_chat_rotation": op2_chat_rotation,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_decontamination": op4_decontamination,
    "op5_quality_rules": op5_quality_rules,
    "op6_token_counts": op6_token_counts,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_url_filter": op8_url_filter,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_lexical_search": op13_lexical_search,
}

ORACLE: dict[str, str] = {
    "op1_warc": queries_sql.OP1,
    "op2_chat_rotation": queries_sql.OP2,
    "op4_decontamination": queries_sql.OP4,
    "op8_url_filter": queries_sql.OP8,
    "op11_prefix_trie": queries_sql.OP11,
    "op12_substring_dedup": queries_sql.OP12,
    "op13_lexical_search": queries_sql.OP13,
}
