"""Corpus pipeline: five stages over ``documents``.

Each stage is ``(name, function)``; a function takes (spark, docs, sf_dir)
and returns a DataFrame, which ``run`` writes as Parquet in the shared
checkpoint folder and reads back as the next stage's ``docs``. All but the
last return the columns of ``documents``.

1. quality classifier: documents whose weakly trained score calls them bad go;
2. toxicity: documents at or above their language's threshold go;
3. n-gram Jaccard join: of each group of copies and near copies the
   document with the least doc_id stays;
4. benchmark decontamination: contaminated spans are cut out, documents
   that consist of them by more than half go;
5. BPE: token ids of the remaining texts, with digests of ids and decoding.

Null and empty texts are judged like any other text (a text without words
fails quality), a table without rows gives one without rows, repeated rows
are copies, and further columns of the input are carried along by stages
1 to 4.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import toxicity, weak_quality
from strata.llm.bpe import encode_documents
from strata.llm.decontaminate import decontaminate
from strata.llm.frames import only, text_batches
from strata.llm.ngram_join import grouped_rows, text_key
from strata.llm.queries import tokenizer_path
from strata.session import scratch_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the weak-label quality classifier calls good."""
    text_batches(spark)
    judged = weak_quality.classify(docs, weak_quality.train(docs))
    return only(judged.where("good"), docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the toxicity classifier rejects.

    The classifier learns from labelled rows of ``documents`` itself, so
    that earlier stages do not thin out what it learns from."""
    text_batches(spark)
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return only(toxicity.score(docs, model).where(~F.col("toxic")), docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of copies and near copies.

    It is the group's row with the least doc_id, rows without an id last;
    of several such rows with the same text one stays. Documents without
    words are in no group and all stay."""
    text_batches(spark)
    rows, classes = grouped_rows(docs.select("doc_id", "text"))
    # rows of one id and text, counted: a third of all rows may be the same
    same = rows.groupBy("id", "tk", "key").agg(F.count(F.lit(1)).alias("n_same"))
    judged = same.join(classes.select("c_key", "first"), F.col("key").eqNullSafe(F.col("c_key")), "left")
    alone = F.col("key").isNull()
    least = F.col("id").eqNullSafe(F.col("first.id")) & F.col("tk").eqNullSafe(F.col("first.tk"))
    stay = judged.where(alone | least).select(
        F.col("id").alias("stay_id"), F.col("tk").alias("stay_tk"), (~alone & (F.col("n_same") > 1)).alias("stay_one")
    )
    own = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row"), F.col("doc_id").alias("id"), text_key("text").alias("tk"))
    kept = own.join(stay, F.col("id").eqNullSafe(F.col("stay_id")) & F.col("tk").eqNullSafe(F.col("stay_tk")))
    once = kept.where("stay_one").dropDuplicates(["id", "tk"])
    out = kept.where("not stay_one").unionByName(once)
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(docs.columns)])


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that mostly are one."""
    text_batches(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text: n_tokens, token_ids and the two digests."""
    text_batches(spark)
    out = encode_documents(docs.select("doc_id", "text"), tokenizer_path(), ids=True, digests=True)
    return out.select("doc_id", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("toxicity", toxicity_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE encoding and decoding", bpe_stage),
]

# SQL expresses neither the classifiers nor BPE; tests/llm compares the
# stages with brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
