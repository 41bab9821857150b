"""The classifiers learn from their full samples, held in a compact form."""

import numpy as np
from pyspark.sql import functions as F

from strata.llm import linear, quality_rules, toxicity, weak_quality


def test_samples_reach_their_full_bounds(spark):
    n = 16_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.range(n).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("toxic"))
    tox = toxicity.DEFAULT
    label = toxicity.training_rows(docs, labels, "toxic", tox.max_positive, tox.max_negative, tox.max_train_bytes)[1]
    assert ((label == 1).sum(), (label == 0).sum()) == (3000, 5000)
    assert quality_rules.DEFAULT.max_rows == weak_quality.DEFAULT.max_rows == 3000


def test_compact_rows_restore_the_plain_ones():
    ids, _ = toxicity.word_pieces([b"one two one two three", b"", b"two x one"], 1 << 18)
    kinds, at = toxicity._distinct_rows(ids.astype(np.int32))
    assert np.array_equal(kinds[at], ids) and len(kinds) == 4


def test_linear_model_learns_from_texts_with_many_repeats():
    # counts above 255 and above 65,535 in one text need wider numbers
    texts = [b"good " * 400 + b"fine", b"bad " * 70_000, b"good fine", b"bad worse"] * 5
    model = linear.fit_linear(texts, np.array([1.0, 0.0, 1.0, 0.0] * 5), np.ones(20))
    p = linear.probabilities(model, texts[:4])
    assert p[0] > 0.9 and p[2] > 0.9 and p[1] < 0.1 and p[3] < 0.1
