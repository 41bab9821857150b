"""Quality rules and a calibrated n-gram classifier.

Fixed rules look at counts of each whole text; texts that pass are kept
when a hashed n-gram logistic regression (``linear``), trained on labelled
rows, gives them a probability of good quality of at least ``threshold``.
The classifier is fitted on a bounded sample of labelled rows
(``max_rows`` of each class, those with the least hashes) and calibrated
by Platt scaling on a fold that the fit does not see, with the classes
weighted to their true shares. Everything is scored in Arrow batches; the
model (1 MB) is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, release_memory, with_types
from .linear import LinearModel, fit_linear, probabilities, raw_scores
from .textops import NOT_SPACE, gram_hash, mix64, row_slices, texts_of, word_hash, words_of
from .toxicity import platt, training_rows

# Fixed values
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"


@dataclass(frozen=True)
class QualityOptions:
    threshold: float = 0.5
    max_rows: int = 3000
    max_train_bytes: int = 200_000
    calibration_share: float = 0.25


DEFAULT = QualityOptions()
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: its words, and those inside a window that occurs again."""
    n_words, repeated = [], []
    for a, b in row_slices(texts):
        w = words_of(texts[a:b], NOT_SPACE, lower=False)
        grams, at = gram_hash(word_hash(w), w.first, WINDOW)
        doc = np.repeat(np.arange(b - a), np.diff(at))
        code = grams ^ mix64(doc.astype(np.uint64))
        order = np.argsort(code)
        same = code[order][1:] == code[order][:-1]
        twice = np.zeros(len(code), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.flatnonzero(twice)
        begin = hit - at[:-1][doc[hit]] + w.first[:-1][doc[hit]]
        cover = np.zeros(len(w.start) + 1, dtype=np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + WINDOW, -1)
        inside = np.concatenate(([0], np.cumsum(np.cumsum(cover[:-1]) > 0)))
        n_words.append(w.count())
        repeated.append(np.diff(inside[w.first]))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(n_words), np.concatenate(repeated)) if n_words else (none, none)


def _dup_lines(text: bytes) -> int:
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line.strip(_SPACE):
            if line in seen:
                found += 1
            else:
                seen.add(line)
    return found


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The rule counts (``COUNTS``) of some whole texts."""
    n_words, repeated = _repeat_words(texts)
    each = lambda f: np.fromiter(map(f, texts), dtype=np.int64, count=len(texts))
    return {
        "n_words": n_words.astype(np.int64),
        "word_chars": each(lambda t: len(t.translate(None, _CONTINUATION + _SPACE))),
        "n_symbols": each(lambda t: len(t) - len(t.translate(None, SYMBOLS))),
        "n_dup_lines": each(_dup_lines),
        "n_repeat_words": repeated.astype(np.int64),
    }


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEAT_PERCENT * counts["n_words"])


def fit(texts: list[bytes], label: np.ndarray, share: dict[int, float], opt: QualityOptions = DEFAULT) -> LinearModel:
    """Fit and calibrate; with one class or none every text gets its share."""
    label = np.asarray(label, dtype=np.int64)
    true = np.array([share.get(int(y), 1.0) for y in label])
    fold = np.array([zlib.crc32(t) % 1000 < 1000 * opt.calibration_share for t in texts], dtype=bool)
    if len(set(label[~fold])) < 2:
        rate = float((true * label).sum() / true.sum()) if len(label) else 1.0
        empty = fit_linear([], np.zeros(0), np.zeros(0))
        empty.shift = float(np.log((rate + 1e-3) / (1 - rate + 1e-3)))
        return empty
    low = max(1, min((label == 0).sum(), (label == 1).sum()))
    balance = np.where(label == 1, low / max(1, (label == 1).sum()), low / max(1, (label == 0).sum()))
    at, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    model = fit_linear([texts[i] for i in at], label[at].astype(float), balance[at] / balance.mean())
    if len(set(label[held])) < 2:
        held = np.arange(len(texts))
    model.scale = platt(raw_scores(model, [texts[i] for i in held]), label[held], true[held])
    return model


def train(docs: DataFrame, labels: DataFrame, opt: QualityOptions = DEFAULT) -> LinearModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod 4 is not 2; the
    others stay unseen, for held-out checks."""
    texts, label, _, share = training_rows(docs, labels, "quality", opt.max_rows, opt.max_rows, opt.max_train_bytes)
    model = fit(texts, label, share, opt)
    release_memory()
    return model


def apply_rules(docs: DataFrame, model: LinearModel, opt: QualityOptions = DEFAULT) -> DataFrame:
    """``docs`` with the five counts, base_failed, quality (probability of
    good quality) and kept.

    A null text counts as the empty one, which fails the rules. All input
    columns stay; columns of the added names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = (*COUNTS, "base_failed", "quality", "kept")
    keep = kept_columns(docs, added)
    src = only(docs, keep)
    threshold = opt.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = texts_of(batch.column("__text"))
            counts = text_counts(texts)
            failed = base_failed(counts)
            p = probabilities(m, texts)
            cols = [batch.column(c) for c in keep]
            more = [pa.array(counts[c], type=pa.int64()) for c in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [*cols, *more, pa.array(failed), pa.array(p, type=pa.float64()), pa.array(~failed & (p >= threshold))],
                names=[*keep, *added],
            )
        release_memory()

    types = ", ".join(f"{c} bigint" for c in COUNTS) + ", base_failed boolean, quality double, kept boolean"
    return src.withColumn("__text", docs["text"].cast("binary")).mapInArrow(run, with_types(src.schema, types))
