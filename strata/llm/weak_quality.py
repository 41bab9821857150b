"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote good (2), bad (1) or abstain (0)
on every document. Some look for one kind of junk, others for evidence of
prose of their own (sentences, pauses, plain words); none is defined by
the others, so good and bad votes meet on many documents. Documents are
counted by their votes over the whole table (a map-side combined count; at
most ``3 ** len(LABELLERS)`` rows), and expectation-maximisation on those
counts estimates the share of good documents and how often each labeller
votes good, votes bad and abstains in either class (votes independent
given the class). From these follows its accuracy, the probability that a
vote it casts is right. The posterior
of a document's votes is its weak label, and the weak labels train a
hashed linear scorer (``linear``) on a bounded sample: ``max_rows`` on each
side of 0.5, the rows of least hash. The scorer, calibrated on a fold it
was not fitted on, decides on all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, release_memory, with_types
from .linear import LinearModel, fit_linear, probabilities, raw_scores
from .quality_rules import text_counts
from .textops import texts_of
from .toxicity import platt

LABELLERS = ("length", "symbols", "letters", "capitals", "marks", "table", "repeats", "lines", "variety", "stops", "forms", "sentences", "pauses", "plain")
_UPPER = bytes(range(65, 91))
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_SPACE = b" \t\n\r\x0b\x0c"
_NOT_WORDS = bytes(b for b in range(33, 128) if not chr(b).isalnum())
# a plain word: at most its first letter upper-case, then perhaps one mark
_SENTENCE = re.compile(rb"[.!?][ \n]+[A-Z\xc3]")
_PLAIN = re.compile(rb"(?<![^\s])[A-Z]?[a-z\x80-\xff]+[.,;:!?]?(?![^\s])")


@dataclass(frozen=True)
class WeakOptions:
    threshold: float = 0.5
    max_rows: int = 3000
    max_train_bytes: int = 200_000
    calibration_share: float = 0.25
    rounds: int = 200


DEFAULT = WeakOptions()


@dataclass
class WeakModel:
    good: float
    rates: np.ndarray  # labellers x (bad class, good class) x (abstain, bad vote, good vote)
    scorer: LinearModel | None = None

    @property
    def accuracy(self) -> np.ndarray:
        """Of each labeller's cast votes, the share that is right."""
        right = self.good * self.rates[:, 1, 2] + (1 - self.good) * self.rates[:, 0, 1]
        cast = self.good * self.rates[:, 1, 1:].sum(axis=1) + (1 - self.good) * self.rates[:, 0, 1:].sum(axis=1)
        return right / np.maximum(cast, 1e-12)


def _vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(bad, 1, np.where(good, 2, 0)).astype(np.int8)


def votes(texts: list[bytes]) -> np.ndarray:
    """Votes of each labeller on some whole texts (texts x labellers)."""
    c = text_counts(texts)
    words = c["n_words"]
    n = np.maximum(words, 1)
    each = lambda f: np.fromiter(map(f, texts), dtype=np.float64, count=len(texts))
    letters = each(lambda t: len(t) - len(t.translate(None, _LETTERS)))
    upper = each(lambda t: len(t) - len(t.translate(None, _UPPER)))
    dense = each(lambda t: len(t.translate(None, _SPACE)))
    other = dense - each(lambda t: len(t.translate(None, _SPACE + _NOT_WORDS)))
    marks = each(lambda t: t.count(b"!") + t.count(b"?"))
    bars = each(lambda t: t.count(b"|") + t.count(b"\t"))
    stops = each(lambda t: t.count(b".") + t.count(b",") + t.count(b";") + t.count(b":"))
    lines = each(lambda t: t.count(b"\n") + 1)
    kinds = each(lambda t: len(set(t.split())))
    plain = each(lambda t: len(_PLAIN.findall(t))) / n
    enough = words >= 20
    room = np.minimum(n, 300)
    no = np.zeros(len(texts), dtype=bool)
    table = {
        "length": _vote(words < 10, no),
        "symbols": _vote(c["n_symbols"] > 0.1 * n, no),
        "letters": _vote((other > 0.15 * dense) & (words > 0), no),
        "capitals": _vote((upper > 0.3 * letters) & enough, no),
        "marks": _vote(marks > 0.2 * n, no),
        "table": _vote(bars > 0.1 * n, no),
        "repeats": _vote(c["n_repeat_words"] > 0.2 * n, no),
        "lines": _vote(c["n_dup_lines"] > 0.3 * lines, no),
        "variety": _vote((kinds < 0.35 * room) & enough, no),
        "stops": _vote((stops < 0.02 * n) & enough, no),
        "forms": _vote((plain < 0.8) & (words > 0), no),
    }
    sentences = each(lambda t: len(_SENTENCE.findall(t)))
    table["sentences"] = _vote(no, (sentences >= 0.02 * n) & (sentences <= 0.25 * n) & enough)
    table["pauses"] = _vote(no, (stops >= 0.05 * n) & (stops <= 0.35 * n) & (words > 0))
    table["plain"] = _vote(no, (plain >= 0.9) & (words > 0))
    return np.stack([table[name] for name in LABELLERS], axis=1)


def pattern_codes(v: np.ndarray) -> np.ndarray:
    """One number for the votes of a text (base 3)."""
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1], dtype=np.int64))


def _patterns(code: np.ndarray) -> np.ndarray:
    return (code[:, None] // 3 ** np.arange(len(LABELLERS), dtype=np.int64)) % 3


def posterior(m: WeakModel, v: np.ndarray) -> np.ndarray:
    """Probability of good quality given the votes, abstentions included."""
    ratio = np.log(m.rates[:, 1] / m.rates[:, 0])
    z = np.log(m.good / (1 - m.good)) + ratio[np.arange(v.shape[1]), v].sum(axis=1)
    return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def estimate(code: np.ndarray, count: np.ndarray, opt: WeakOptions = DEFAULT) -> WeakModel:
    """EM over vote patterns and how many documents have them.

    Starts from the balance of the votes, a bad one weighing as two good
    ones, which fixes what class is the good one. Rates are smoothed by one
    document of each vote."""
    k = len(LABELLERS)
    m = WeakModel(0.8, np.full((k, 2, 3), 1 / 3))
    v = _patterns(code).astype(np.int64)
    n = count.astype(float)
    q = 1.0 / (1.0 + np.exp(2.0 * (v == 1).sum(axis=1) - (v == 2).sum(axis=1)))
    for _ in range(opt.rounds if len(v) else 0):
        good = float(np.clip((n * q).sum() / n.sum(), 0.01, 0.99))
        rates = np.ones((k, 2, 3))
        for vote in range(3):
            rates[:, 0, vote] += (n * (1 - q)) @ (v == vote)
            rates[:, 1, vote] += (n * q) @ (v == vote)
        m = WeakModel(good, rates / rates.sum(axis=2, keepdims=True))
        new = posterior(m, v)
        moved = np.abs(new - q).max()
        q = new
        if moved < 1e-9:
            break
    return m


def _with_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, code, n_bytes) of every row; a null text counts as empty."""
    src = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text"))
            size = pa.array([len(t) for t in texts], type=pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(pattern_codes(votes(texts))), size], names=["doc_id", "code", "n_bytes"]
            )
        release_memory()

    return src.mapInArrow(run, f"doc_id {kind}, code bigint, n_bytes bigint")


def train(docs: DataFrame, opt: WeakOptions = DEFAULT) -> WeakModel:
    """Estimate the labellers over all of ``docs``, then fit the scorer."""
    coded = _with_codes(docs).checkpoint()
    counts = coded.groupBy("code").agg(F.count(F.lit(1)).alias("n")).toArrow()
    model = estimate(counts.column("code").to_numpy(), counts.column("n").to_numpy(), opt)
    code = counts.column("code").to_numpy().astype(np.int64)
    label = posterior(model, _patterns(code).astype(np.int64)) if len(code) else np.zeros(0)
    bad = [int(c) for c, p in zip(code, label, strict=True) if p < 0.5]
    rows = coded.where(F.col("doc_id").isNotNull() & (F.col("n_bytes").between(1, opt.max_train_bytes)))
    rows = rows.withColumn("bad", F.col("code").isin(bad)).withColumn("r", F.xxhash64("doc_id"))
    pick = lambda side: rows.where(F.col("bad") == side).orderBy("r", "doc_id", "code").limit(opt.max_rows)
    some = pick(True).unionByName(pick(False)).select(F.col("doc_id").alias("s_id")).distinct()
    got = (
        docs.select("doc_id", F.col("text").cast("binary").alias("text"))
        .join(F.broadcast(some), F.col("doc_id") == F.col("s_id"))
        .where(F.length("text").between(1, opt.max_train_bytes))
        .groupBy("doc_id")
        .agg(F.min("text").alias("text"))
        .toArrow()
        .sort_by("doc_id")
    )
    texts = texts_of(got.column("text"))
    del got
    model.scorer = fit_scorer(model, texts, opt)
    release_memory()
    return model


def fit_scorer(model: WeakModel, texts: list[bytes], opt: WeakOptions = DEFAULT) -> LinearModel:
    """The hashed linear scorer of the weak labels of some texts."""
    if not texts:
        empty = fit_linear([], np.zeros(0), np.zeros(0))
        empty.shift = float(np.log(model.good / (1 - model.good)))
        return empty
    soft = posterior(model, votes(texts).astype(np.int64))
    hard = (soft >= 0.5).astype(np.int64)
    # the sample is balanced; weights restore the shares that EM found
    seen = max(1e-6, hard.mean())
    true = np.where(hard == 1, model.good / seen, (1 - model.good) / max(1e-6, 1 - seen))
    fold = np.array([zlib.crc32(t) % 1000 < 1000 * opt.calibration_share for t in texts], dtype=bool)
    at, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    scorer = fit_linear([texts[i] for i in at], soft[at], np.ones(len(at)))
    if len(set(hard[held])) < 2:
        held = np.arange(len(texts))
    if len(set(hard[held])) == 2:
        scorer.scale = platt(raw_scores(scorer, [texts[i] for i in held]), hard[held], true[held])
    return scorer


def classify(docs: DataFrame, model: WeakModel, opt: WeakOptions = DEFAULT) -> DataFrame:
    """``docs`` with weak_label (posterior of the votes), quality (the
    scorer's probability) and good (quality at or above the threshold).

    A null text counts as the empty one; a text without words has nothing
    that the scorer could read, so its weak label decides. All input
    columns stay; columns of the added names are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ("weak_label", "quality", "good")
    keep = kept_columns(docs, added)
    src = only(docs, keep)
    threshold = opt.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            texts = texts_of(batch.column("__text"))
            weak = posterior(m, votes(texts).astype(np.int64))
            p = np.where([not t.strip() for t in texts], weak, probabilities(m.scorer, texts)) if texts else weak
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(weak, type=pa.float64()), pa.array(p, type=pa.float64()), pa.array(p >= threshold)],
                names=[*keep, *added],
            )
        release_memory()

    return src.withColumn("__text", docs["text"].cast("binary")).mapInArrow(
        run, with_types(src.schema, "weak_label double, quality double, good boolean")
    )
