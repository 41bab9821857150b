"""Hashed word and character n-gram logistic regression in numpy.

A text's features are its words, its word pairs (a word followed by itself
is one feature, whatever the word) and its character 3- and 5-grams (code points of the unchanged text, white space included), each
hashed into its own part of one weight table. Within a part a feature's
value is its share of the part's n-grams times ``SCALE``, so the length of
a text does not matter. Scoring is one look-up per n-gram.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .textops import NOT_SPACE, mix64, prefix_codes, row_slices, span_hash, words_of

PARTS = 4
SCALE = 30.0


@dataclass
class LinearModel:
    bits: int
    weight: np.ndarray  # PARTS * 2**bits
    shift: float
    scale: tuple[float, float] = (1.0, 0.0)


def _ngrams(texts: list[bytes], bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each part: the table index of every n-gram, and where texts begin."""
    w = words_of(texts, NOT_SPACE, lower=False)
    codes = prefix_codes(w.buf)
    cut = np.uint64(64 - bits)
    out = []

    def add(part: int, code: np.ndarray, first: np.ndarray) -> None:
        out.append(((code >> cut).astype(np.int64) + (part << bits), first))

    word = span_hash(codes, w.start, w.end)
    add(0, word, w.first)
    n = len(word)
    count = np.diff(w.first)
    pair = np.ones(n, dtype=bool)
    pair[w.first[1:][count > 0] - 1] = False
    at = np.flatnonzero(pair)
    left, right = word[at], word[at + 1 if len(at) else at]
    both = mix64(left * np.uint64(0x9E3779B97F4A7C15) + right)
    both[left == right] = np.uint64(0x1F2E3D4C5B6A7988)
    add(1, both, np.searchsorted(at, w.first))
    lead = np.flatnonzero((w.buf & 0xC0) != 0x80)  # first bytes of code points
    chars = np.searchsorted(lead, w.offsets)
    for part, size in ((2, 3), (3, 5)):
        end = np.full(len(lead), len(w.buf), dtype=np.int64)
        if len(lead) > size:
            end[: len(lead) - size] = lead[size:]
        # a gram may use the line feed after its text, but nothing beyond it
        inside = end <= np.repeat(w.offsets[1:], np.diff(chars))
        at = np.flatnonzero(inside)
        add(part, span_hash(codes, lead[at], end[at]), np.searchsorted(at, chars))
    return out


def raw_scores(model: LinearModel, texts: list[bytes]) -> np.ndarray:
    done = []
    for a, b in row_slices(texts):
        total = np.full(b - a, model.shift)
        for index, first in _ngrams(texts[a:b], model.bits):
            sums = np.concatenate(([0.0], np.cumsum(model.weight[index], dtype=np.float64)))
            total += SCALE * np.diff(sums[first]) / np.maximum(np.diff(first), 1)
        done.append(total)
    return np.concatenate(done) if done else np.zeros(0)


def probabilities(model: LinearModel, texts: list[bytes]) -> np.ndarray:
    a, b = model.scale
    return 1.0 / (1.0 + np.exp(-np.clip(a * raw_scores(model, texts) + b, -30, 30)))


def fit_linear(texts: list[bytes], target: np.ndarray, weight: np.ndarray, bits: int = 16, epochs: int = 8, rate: float = 0.05, l2: float = 1e-6) -> LinearModel:
    """Adagrad on the weighted log loss; ``target`` may be soft (0 to 1)."""
    rng = np.random.default_rng(5)
    # of each text: its table indices within their parts, how often each occurs,
    # and by part how many there are; small numbers, as all texts stay in memory
    rows: list[tuple[np.ndarray, np.ndarray, list[int]]] = []
    small = np.min_scalar_type((1 << bits) - 1)
    begin = np.arange(PARTS, dtype=np.int32) << bits
    for a, b in row_slices(texts):
        parts = _ngrams(texts[a:b], bits)
        for i in range(b - a):
            own, often = [], []
            for part, (index, first) in enumerate(parts):
                ids, n = np.unique(index[first[i] : first[i + 1]], return_counts=True)
                own.append((ids - begin[part]).astype(small))
                often.append(n)
            count = np.concatenate(often)
            rows.append((np.concatenate(own), count.astype(np.min_scalar_type(count.max(initial=0))), [len(x) for x in own]))

    def features(i: int) -> tuple[np.ndarray, np.ndarray]:
        own, count, sizes = rows[i]
        count = count.astype(np.int64)
        sums = [max(1, int(c.sum())) for c in np.split(count, np.cumsum(sizes)[:-1])]
        return own + np.repeat(begin, sizes), (SCALE * count / np.repeat(sums, sizes)).astype(np.float32)

    model = LinearModel(bits, np.zeros(PARTS << bits, dtype=np.float32), 0.0)
    seen = np.full(PARTS << bits, 1e-4, dtype=np.float32)
    shift_seen = 1e-4
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, value = features(i)
            z = float(model.weight[ids] @ value) + model.shift
            err = (1.0 / (1.0 + np.exp(-min(max(z, -30.0), 30.0))) - target[i]) * weight[i]
            if abs(err) < 1e-4:
                continue
            g = err * value + l2 * model.weight[ids]
            seen[ids] += g * g
            model.weight[ids] -= rate * g / np.sqrt(seen[ids])
            shift_seen += err * err
            model.shift -= rate * err / shift_seen**0.5
    return model
