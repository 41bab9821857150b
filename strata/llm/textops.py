"""Vectorised byte-level text helpers used inside Arrow tasks.

Texts travel as binary columns (``cast('binary')``), so no task decodes
UTF-8 that it does not need, and invalid sequences cannot fail a job. A
task works through its Arrow batches in slices of about ``SLICE_BYTES``
of text (working arrays then fit the caches), so its memory does not depend on the batch size; a single text
longer than that is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

SLICE_BYTES = 1 << 17

# Words of the n-gram operators: runs of ASCII letters and digits and of all
# code points from U+0080 on, with A-Z lower-cased.
_low = np.arange(256, dtype=np.uint8)
_low[65:91] += 32
LOWER = _low
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = True
IS_WORD[128:] = True
# Words of the quality operators: runs of anything but ASCII white space.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
# ``bytes.translate`` table for the n-gram words: other bytes become a space.
TO_WORDS = bytes(int(LOWER[b]) if IS_WORD[LOWER[b]] else 32 for b in range(256))

_rng = np.random.default_rng(0x5EED)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash multiplier and of its inverse, up to ``n`` at least."""
    have = _powers.get("mul")
    if have is None or len(have) <= n:
        size = max(n + 1, SLICE_BYTES + 4096)
        for name, base in (("mul", _MUL), ("inv", _INV)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["mul"], _powers["inv"]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64-bit result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def texts_of(column) -> list[bytes]:  # noqa: ANN001 - a pyarrow binary array
    """The column's values as bytes; null is the empty text."""
    return [b"" if v is None else v for v in column.to_pylist()]


def row_slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes of text each, or of one row."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass
class Words:
    """Words of several texts, in order: ``buf`` holds the texts, one line
    feed after each; word ``i`` is ``buf[start[i]:end[i]]`` and belongs to
    text ``doc[i]``; text ``d`` owns the words ``first[d]:first[d + 1]``."""

    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    offsets: np.ndarray

    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words_of(texts: list[bytes], is_word: np.ndarray = IS_WORD, lower: bool = True) -> Words:
    """Find the words of every text; a text's end always ends its word."""
    joined = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(joined, dtype=np.uint8)
    if lower:
        buf = LOWER[buf]
    flag = is_word[buf]
    edge = np.flatnonzero(flag[1:] != flag[:-1]) + 1
    if flag[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(first))
    return Words(buf, start, end, doc, first, offsets)


def prefix_codes(buf: np.ndarray) -> np.ndarray:
    """Running polynomial codes, from which any span's hash follows."""
    mul, _ = power_tables(len(buf))
    out = np.empty(len(buf) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(_BYTE_CODE[buf] * mul[: len(buf)], out=out[1:])
    return out


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes ``start:end``; equal bytes, equal hash anywhere."""
    _, inv = power_tables(len(codes))
    return mix64((codes[end] - codes[start]) * inv[start])


def word_hash(w: Words) -> np.ndarray:
    return span_hash(prefix_codes(w.buf), w.start, w.end)


def gram_hash(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and where each
    text's runs begin. A text with fewer words, but not none, is one run."""
    n = len(word)
    count = np.diff(first)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        m = mix64(np.array([2 * k + 1], dtype=np.uint64))[0] | np.uint64(1)
        if k < n:
            code[: n - k] += word[k:] * m
    runs = np.where(count >= size, count - size + 1, (count > 0).astype(count.dtype))
    starts = np.concatenate(([0], np.cumsum(runs)))
    at = np.arange(starts[-1]) + np.repeat(first[:-1] - starts[:-1], runs)
    out = mix64(code[at])
    for d in np.flatnonzero((count > 0) & (count < size)):
        own = word[first[d] : first[d + 1]]
        short = np.uint64(0)
        for k, x in enumerate(own):
            short = mix64(np.array([short ^ x], dtype=np.uint64) + np.uint64(k + 77))[0]
        out[starts[d]] = short
    return out, starts


def normalised(text: bytes) -> bytes:
    """The text as its words joined by one space."""
    return b" ".join(text.translate(TO_WORDS).split())
