"""Toxicity: a convolutional text classifier trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its
first 3 to 8 bytes (so inflected forms of a stem share most of it). Filters
of widths 1, 2 and 3 slide over the word vectors, each filter keeps its
maximum over the text, and a logistic layer turns the maxima into a
probability. Only the text is an input.

The model is fitted on the driver, on a bounded sample of labelled rows
(``ToxicityOptions.max_positive`` and ``max_negative``, the rows with the
least hashes; both classes' true sizes are counted over all labelled rows
and enter as weights). Backpropagation is exact and cheap, because only a
filter's winning window receives a gradient. A fold that the weights never
see gives the Platt scaling that makes the score a probability under the
true class shares, and a threshold per language: the one of best F1 on
that language's rows, drawn towards the global one where there are few.

Scoring streams over all rows in Arrow batches; the model (about 8 MB,
whatever the corpus) is broadcast.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, release_memory, with_types
from .textops import mix64, prefix_codes, row_slices, span_hash, texts_of, words_of

_PREFIXES = (3, 4, 5, 6, 7, 8)
_PIECES = 1 + len(_PREFIXES)


@dataclass(frozen=True)
class ToxicityOptions:
    buckets: int = 1 << 18
    dim: int = 8
    filters: int = 8
    widths: tuple[int, ...] = (1, 2, 3)
    max_positive: int = 3000
    max_negative: int = 5000
    # Longer texts are scored like any other, but not learned from.
    max_train_bytes: int = 200_000
    calibration_share: float = 0.25
    epochs: int = 10
    batch: int = 32
    rate: float = 0.08
    threshold: float = 0.3


DEFAULT = ToxicityOptions()


@dataclass
class ToxicityModel:
    opt: ToxicityOptions
    embed: np.ndarray
    conv: np.ndarray  # dim x (sum of widths * filters)
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3


def word_pieces(texts: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids (words x pieces) of all texts and each text's first row.

    Every text gets as many padding rows (bucket 0) at its end as the
    widest filter needs, and an empty one at least one row."""
    w = words_of(texts)
    codes = prefix_codes(w.buf)
    size = w.end - w.start
    ids = np.zeros((len(size), _PIECES), dtype=np.int64)
    mask = np.uint64(buckets - 1)
    ids[:, 0] = (mix64(span_hash(codes, w.start, w.end)) & mask).astype(np.int64)
    for k, n in enumerate(_PREFIXES, 1):
        has = size >= n
        code = span_hash(codes, w.start[has], w.start[has] + n)
        ids[has, k] = (mix64(code + np.uint64(k)) & mask).astype(np.int64)
    return ids, w.first


def _padded(ids: np.ndarray, first: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    starts = np.concatenate(([0], np.cumsum(np.maximum(count, 1) + pad)))
    out = np.zeros((starts[-1], ids.shape[1]), dtype=ids.dtype)
    at = np.arange(len(ids)) + np.repeat(starts[:-1] - first[:-1], count)
    out[at] = ids
    return out, starts


def _convolve(m: ToxicityModel, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """Word vectors, one response array per width, text starts, padded ids."""
    widths, f = m.opt.widths, m.opt.filters
    ids, starts = _padded(ids, first, max(widths) - 1)
    x = m.embed[ids[:, 0]]
    for k in range(1, ids.shape[1]):
        x = x + m.embed[ids[:, k]]
    y = x @ m.conv
    out, col = [], 0
    for w in widths:
        z = y[:, col : col + f].copy()
        col += f
        for j in range(1, w):
            z[:-j] += y[j:, col : col + f]
            col += f
        out.append(z)
    return x, out, starts, ids


def _real(starts: np.ndarray, pad: int) -> np.ndarray:
    """Rows of ``_padded`` at which a window may begin."""
    ok = np.ones(starts[-1], dtype=bool)
    for k in range(1, pad + 1):
        ok[starts[1:] - k] = False
    return ok


def logits(m: ToxicityModel, texts: list[bytes]) -> np.ndarray:
    """Uncalibrated scores of some texts."""
    done = []
    for a, b in row_slices(texts):
        ids, first = word_pieces(texts[a:b], m.opt.buckets)
        _, conv, starts, _ = _convolve(m, ids, first)
        ok = _real(starts, max(m.opt.widths) - 1)
        begin = (np.cumsum(ok) - 1)[starts[:-1]]
        top = np.concatenate([np.maximum.reduceat(z[ok], begin, axis=0) for z in conv], axis=1)
        done.append(np.maximum(top + m.bias, 0) @ m.out + m.shift)
    return np.concatenate(done) if done else np.zeros(0)


def scores(m: ToxicityModel, texts: list[bytes]) -> np.ndarray:
    a, b = m.scale
    return 1.0 / (1.0 + np.exp(-np.clip(a * logits(m, texts) + b, -30, 30)))


class _Adagrad:
    def __init__(self, value: np.ndarray, rate: float) -> None:
        self.value, self.rate, self.sum = value, rate, np.full_like(value, 1e-6)

    def step(self, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        if rows is None:
            self.sum += grad * grad
            self.value -= self.rate * grad / np.sqrt(self.sum)
        else:
            self.sum[rows] += grad * grad
            self.value[rows] -= self.rate * grad / np.sqrt(self.sum[rows])


def _distinct_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows of ``ids`` and where each row is among them: words
    recur, so this holds a text in a seventh of the memory."""
    code = np.zeros(len(ids), dtype=np.uint64)
    for k in range(ids.shape[1]):
        code = mix64(code + ids[:, k].astype(np.uint64) + np.uint64(k + 1))
    _, some, at = np.unique(code, return_index=True, return_inverse=True)
    if not np.array_equal(ids[some][at], ids):  # two rows with one code
        return ids, np.arange(len(ids), dtype=np.int32)
    return ids[some], at.astype(np.int32)


def _train_weights(opt: ToxicityOptions, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> ToxicityModel:
    rng = np.random.default_rng(9)
    f, widths, d = opt.filters, opt.widths, opt.dim
    m = ToxicityModel(
        opt,
        rng.normal(0, 0.1, (opt.buckets, d)).astype(np.float32),
        rng.normal(0, 0.3, (d, f * sum(widths))).astype(np.float32),
        np.zeros(f * len(widths), dtype=np.float32),
        rng.normal(0, 0.2, f * len(widths)).astype(np.float32),
        threshold=opt.threshold,
    )
    m.embed[0] = 0
    pieces = []
    for a, b in row_slices(texts):
        ids, first = word_pieces(texts[a:b], opt.buckets)
        kinds, at = _distinct_rows(ids.astype(np.int32))
        pieces += [(kinds, at[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)]
    embed, conv, bias, out = (_Adagrad(v, opt.rate) for v in (m.embed, m.conv, m.bias, m.out))
    shift = _Adagrad(np.zeros(1, dtype=np.float32), opt.rate)
    pad = max(widths) - 1
    for _ in range(opt.epochs):
        order = rng.permutation(len(pieces))
        for begin in range(0, len(order), opt.batch):
            own = order[begin : begin + opt.batch]
            first = np.concatenate(([0], np.cumsum([len(pieces[i][1]) for i in own])))
            ids = np.concatenate([kinds[at] for kinds, at in (pieces[i] for i in own)])
            x, zs, starts, ids = _convolve(m, ids, first)
            win = np.zeros((len(own), f * len(widths)), dtype=np.int64)
            top = np.zeros((len(own), f * len(widths)), dtype=np.float32)
            for k in range(len(own)):
                lo, hi = starts[k], starts[k + 1] - pad
                for c, z in enumerate(zs):
                    seen = z[lo:hi]
                    best = seen.argmax(axis=0)
                    win[k, c * f : (c + 1) * f] = best + lo
                    top[k, c * f : (c + 1) * f] = seen[best, np.arange(f)]
            act = np.maximum(top + m.bias, 0)
            p = 1.0 / (1.0 + np.exp(-np.clip(act @ m.out + shift.value[0], -30, 30)))
            err = ((p - label[own]) * weight[own] / len(own)).astype(np.float32)
            back = np.outer(err, m.out) * (act > 0)
            g_conv = np.zeros_like(m.conv)
            rows, grads = [], []
            col = 0
            for c, w in enumerate(widths):
                for j in range(w):
                    at_row = win[:, c * f : (c + 1) * f] + j
                    g = back[:, c * f : (c + 1) * f]
                    g_conv[:, col : col + f] = np.einsum("kf,kfd->df", g, x[at_row])
                    rows.append(at_row.ravel())
                    grads.append((g[:, :, None] * m.conv[:, col : col + f].T[None]).reshape(-1, d))
                    col += f
            row, grad = np.concatenate(rows), np.concatenate(grads)
            live = np.abs(grad).sum(axis=1) > 0
            touched = ids[row[live]]
            flat, where = np.unique(touched.ravel(), return_inverse=True)
            g_embed = np.zeros((len(flat), d), dtype=np.float32)
            np.add.at(g_embed, where.ravel(), np.repeat(grad[live], touched.shape[1], axis=0))
            g_embed[flat == 0] = 0
            out.step(act.T @ err + 1e-5 * m.out)
            bias.step(back.sum(axis=0))
            shift.step(np.array([err.sum()], dtype=np.float32))
            conv.step(g_conv + 1e-5 * m.conv)
            embed.step(g_embed, flat)
    m.shift = float(shift.value[0])
    return m


def platt(raw: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from raw scores to the label.

    Newton steps on the weighted log loss, towards smoothed targets."""
    n1, n0 = max(weight[label == 1].sum(), 1e-9), max(weight[label == 0].sum(), 1e-9)
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, float(np.log(n1 / n0))
    for _ in range(60):
        p = 1.0 / (1.0 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g, h = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        ga, gb = (g * raw).sum() + 1e-3 * (a - 1), g.sum()
        haa, hab, hbb = (h * raw * raw).sum() + 1e-3, (h * raw).sum(), h.sum() + 1e-9
        det = haa * hbb - hab * hab
        if abs(det) < 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / max(abs(da), abs(db), 1e-12))
        a, b = max(a - step * da, 1e-3), b - step * db
        if max(abs(da), abs(db)) < 1e-9:
            break
    return float(a), float(b)


def best_threshold(p: np.ndarray, label: np.ndarray, weight: np.ndarray, start: float) -> float:
    """The cut of best weighted F1, in the middle of the gap it falls in."""
    if not (label == 1).any() or not (label == 0).any():
        return start
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((weight * label)[order]), np.cumsum(weight[order])
    f1 = 2 * hit / (all_ + (weight * label).sum())
    f1[:-1][p[order][1:] == p[order][:-1]] = -1  # a cut can't part equal scores
    k = int(f1.argmax())
    return float((p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0.0)) / 2)


def fit(texts: list[bytes], label: np.ndarray, langs: list[str | None], share: dict[int, float], opt: ToxicityOptions = DEFAULT) -> ToxicityModel:
    """Fit, calibrate and set thresholds. ``share``: true rows per sampled
    row of each class."""
    label = np.asarray(label, dtype=np.int64)
    fold = np.array([zlib.crc32(t) % 1000 < 1000 * opt.calibration_share for t in texts], dtype=bool)
    true = np.array([share.get(int(y), 1.0) for y in label])
    balance = np.where(label == 1, max(1.0, (label == 0).sum() / max(1, (label == 1).sum())) ** 0.5, 1.0)
    if (label == 1).sum() == 0 or (label == 0).sum() == 0 or len(set(label[~fold])) < 2:
        m = _train_weights(ToxicityOptions(**{**opt.__dict__, "epochs": 0}), texts[:1], label[:1], true[:1])
        m.out[:] = 0
        rate = (true * label).sum() / true.sum() if len(label) else 0.0
        m.scale = (1.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
        return m
    train = np.flatnonzero(~fold)
    m = _train_weights(opt, [texts[i] for i in train], label[train], balance[train])
    held = np.flatnonzero(fold)
    if len(set(label[held])) < 2:
        held = np.arange(len(texts))
    raw = logits(m, [texts[i] for i in held])
    m.scale = platt(raw, label[held], true[held])
    a, b = m.scale
    p = 1.0 / (1.0 + np.exp(-np.clip(a * raw + b, -30, 30)))
    near = lambda t: float(np.clip(t, opt.threshold / 2, 0.5))  # noqa: E731 - stay near the fixed cut
    m.threshold = near(best_threshold(p, label[held], true[held], opt.threshold))
    for lang in sorted({langs[i] for i in held if langs[i]}):
        own = np.array([langs[i] == lang for i in held])
        n = int(label[held][own].sum())
        t = best_threshold(p[own], label[held][own], true[held][own], m.threshold)
        m.thresholds[lang] = near((n * t + 20 * m.threshold) / (n + 20))
    return m


def learnable(id_col: str | Column = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id as text, mod 4, is not 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) != 2, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, opt_pos: int, opt_neg: int, max_bytes: int) -> tuple[list[bytes], np.ndarray, list[str | None], dict[int, float]]:
    """A bounded sample of learnable labelled rows: texts, labels, languages
    and, by label, how many labelled rows each sampled one stands for."""
    marks = (
        labels.select(F.col("doc_id").alias("l_id"), F.col(label_col).cast("int").alias("y"))
        .where("l_id is not null and y in (0, 1)")
        .groupBy("l_id")
        .agg(F.max("y").alias("y"))
        .where(learnable("l_id"))
    )
    # ids are ranked before any text is read: only the sampled rows' texts are joined
    ranked = marks.withColumn("r", F.xxhash64("l_id"))
    total = {int(r["y"]): int(r["n"]) for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = (
        ranked.where("y = 1").orderBy("r", "l_id").limit(opt_pos)
        .unionByName(ranked.where("y = 0").orderBy("r", "l_id").limit(opt_neg))
    )
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = (
        docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text"), lang.alias("lang"))
        .where(F.col("text").isNotNull() & (F.length("text") <= max_bytes))
        .join(F.broadcast(some), F.col("doc_id") == F.col("l_id"))
        .groupBy("l_id")
        .agg(F.min(F.struct("text", "lang")).alias("t"), F.first("y").alias("y"))
        .select("l_id", "y", "t.text", "t.lang")
    )
    got = rows.toArrow().sort_by("l_id")
    label = got.column("y").to_numpy()
    share = {y: total.get(y, 0) / max(1, int((label == y).sum())) for y in (0, 1)}
    return texts_of(got.column("text")), label, got.column("lang").to_pylist(), share


def train(docs: DataFrame, labels: DataFrame, opt: ToxicityOptions = DEFAULT) -> ToxicityModel:
    """Fit on the labelled rows that may be learned (see ``learnable``)."""
    texts, label, langs, share = training_rows(docs, labels, "toxic", opt.max_positive, opt.max_negative, opt.max_train_bytes)
    model = fit(texts, label, langs, share, opt)
    release_memory()
    return model


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with toxicity_score (double), toxicity_threshold (its
    language's) and toxic (score at or above that threshold).

    A null text scores as the empty one; a null or unknown language has the
    global threshold. All input columns stay; columns of those three names
    are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)
    added = ("toxicity_score", "toxicity_threshold", "toxic")
    keep = kept_columns(docs, added)
    src = only(docs, keep)
    lang = F.col("lang").cast("string") if "lang" in keep else F.lit(None).cast("string")
    wide = src.withColumn("__lang", lang).withColumn("__text", F.col("text").cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for batch in batches:
            p = scores(m, texts_of(batch.column("__text")))
            cut = np.array([m.thresholds.get(v, m.threshold) for v in batch.column("__lang").to_pylist()])
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(p, type=pa.float64()), pa.array(cut, type=pa.float64()), pa.array(p >= cut, type=pa.bool_())],
                names=[*keep, *added],
            )
        release_memory()

    return wide.mapInArrow(run, with_types(src.schema, "toxicity_score double, toxicity_threshold double, toxic boolean"))
