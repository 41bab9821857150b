"""BPE encoding and decoding with forced boundaries.

Two neighbouring bytes that stand next to each other inside no vocabulary
token can never end up in one token, so between them lies a certain cut.
Each pre-token is split at its certain cuts, the fragments are merged
independently and their ids joined. Fragments are short and recur, so each
worker keeps those that it has merged; only a pre-token's last fragment
ends with the word-end mark. The merges inside one fragment are applied in
rank order by the library's bare merge model. Caches live for a task;
the encoder itself stays with the worker.

Decoding maps ids back to their token strings, joined by one space, as the
vocabulary file names no decoder.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, release_memory, with_types
from .pretokens import Splitter, to_alphabet
from .textops import texts_of
from .token_counts import load_tokenizer

_END = "</w>"
# Of a pre-token: token count, ids as text, decoded text, ids as 32-bit numbers.
Piece = tuple[int, str, str, bytes]


@dataclass(frozen=True)
class BpeOptions:
    cache_entries: int = 60_000  # of each generation; some 0.5 kB each


DEFAULT = BpeOptions()


class Bpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, room: int = DEFAULT.cache_entries) -> None:
        from tokenizers.models import BPE

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        # the merge rules alone, without and with the word-end mark after the last byte
        self._models = (BPE(vocab=self.ids, merges=pairs), BPE(vocab=self.ids, merges=pairs, end_of_word_suffix=_END))
        self.splitter = Splitter(load_tokenizer(path))
        self.tokens = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.splitter.specials.items()}
        inside = set()
        for token in self.ids:
            plain = token.removesuffix(_END)
            inside.update(zip(plain, plain[1:], strict=False))
        self.inside = inside  # byte pairs that some token holds; any other pair is a cut
        self.room = room
        self._fragments: dict[tuple[str, bool], tuple[int, ...]] = {}
        # two generations: what the older one still gives is moved to the newer
        # one, and when that is full, the older goes
        self._pieces: dict[str, Piece] = {}
        self._older: dict[str, Piece] = {}

    def fragments(self, word: str) -> list[str]:
        """``word`` (in the byte alphabet) split at its certain cuts."""
        inside = self.inside
        cuts = [k for k, pair in enumerate(zip(word, word[1:], strict=False), 1) if pair not in inside]
        if not cuts:
            return [word]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def _merge(self, fragment: str, last: bool) -> tuple[int, ...]:
        """Ids of one fragment by the vocabulary's merges in rank order."""
        return tuple([t.id for t in self._models[last].tokenize(fragment)])

    def _word(self, token: str) -> tuple[int, ...]:
        pieces = self.fragments(to_alphabet(token))
        ids: list[int] = []
        for k, piece in enumerate(pieces, 1):
            key = (piece, k == len(pieces))
            got = self._fragments.get(key)
            if got is None:
                if len(self._fragments) >= self.room:
                    self._fragments.clear()
                got = self._merge(*key)
                if len(piece) <= 64:  # long ones hardly recur, and would fill the memory
                    self._fragments[key] = got
            ids += got
        return tuple(ids)

    def piece(self, token: str) -> Piece:
        """The pre-token's piece, merged only where neither generation has it."""
        got = self._pieces.get(token)
        if got is None:
            got = self._older.get(token)
            if got is None:
                ids = self._word(token)
                got = (len(ids), " ".join(map(str, ids)), self.decode(ids), array("i", ids).tobytes())
            if len(token) <= 64:  # long ones hardly recur, and would fill the memory
                if len(self._pieces) >= self.room:
                    self._older, self._pieces = self._pieces, {}
                self._pieces[token] = got
        return got

    def forget(self) -> None:
        """Empty the caches: a worker between tasks holds the vocabulary only."""
        self._pieces, self._older, self._fragments = {}, {}, {}

    def pieces(self, text: str) -> list[Piece]:
        out = []
        for k, part in enumerate(self.splitter.segments(text)):
            if k % 2:
                i = self.splitter.specials[part]
                out.append((1, str(i), part, array("i", [i]).tobytes()))
            else:
                out += map(self.piece, self.splitter.split(part))
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", b"".join([p[3] for p in self.pieces(text)])).tolist()

    def decode(self, ids) -> str:  # noqa: ANN001
        return " ".join(map(self.tokens.__getitem__, ids))


_workers: dict[str, Bpe] = {}


def _worker_bpe(path: str, room: int) -> Bpe:
    from strata.llm import bpe as own  # the worker's own module keeps the encoder between tasks

    if path not in own._workers:
        own._workers.clear()
        own._workers[path] = own.Bpe(path, room)
    return own._workers[path]


def encode_documents(docs: DataFrame, tokenizer_path: str, opt: BpeOptions = DEFAULT, ids: bool = True, digests: bool = False) -> DataFrame:
    """``docs`` with n_tokens and, as asked for, token_ids (array<int>) and
    the digests ids_sha256 (decimal ids joined by one space) and
    decoded_sha256 (of the text that decoding the ids gives).

    A null text is encoded as the empty one, to no ids. All input columns
    stay; columns of the added names are replaced.
    """
    added = ("n_tokens", *(("token_ids",) if ids else ()), *(("ids_sha256", "decoded_sha256") if digests else ()))
    types = {"n_tokens": "bigint", "token_ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string"}
    keep = kept_columns(docs, added)
    src = only(docs, keep)
    room = opt.cache_entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(tokenizer_path, room)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):  # bounds the ids held at once
                batch = whole.slice(at, 500)
                made = {c: [] for c in added}
                packed: list[bytes] = []
                for text in texts_of(batch.column("__text")):
                    pieces = bpe.pieces(text.decode("utf-8", "replace"))
                    made["n_tokens"].append(sum([p[0] for p in pieces]))
                    if ids:
                        packed += [p[3] for p in pieces]
                    if digests:
                        made["ids_sha256"].append(hashlib.sha256(" ".join([p[1] for p in pieces]).encode()).hexdigest())
                        made["decoded_sha256"].append(hashlib.sha256(" ".join([p[2] for p in pieces]).encode()).hexdigest())
                cols = [batch.column(c) for c in keep]
                counts = np.array(made["n_tokens"], dtype=np.int64)
                new = [pa.array(counts)]
                if ids:
                    flat = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    new.append(pa.ListArray.from_arrays(pa.array(ends), flat))
                new += [pa.array(made[c], type=pa.string()) for c in added if c.endswith("sha256")]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=[*keep, *added])
        bpe.forget()
        release_memory()

    schema = with_types(src.schema, ", ".join(f"{c} {types[c]}" for c in added))
    return src.withColumn("__text", docs["text"].cast("binary")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, tokenizer_path: str, ids_col: str = "token_ids", opt: BpeOptions = DEFAULT) -> DataFrame:
    """``encoded`` with decoded, the text of its ids; null ids decode to null."""
    keep = kept_columns(encoded, ("decoded",))
    src = only(encoded, keep)
    room = opt.cache_entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker_bpe(tokenizer_path, room)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                text = [None if v is None else bpe.decode(v) for v in batch.column("__ids").to_pylist()]
                cols = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(text, type=pa.string())], names=[*keep, "decoded"])

    return src.withColumn("__ids", encoded[ids_col]).mapInArrow(run, with_types(src.schema, "decoded string"))
