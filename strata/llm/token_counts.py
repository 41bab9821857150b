"""Token counts by a map-side two-tier look-up of pre-token lengths.

BPE works on each pre-token alone, so a text has as many tokens as its
pre-tokens have together. Tier one is a compact table of frequent
pre-tokens and their token counts, broadcast: the vocabulary's own whole
words and the most frequent pre-tokens of a bounded sample of documents
(``sample_rows``; at most ``max_entries`` entries of at most ``max_bytes``
each, a few MB at any corpus size). Tier two is a cache in each Python
worker: a miss is encoded once by the library and kept; a full cache starts
again from tier one. Nothing is shuffled, and results do not depend on
what either tier holds.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import kept_columns, only, with_types
from .pretokens import Splitter
from .textops import texts_of


@dataclass(frozen=True)
class CountOptions:
    sample_rows: int = 500
    max_sample_bytes: int = 100_000
    max_entries: int = 80_000
    max_bytes: int = 64
    cache_entries: int = 200_000


DEFAULT = CountOptions()


def load_tokenizer(path: str):  # noqa: ANN201
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Lengths(dict):
    """Token counts of pre-tokens: the broadcast table, then what the worker
    had to encode; bounded."""

    def __init__(self, table: dict[str, int], tokenizer, room: int) -> None:  # noqa: ANN001
        super().__init__(table)
        self.table, self.tokenizer, self.room = table, tokenizer, room

    def __missing__(self, token: str) -> int:
        if len(self) >= len(self.table) + self.room:
            self.clear()
            self.update(self.table)
        n = len(self.tokenizer.encode(token, add_special_tokens=False).ids)
        self[token] = n
        return n


def count_tokens(text: str, splitter: Splitter, lengths: Lengths) -> int:
    total = 0
    for k, part in enumerate(splitter.segments(text)):
        if k % 2:
            total += 1  # a special string
        else:
            total += sum(map(lengths.__getitem__, splitter.split(part)))
    return total


def frequent_lengths(docs: DataFrame, tokenizer_path: str, opt: CountOptions = DEFAULT) -> dict[str, int]:
    """Tier one. The sample is the ``sample_rows`` documents of least id hash
    (texts of up to ``max_sample_bytes``); it sets the speed, not results."""
    tokenizer = load_tokenizer(tokenizer_path)
    splitter = Splitter(tokenizer)
    ids = docs.select(F.col("doc_id").alias("s_id")).where("s_id is not null")
    ids = ids.orderBy(F.xxhash64("s_id"), "s_id").limit(opt.sample_rows).distinct()
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where(F.length("text") <= opt.max_sample_bytes)
    # repeated ids bring further rows along, hence the second limit
    rows = rows.join(F.broadcast(ids), F.col("doc_id") == F.col("s_id")).select("text").limit(2 * opt.sample_rows)
    seen: Counter[str] = Counter()
    for text in texts_of(rows.toArrow().column("text")):
        for k, part in enumerate(splitter.segments(text.decode("utf-8", "replace"))):
            if k % 2 == 0:
                seen.update(splitter.split(part))
    table: dict[str, int] = {}
    for word in sorted(tokenizer.get_vocab(), key=tokenizer.token_to_id):
        plain = word.removesuffix("</w>")
        if word.endswith("</w>") and plain.isascii() and splitter.split(plain) == [plain]:
            seen.setdefault(plain, 0)
    fit = [t for t, _ in seen.most_common() if len(t.encode()) <= opt.max_bytes][: opt.max_entries]
    for token, made in zip(fit, tokenizer.encode_batch(fit, add_special_tokens=False), strict=True):
        table[token] = len(made.ids)
    return table


_workers: dict[str, tuple] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, opt: CountOptions = DEFAULT) -> DataFrame:
    """``docs`` with n_tokens, the number of tokens of the whole text.

    A null text counts as the empty one (0 tokens). Special strings inside
    a text count as one token each, as by the library's default. All input
    columns stay; a column n_tokens is replaced. ``tokenizer_path`` must
    name the vocabulary file on every executor.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer_path, opt))
    keep = kept_columns(docs, ("n_tokens",))
    src = only(docs, keep)
    room = opt.cache_entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strata.llm import token_counts as own  # the worker's own module keeps the cache between tasks

        key = f"{tokenizer_path}|{len(held.value)}|{room}"
        if key not in own._workers:
            tokenizer = load_tokenizer(tokenizer_path)
            own._workers.clear()
            own._workers[key] = (Splitter(tokenizer), Lengths(held.value, tokenizer, room))
        splitter, lengths = own._workers[key]
        for batch in batches:
            counts = [count_tokens(t.decode("utf-8", "replace"), splitter, lengths) for t in texts_of(batch.column("__text"))]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, type=pa.int64())], names=[*keep, "n_tokens"])

    return src.withColumn("__text", docs["text"].cast("binary")).mapInArrow(run, with_types(src.schema, "n_tokens bigint"))
