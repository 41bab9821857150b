"""Zip archives (inventory S14, S15), read by byte ranges.

An archive's members are listed from its central directory, which lies at
its end: one task per archive reads that range and nothing else (zip64
included). A chosen member is then read by a task of its own, from its own
range, and streamed out as text lines in bounded batches. No archive is
held whole anywhere, so its size has no limit, and the members of one
archive are read in parallel. Lines are parsed by ``from_csv`` on the JVM
side.

Tasks open files through ``pyarrow.fs`` (local paths, hdfs, s3, gs); for
another store pass ``opener``, a function from a path to a seekable binary
file.
"""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator, Sequence
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.sources.files import _UNKNOWN_HEADER, _distinct_headers, _first_cell, _header_schema, _mapped, _split_header, _union_schema, header_candidate
from strata.sources.dialect import Dialect, canonical_encoding

# Member names skipped in every archive (macOS resource forks).
SKIP_PREFIX = "__MACOSX"

MEMBER_SCHEMA = "archive string, member string, position int, size long, offset long, packed long, method int, crc long"
LINE_SCHEMA = "archive string, member string, line_no long, line string"

Opener = Callable[[str], BinaryIO]

_BATCH_LINES = 50_000

_PY_ENCODING = {"ISO-8859-1": "latin-1", "US-ASCII": "ascii", "UTF-8": "utf-8", "UTF-16": "utf-16", "UTF-16BE": "utf-16-be", "UTF-16LE": "utf-16-le", "UTF-32": "utf-32"}


def open_range(path: str) -> BinaryIO:
    """A seekable file that fetches only what is read from it."""
    import pyarrow.fs as pafs

    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):(?://([^/]*))?(/.*)", path)
    if found is None or found[1] == "file":
        return pafs.LocalFileSystem().open_input_file(found[3] if found else path)
    fs, base = pafs.FileSystem.from_uri(f"{found[1]}://{found[2] or ''}/")
    return fs.open_input_file(base.rstrip("/") + found[3])


def _members(zf: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
    return [i for i in zf.infolist() if not i.is_dir() and not i.filename.startswith(SKIP_PREFIX) and "/__MACOSX/" not in i.filename]


def list_members(spark: SparkSession, pattern: str, opener: Opener = open_range) -> DataFrame:
    """Members of every archive: (archive, member, position, size) and where
    they lie in it. Reads the directories at the archives' ends."""
    files = spark.read.format("binaryFile").load(pattern).select("path")  # lists; reads no content

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path in pdf["path"]:
                with opener(path) as raw, zipfile.ZipFile(raw) as zf:
                    rows = [
                        (path, i.filename, pos, i.file_size, i.header_offset, i.compress_size, i.compress_type, i.CRC) for pos, i in enumerate(_members(zf))
                    ]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MEMBER_SCHEMA.split(", ")])

    return files.mapInPandas(run, MEMBER_SCHEMA)


class MemberStream(io.RawIOBase):
    """The bytes of one member, inflated from its range of the archive."""

    CHUNK = 1 << 20

    def __init__(self, raw: BinaryIO, name: str, offset: int, packed: int, method: int, crc: int):
        if method not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{name}: compression method {method} is not read (stored and deflated members are)")
        raw.seek(offset)
        head = raw.read(30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError(f"{name}: no member starts at byte {offset}")
        if struct.unpack("<H", head[6:8])[0] & 1:
            raise ValueError(f"{name}: encrypted members are not read")
        raw.seek(offset + 30 + sum(struct.unpack("<HH", head[26:30])))
        self._raw, self._name, self._left, self._crc, self._seen = raw, name, packed, crc, 0
        self._inflate = zlib.decompressobj(-15) if method else None
        self._held = b""

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:  # noqa: ANN001 - a writable buffer
        while not self._held:
            pending = self._inflate.unconsumed_tail if self._inflate else b""
            if not pending and self._left:
                pending = self._raw.read(min(self.CHUNK, self._left))
                if not pending:
                    raise EOFError(f"{self._name}: the archive ends inside the member")
                self._left -= len(pending)
            if not pending:
                self._held = self._inflate.flush() if self._inflate else b""
                if not self._held:
                    if self._seen != self._crc:
                        raise ValueError(f"{self._name}: checksum differs")
                    return 0
            else:
                self._held = self._inflate.decompress(pending, self.CHUNK) if self._inflate else pending
            self._seen = zlib.crc32(self._held, self._seen)
        n = min(len(target), len(self._held))
        target[:n], self._held = self._held[:n], self._held[n:]
        return n


def pick_members(
    members: DataFrame,
    strategy: str = "first_csv",
    keywords: Sequence[str] = (),
    fallback: int = 3,
) -> DataFrame:
    """Choose members per archive with Spark expressions.

    * ``first_csv``: the first ``.csv`` member;
    * ``all_csvs``: every ``.csv`` member;
    * ``essential``: CSVs whose name holds a keyword; if none, the first
      ``fallback`` CSVs;
    * ``first_csv_or_xlsx``: the first ``.csv`` or ``.xlsx``;
    * ``keyword_rank``: members ranked by how many keyword groups (in
      order of preference) they match; the best one.
    """
    name = F.lower(F.col("member"))
    is_csv = name.endswith(".csv")
    w = Window.partitionBy("archive").orderBy("position")
    if strategy == "first_csv":
        c = members.filter(is_csv).withColumn("_r", F.row_number().over(w))
        return c.filter(F.col("_r") == 1).drop("_r")
    if strategy == "all_csvs":
        return members.filter(is_csv)
    if strategy == "first_csv_or_xlsx":
        c = members.filter(is_csv | name.endswith(".xlsx")).withColumn("_r", F.row_number().over(w))
        return c.filter(F.col("_r") == 1).drop("_r")
    if strategy == "essential":
        hit = F.lit(False)
        for k in keywords:
            hit = hit | name.contains(k.lower())
        c = members.filter(is_csv).withColumns(
            {"_hit": hit, "_r": F.row_number().over(w)}
        )
        any_hit = F.max(F.col("_hit").cast("int")).over(Window.partitionBy("archive"))
        c = c.withColumn("_any", any_hit == 1)
        return c.filter(F.when(F.col("_any"), F.col("_hit")).otherwise(F.col("_r") <= fallback)).drop("_hit", "_r", "_any")
    if strategy == "keyword_rank":
        # keywords are groups like "per capita&100 maiores", "per capita"; earlier = better
        pref = F.lit(len(keywords))
        for i in reversed(range(len(keywords))):
            cond = F.lit(True)
            for part in keywords[i].split("&"):
                cond = cond & name.contains(part.strip().lower())
            pref = F.when(cond, F.lit(i)).otherwise(pref)
        c = members.withColumn("_p", pref).withColumn(
            "_r", F.row_number().over(Window.partitionBy("archive").orderBy("_p", "position"))
        )
        return c.filter(F.col("_r") == 1).drop("_p", "_r")
    raise ValueError(f"unknown strategy {strategy!r}")


def read_zip_lines(
    spark: SparkSession, pattern: str, chosen: DataFrame | None = None, encoding: str = "UTF-8", opener: Opener = open_range
) -> DataFrame:
    """Text lines of chosen members (all members when ``chosen`` is None).

    ``chosen`` holds rows of ``list_members``, e.g. from ``pick_members``, or
    (archive, member) pairs. Members are dealt over the session's shuffle
    partitions; a task streams its members one after another, line by line
    in batches of 50,000.
    """
    py_enc = _PY_ENCODING[canonical_encoding(encoding)]
    where = ["archive", "member", "offset", "packed", "method", "crc"]
    if chosen is None or "offset" not in chosen.columns:
        members = list_members(spark, pattern, opener)
        chosen = members if chosen is None else members.join(chosen.select("archive", "member").distinct(), ["archive", "member"], "left_semi")
    spread = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for m in pdf.itertuples(index=False):
                buf: list[tuple[str, str, int, str]] = []
                with opener(m.archive) as raw:
                    stream = MemberStream(raw, f"{m.archive}!{m.member}", m.offset, m.packed, m.method, m.crc)
                    text = io.TextIOWrapper(io.BufferedReader(stream, MemberStream.CHUNK), encoding=py_enc, newline=None)
                    for n, line in enumerate(text, start=1):
                        buf.append((m.archive, m.member, n, line.rstrip("\n")))
                        if len(buf) >= _BATCH_LINES:
                            yield pd.DataFrame(buf, columns=["archive", "member", "line_no", "line"])
                            buf = []
                if buf:
                    yield pd.DataFrame(buf, columns=["archive", "member", "line_no", "line"])

    return chosen.select(*where).repartition(spread).mapInPandas(run, LINE_SCHEMA)


def read_zip_csv(
    spark: SparkSession,
    pattern: str,
    dialect: Dialect = Dialect(),
    strategy: str = "first_csv",
    keywords: Sequence[str] = (),
    schema: T.StructType | None = None,
) -> DataFrame:
    """S14 + S15: CSV rows from chosen members of every archive.

    The header is the first line of each member after ``dialect.preamble``
    title lines (or found by the header rule, "auto"); columns are mapped by
    each member's own header, as in ``read_csv``. A member without a header
    row, or with one that shares no name with ``schema`` (unless
    ``dialect.by_position``), fails the query and is named.
    """
    chosen = pick_members(list_members(spark, pattern), strategy, keywords)
    lines = read_zip_lines(spark, pattern, chosen, dialect.encoding)
    if dialect.preamble == "auto":
        cand = lines.filter(header_candidate(_first_cell(F.col("line"), dialect)))
    else:
        cand = lines.filter(F.col("line_no") > int(dialect.preamble or 0))
    # one row per member: its header line
    marks = cand.groupBy("archive", "member").agg(F.min(F.struct("line_no", "line")).alias("_h"))
    marks = marks.select("archive", "member", F.col("_h.line_no").alias("_hdr"), F.col("_h.line").alias("_header")).checkpoint()
    headers = _distinct_headers(marks, "_header", pattern)
    target = schema or _union_schema(headers, dialect, False)
    # one archive member is streamed by one task; spreading its lines over
    # the shuffle partitions lets parsing and everything after run in parallel
    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    tagged = lines.repartition(parts).join(marks, ["archive", "member"], "left")
    body = tagged.filter(F.col("_hdr").isNull() | (F.col("line_no") > F.col("_hdr")) & (F.trim("line") != ""))
    opts = {"sep": dialect.sep, "quote": dialect.quote, "escape": dialect.escape, "mode": "PERMISSIVE"}
    why = F.when(F.col("_hdr").isNull(), "no header row found in ").otherwise(_UNKNOWN_HEADER)
    row = F.raise_error(F.concat(why, F.col("archive"), F.lit("!"), F.col("member"))).cast(target)
    for header in headers:
        own = _header_schema(_split_header(header, dialect), target, dialect.by_position)
        if own is None:
            continue
        parsed = F.from_csv(F.col("line"), own.simpleString(), opts)
        row = F.when(F.col("_header") == header, F.struct(*_mapped(parsed, own, target))).otherwise(row)
    out = body.select(row.alias("_r"), "archive", F.element_at(F.split("member", "/"), -1).alias("source_file"))
    return out.select(*[F.col(f"_r.`{n}`").alias(n) for n in target.fieldNames()], "source_file", "archive")
