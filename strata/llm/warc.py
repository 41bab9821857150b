"""WARC archives: write, normalise to one gzip member per record, read back.

``write_archives`` turns rows into archives that are one gzip stream each,
as some crawlers leave them: such a file can only be read from its start.
``normalise_archives`` inflates each of them once, as a stream, rewrites
every record as a gzip member of its own and writes a sidecar index
(``<archive>.idx``, a JSON line per record with offset and length), so any
record can be read by one seek. Records whose payload a chosen other record
has too are rewritten as revisit records without the payload.
``read_records`` reads by index rows, so many tasks share a large archive.

No payload is shuffled: which copy stays is decided on narrow rows
(digest and id, combined map-side), and each normalising task gets its
archives' decisions in record order. Archives are closed at
``max_archive_bytes``, so a task's work is bounded; records stream through
in chunks. Files are written under a name of their own and listed only by
rows that a finished task returned, so a lost executor leaves at most
unlisted files behind. Paths may be of any file system that Arrow opens
(local, HDFS, S3); the folder must be shared by the cluster.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import texts_of

# Fixed values
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 1000
_DATE = "1970-01-01T00:00:00Z"  # the table has no fetch time
_CHUNK = 1 << 18
_MAX_HEADER = 1 << 20


@dataclass(frozen=True)
class WarcOptions:
    max_archive_bytes: int = 64 << 20  # payload bytes after which an archive is closed
    level: int = 6
    min_revisit_bytes: int = MIN_REVISIT_BYTES


DEFAULT = WarcOptions()


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def _header_value(text: str) -> str:
    """A header value must stay on its line; control characters are escaped."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in text)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def response_head(page_id: int | None, url: str | None, size: int, digest: str) -> bytes:
    """Record header and HTTP header of a response; the payload follows."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC-Type: response",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + size}",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _revisit_head(head: dict[str, str], refers_to: int) -> bytes:
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    lines = [
        "WARC-Type: revisit",
        f"WARC-Record-ID: {head['warc-record-id']}",
        f"WARC-Date: {head['warc-date']}",
        *([f"WARC-Target-URI: {head['warc-target-uri']}"] if "warc-target-uri" in head else []),
        f"WARC-Profile: {PROFILE}",
        f"WARC-Refers-To: {record_id(refers_to, digest)}",
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"X-Page-Id: {head['x-page-id']}"] if "x-page-id" in head else []),
        f"X-Refers-To-Page-Id: {refers_to}",
        f"X-Payload-Length: {head['x-payload-length']}",
        "Content-Length: 0",
    ]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"


def parse_head(block: bytes) -> dict[str, str]:
    """Header fields by lower-cased name."""
    version, *lines = block.decode("utf-8", "replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}


class Inflated:
    """Reads a gzip file front to back: one stream, or many members."""

    def __init__(self, stream) -> None:  # noqa: ANN001 - a file object
        self.stream, self.held, self.raw = stream, bytearray(), b""
        self.gunzip = zlib.decompressobj(wbits=31)

    def _more(self) -> bool:
        raw = self.raw or self.stream.read(_CHUNK)
        self.raw = b""
        if not raw:
            if self.gunzip.eof or not self.started:
                return False
            rest = self.gunzip.decompress(b"", _CHUNK * 4)  # what the last call held back
            if not rest and not self.gunzip.eof:
                raise EOFError("the gzip stream is cut short")
            self.held += rest
            return bool(rest)
        if self.gunzip.eof:
            self.gunzip = zlib.decompressobj(wbits=31)
        self.held += self.gunzip.decompress(raw, _CHUNK * 4)
        self.raw = self.gunzip.unconsumed_tail or self.gunzip.unused_data
        self.started = True
        return True

    started = False

    def until(self, mark: bytes) -> bytes | None:
        """Everything up to ``mark`` (which is skipped); None at the end."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > _MAX_HEADER:
                raise ValueError("no end of a record header in 1 MB")
            if not self._more():
                if self.held.strip():
                    raise EOFError("the archive ends inside a record header")
                return None
        out = bytes(self.held[:at])
        del self.held[: at + len(mark)]
        return out

    def take(self, size: int) -> Iterator[bytes]:
        """The next ``size`` bytes in chunks."""
        while size:
            if not self.held and not self._more():
                raise EOFError("the archive ends inside a record")
            part = bytes(self.held[:size])
            del self.held[: len(part)]
            size -= len(part)
            if part:
                yield part


def records(stream) -> Iterator[tuple[dict[str, str], bytes, Callable[[], Iterator[bytes]]]]:  # noqa: ANN001
    """(fields, raw header, block reader) of each record of a gzip WARC.

    A block that the caller doesn't read is skipped."""
    source = Inflated(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        fields = parse_head(head)
        block = source.take(int(fields["content-length"]))
        yield fields, head + b"\r\n\r\n", lambda block=block: block
        for _ in block:
            pass
        if b"".join(source.take(4)) != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")


class _Writer:
    """A gzip file written through a name of its own."""

    def __init__(self, folder: str, name: str) -> None:
        self.path = f"{folder.rstrip('/')}/{name}"
        self.fs, inner = _file_system(self.path)
        self.fs.create_dir(inner.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(inner, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)


_ROW = "archive string, ordinal bigint, page_id bigint, n_bytes bigint, digest string"


def write_archives(pages: DataFrame, folder: str, opt: WarcOptions = DEFAULT) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a response record.

    Each task writes archives of one gzip stream each. Returns, per record,
    its archive, its place there, page_id, payload size and SHA-1 digest (of
    the html in UTF-8; a null html is the empty payload). Repeated rows are
    records of their own.
    """
    src = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("binary").alias("html"))
    limit, level = opt.max_archive_bytes, opt.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pack = None
        ordinal = size = 0

        def close() -> None:
            out.write(pack.flush())
            out.out.close()

        for batch in batches:
            rows: list[tuple] = []
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            for page_id, url, html in zip(ids, urls, texts_of(batch.column("html")), strict=True):
                if out is not None and size > limit:
                    close()
                    out = None
                if out is None:
                    out = _Writer(folder, f"crawl-{uuid.uuid4().hex}.warc.gz")
                    pack = zlib.compressobj(level, wbits=31)
                    ordinal = size = 0
                digest = hashlib.sha1(html).hexdigest()
                out.write(pack.compress(response_head(page_id, url, len(html), digest)))
                out.write(pack.compress(html))
                out.write(pack.compress(b"\r\n\r\n"))
                rows.append((out.path, ordinal, page_id, len(html), digest))
                ordinal += 1
                size += len(html)
            names = ["archive", "ordinal", "page_id", "n_bytes", "digest"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)
        if out is not None:
            close()

    return src.mapInArrow(run, _ROW).checkpoint()


def choose_copies(written: DataFrame, opt: WarcOptions = DEFAULT) -> DataFrame:
    """``written`` with refers_to: of equal payloads of ``min_revisit_bytes``
    or more, the records other than those with the largest page_id refer to
    it; null for all others. A null page_id is never the largest."""
    groups = (
        written.where(F.col("n_bytes") >= opt.min_revisit_bytes)
        .groupBy("digest", "n_bytes")
        .agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("g_digest"), F.col("n_bytes").alias("g_bytes"), "best")
    )
    # null-safe, so both sides get an exchange and a hot digest can be split
    on = F.col("digest").eqNullSafe(F.col("g_digest")) & F.col("n_bytes").eqNullSafe(F.col("g_bytes"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("best")), F.col("best"))
    return written.join(groups, on, "left").select(*written.columns, refers.alias("refers_to"))


_INDEX = (
    "archive string, offset bigint, length bigint, ordinal bigint, record_id string, record_type string, "
    "page_id bigint, refers_to bigint"
)


def normalise_archives(decided: DataFrame, folder: str, opt: WarcOptions = DEFAULT) -> DataFrame:
    """Rewrite archives with one gzip member per record and a sidecar index.

    ``decided`` has (archive, ordinal, refers_to) for every record. Returns
    the index: per record its new archive, offset and compressed length,
    record id and type, page_id and refers_to.
    """
    src = decided.select("archive", "ordinal", "refers_to")
    spread = int(decided.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = src.repartition(spread, "archive").sortWithinPartitions("archive", "ordinal")
    level = opt.level
    names = ["archive", "offset", "length", "ordinal", "record_id", "record_type", "page_id", "refers_to"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def rewrite(path: str, refers: Iterator[int | None]) -> Iterator[tuple]:
        fs, inner = _file_system(path)
        with fs.open_input_stream(inner, compression=None) as stream:
            out = _Writer(folder, f"{path.rpartition('/')[2].removesuffix('.warc.gz')}-{uuid.uuid4().hex[:8]}.warc.gz")
            side = _Writer(folder, f"{out.path.rpartition('/')[2]}.idx")
            for ordinal, ((fields, head, block), refer) in enumerate(zip(records(stream), refers, strict=True)):
                pack = zlib.compressobj(level, wbits=31)
                start, kind = out.size, fields["warc-type"]
                if refer is None:
                    out.write(pack.compress(head))
                    for part in block():
                        out.write(pack.compress(part))
                else:
                    kind = "revisit"
                    out.write(pack.compress(_revisit_head(fields, refer)))
                out.write(pack.compress(b"\r\n\r\n"))
                out.write(pack.flush())
                page = int(fields["x-page-id"]) if "x-page-id" in fields else None
                row = (out.path, start, out.size - start, ordinal, fields["warc-record-id"], kind, page, refer)
                side.write(json.dumps(dict(zip(names, row, strict=True))).encode() + b"\n")
                yield row
            out.out.close()
            side.out.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[str, int | None]]:
            for batch in batches:
                yield from zip(batch.column("archive").to_pylist(), batch.column("refers_to").to_pylist(), strict=True)

        made: list[tuple] = []
        todo = rows()
        ahead = next(todo, None)
        while ahead is not None:
            path = ahead[0]

            def own(path: str = path) -> Iterator[int | None]:
                nonlocal ahead
                while ahead is not None and ahead[0] == path:
                    refer = ahead[1]
                    ahead = next(todo, None)
                    yield refer

            for row in rewrite(path, own()):
                made.append(row)
                if len(made) == 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], type=t) for k, t in enumerate(kinds)], names=names)
                    made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in made], type=t) for k, t in enumerate(kinds)], names=names)

    return src.mapInArrow(run, _INDEX).checkpoint()


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read records by their index rows (archive, offset, length).

    Returns page_id, url, payload_bytes, payload_digest, record_type,
    refers_to and, if asked for, the payload (null for a revisit, whose size
    and digest are those of the payload it refers to). A payload whose
    digest differs from its header's fails the job.
    """
    src = index.select("archive", "offset", "length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = file = None
        for batch in batches:
            rows: list[tuple] = []
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != path:
                    if file is not None:
                        file.close()
                    fs, inner = _file_system(archive)
                    path, file = archive, fs.open_input_file(inner)
                file.seek(offset)
                data = zlib.decompress(file.read(length), wbits=31)
                head, _, rest = data.partition(b"\r\n\r\n")
                fields = parse_head(head)
                kind = fields["warc-type"]
                block = rest[: int(fields["content-length"])]
                digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                payload = None
                if kind == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"damaged record at {archive}:{offset}")
                page, refer = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                rows.append((page and int(page), fields.get("warc-target-uri"), size, digest, kind, refer and int(refer), payload if payloads else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)]
            names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            yield pa.RecordBatch.from_arrays(cols if payloads else cols[:-1], names=names if payloads else names[:-1])
        if file is not None:
            file.close()

    types = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
    return src.mapInArrow(run, types + (", payload binary" if payloads else ""))


def archive_pages(pages: DataFrame, folder: str, opt: WarcOptions = DEFAULT) -> DataFrame:
    """Write, normalise and index ``pages``; returns the index."""
    written = write_archives(pages, f"{folder.rstrip('/')}/crawl", opt)
    return normalise_archives(choose_copies(written, opt), f"{folder.rstrip('/')}/normal", opt)
