"""CSV dialects (inventory S2): separator, encoding, quoting, title lines."""

from __future__ import annotations

from dataclasses import dataclass

# Encodings the CSV reader accepts, and the aliases people
# write for them.
CANONICAL_ENCODINGS = ("ISO-8859-1", "US-ASCII", "UTF-8", "UTF-16", "UTF-16BE", "UTF-16LE", "UTF-32")
ENCODING_ALIASES = {
    "latin-1": "ISO-8859-1",
    "latin1": "ISO-8859-1",
    "latin_1": "ISO-8859-1",
    "iso8859-1": "ISO-8859-1",
    "iso-8859-1": "ISO-8859-1",
    "iso_8859_1": "ISO-8859-1",
    "l1": "ISO-8859-1",
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "utf_8": "UTF-8",
    "ascii": "US-ASCII",
    "us-ascii": "US-ASCII",
    "utf16": "UTF-16",
    "utf-16": "UTF-16",
    "utf-16be": "UTF-16BE",
    "utf-16le": "UTF-16LE",
    "utf32": "UTF-32",
    "utf-32": "UTF-32",
}


def canonical_encoding(name: str) -> str:
    """Map an encoding name or alias to the name the reader accepts."""
    key = name.strip().lower()
    if key in ENCODING_ALIASES:
        return ENCODING_ALIASES[key]
    up = name.strip().upper()
    if up in CANONICAL_ENCODINGS:
        return up
    raise ValueError(f"unsupported encoding {name!r}; use one of {CANONICAL_ENCODINGS}")


@dataclass(frozen=True)
class Dialect:
    """How a delimited text file is written.

    ``preamble``: title lines above the header (an int), or ``"auto"`` to
    detect the header row per file (S4). ``multiline``: quoted fields may
    hold line breaks (then each file is read by one task). ``by_position``:
    a header found below title lines that shares no name with the given
    schema stands for it column by column; otherwise such a file's rows are
    corrupt records, or fail the query.
    """

    sep: str = ","
    encoding: str = "UTF-8"
    quote: str = '"'
    escape: str = '"'
    header: bool = True
    multiline: bool = False
    preamble: int | str = 0
    null_value: str | None = None
    date_format: str | None = None
    timestamp_format: str | None = None
    by_position: bool = False

    def options(self) -> dict[str, str]:
        opts = {
            "sep": self.sep,
            "encoding": canonical_encoding(self.encoding),
            "quote": self.quote,
            "escape": self.escape,
            "header": str(self.header).lower(),
            "multiLine": str(self.multiline).lower(),
        }
        if self.null_value is not None:
            opts["nullValue"] = self.null_value
        if self.date_format:
            opts["dateFormat"] = self.date_format
        if self.timestamp_format:
            opts["timestampFormat"] = self.timestamp_format
        return opts


# Common dialects of public statistical sources.
SEMICOLON_LATIN1 = Dialect(sep=";", encoding="ISO-8859-1")
PIPE_LATIN1 = Dialect(sep="|", encoding="ISO-8859-1")
COMMA_UTF8 = Dialect()
TAB_UTF8 = Dialect(sep="\t")
