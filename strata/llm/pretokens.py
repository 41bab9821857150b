"""Pre-tokens of the word-end BPE vocabulary, without the tokenizer's objects.

The vocabulary file states how a text is prepared: special strings are cut
out of the raw text, the rest is normalised (NFC, lower case) and split by
a pattern into contractions, runs of letters, single numbers and runs of
other signs. For texts made of the characters in ``SAFE`` alone, Python's
own lower-casing and a compiled pattern do the same as the library (shown
for every one of these characters in the tests); any other text goes
through the library's normaliser and splitter.
"""

from __future__ import annotations

import re
import unicodedata

# Code points below U+0180 (Latin with common accents) and punctuation, whose
# lower case stays among them.
# U+0130 is left out: its lower case is two code points.
SAFE = "".join(
    chr(c) for c in [*range(0x0180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC, 0x2122] if c != 0x130
)
_SPACES = "".join(c for c in SAFE if c.isspace() and not "\x1c" <= c <= "\x1f")


def _class(kind: str) -> str:
    return re.escape("".join(c for c in SAFE if unicodedata.category(c)[0] == kind))


_UNSAFE = re.compile(f"[^{re.escape(SAFE)}]")
_SPLIT = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_class('L')}]+|[{_class('N')}]|[^{re.escape(_SPACES)}{_class('L')}{_class('N')}]+"
)


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte: visible Latin-1 bytes stand for
    themselves, the others for the code points from U+0100 on, in order."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_BYTE_TO_CHAR = byte_alphabet()
_CHAR_TO_BYTE = {c: b for b, c in _BYTE_TO_CHAR.items()}


def to_alphabet(token: str) -> str:
    if token.isascii() and token.isprintable() and " " not in token:
        return token  # these bytes stand for themselves
    return "".join(_BYTE_TO_CHAR[b] for b in token.encode())


class Splitter:
    """Splits texts into pre-tokens and special strings.

    Holds the tokenizer's normaliser and splitter only, not its vocabulary."""

    def __init__(self, tokenizer) -> None:  # noqa: ANN001 - a tokenizers.Tokenizer
        self.normalizer, self.pre_tokenizer = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.specials = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        names = sorted(self.specials, key=len, reverse=True)
        self._special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def segments(self, text: str) -> list[str]:
        """The text around special strings, and these, in turn."""
        return self._special.split(text) if self._special else [text]

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text that holds no special string."""
        if _UNSAFE.search(text) is None:
            return _SPLIT.findall(text.lower())
        normal = self.normalizer.normalize_str(text)
        made = self.pre_tokenizer.pre_tokenize_str(normal)
        return [bytes(_CHAR_TO_BYTE[c] for c in t).decode() for t, _ in made]
