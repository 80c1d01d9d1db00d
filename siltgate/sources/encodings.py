"""Source encodings: which Spark charset reads them, and how their bytes become characters."""

from __future__ import annotations

import codecs
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from siltgate.errors import fail

# Charsets Spark's CSV reader decodes by itself, by Python codec name.
SPARK_CHARSETS = {
    "utf-8": "UTF-8",
    "utf-8-sig": "UTF-8",
    "ascii": "US-ASCII",
    "iso8859-1": "ISO-8859-1",
    "utf-16": "UTF-16",
    "utf-16-le": "UTF-16LE",
    "utf-16-be": "UTF-16BE",
    "utf-32": "UTF-32",
    "utf-32-le": "UTF-32LE",
    "utf-32-be": "UTF-32BE",
}
REPLACEMENT = "\ufffd"


@dataclass(frozen=True)
class Encoding:
    """How to read one encoding. Single-byte code pages are read as Latin-1, then mapped."""

    name: str
    codec: str
    charset: str
    mapped_from: str = ""
    mapped_to: str = ""

    @property
    def by_line(self) -> bool:
        """Lines can be found in the raw bytes."""
        return not self.codec.startswith(("utf-16", "utf-32"))

    @property
    def checks_bytes(self) -> bool:
        """Bad bytes are possible, and would be read as U+FFFD."""
        return self.charset != "ISO-8859-1" or REPLACEMENT in self.mapped_to

    def decode(self, column: Column) -> Column:
        return F.translate(column, self.mapped_from, self.mapped_to) if self.mapped_from else column


def resolve(name: str, path: str) -> Encoding:
    try:
        codec = codecs.lookup(name).name
    except LookupError:
        raise fail("source.encoding_failed", f"`{name}` is not a known encoding.", path=path, encoding=name) from None
    if codec in SPARK_CHARSETS:
        return Encoding(name, codec, SPARK_CHARSETS[codec])
    page = _code_page(codec)
    if page is None:
        raise fail("source.encoding_failed", f"`{name}` is neither Unicode nor a single-byte code page.", path=path, encoding=name)
    moved = [(chr(byte), char) for byte, char in enumerate(page) if chr(byte) != char]
    return Encoding(name, codec, "ISO-8859-1", "".join(a for a, _ in moved), "".join(b for _, b in moved))


def _code_page(codec: str) -> list[str] | None:
    """The 256 characters of a single-byte, ASCII-based code page (U+FFFD where undefined)."""
    try:
        page = [bytes([byte]).decode(codec, "replace") for byte in range(256)]
        double = b"\x81\x40\xa4\xa2".decode(codec, "replace")
    except (LookupError, UnicodeError):
        return None
    single = all(len(char) == 1 for char in page) and len(double) == 4
    return page if single and page[:128] == [chr(byte) for byte in range(128)] else None
