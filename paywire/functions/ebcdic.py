"""EBCDIC text in code pages 037 and 500, as column expressions.

The tables come from the interpreter's own codecs; a byte is decoded as the
character of its number and then translated.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGES = {"037": "cp037", "cp037": "cp037", "500": "cp500", "cp500": "cp500"}


def _pairs(page: str) -> list[tuple[str, str]]:
    """(character of the byte's number, text character) where they differ; both sides hold the same 256 characters."""
    shown = bytes(range(256)).decode(PAGES[page])
    return [(chr(i), c) for i, c in enumerate(shown) if chr(i) != c]


def decode(data: Column, page: str = "cp037") -> Column:
    pairs = _pairs(page)
    return F.translate(F.decode(data, "ISO-8859-1"), "".join(a for a, _ in pairs), "".join(b for _, b in pairs))


def encode(text: Column, page: str = "cp037") -> Column:
    """struct<data binary, bad string, position int>: the first character without a code, and its place from 0."""
    pairs = _pairs(page)
    rest = F.regexp_replace(text, "(?s)[^\\x00-\\xFF].*", "")
    bad = F.length(rest) < F.length(text)
    data = F.encode(F.translate(text, "".join(b for _, b in pairs), "".join(a for a, _ in pairs)), "ISO-8859-1")
    return F.struct(
        F.when(~bad, data).alias("data"),
        F.when(bad, F.substring(text, F.length(rest) + 1, F.lit(1))).alias("bad"),
        F.when(bad, F.length(rest)).cast("int").alias("position"),
    )
