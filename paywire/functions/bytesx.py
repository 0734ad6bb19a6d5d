"""Byte-level column functions: hex, packed decimal, printable text, dumps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_hex(text: Column) -> Column:
    """Bytes of a hex text, white space ignored; NULL for odd length or another character."""
    bare = F.regexp_replace(text, r"\s+", "")
    return F.when(bare.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(bare))


def to_hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def bcd_encode(digits: Column, n_bytes: int) -> Column:
    """Right-justified packed decimal; NULL for a non-digit or too many digits."""
    fits = digits.rlike("^[0-9]*$") & (F.length(digits) <= 2 * n_bytes)
    return F.when(fits, F.unhex(F.lpad(digits, 2 * n_bytes, "0")))


def bcd_decode(data: Column, n_digits: int) -> Column:
    """The last n_digits digits; NULL for a nibble over 9, a non-zero pad or another length."""
    h = F.hex(data)
    ok = h.rlike("^[0-9]*$") & (F.length(h) == n_digits + n_digits % 2)
    if n_digits % 2:
        ok &= h.startswith("0")
    return F.when(ok, F.right(h, F.lit(n_digits)))


def printable(data: Column) -> Column:
    """The text if all bytes are printable ASCII, else NULL."""
    return F.when(F.hex(data).rlike("^([2-6][0-9A-F]|7[0-9A-E])*$"), F.decode(data, "US-ASCII"))


def csv_field(text: Column) -> Column:
    """RFC 4180 quoting."""
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def squeeze(text: Column) -> Column:
    """Runs of Unicode white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def hexdump(data: Column, cap: int = 4096) -> Column:
    """Rows of 16 bytes in two halves with an ASCII gutter; a last line tells what is over `cap`."""
    shown = F.substring(data, 1, cap)
    n = F.octet_length(shown)
    width = 32 * F.ceil(n / 16).cast("int")
    # Each of these goes over the whole value once: 16 pairs of digits (or of blanks, at the end) a line, and 16 characters of the gutter.
    eight = lambda k: " ".join(f"${i}" for i in range(k, k + 8))
    bodies = F.split(F.regexp_replace(F.rpad(F.lower(F.hex(shown)), width, " "), F.lit("(..)" * 16), F.lit(f"{eight(1)}  {eight(9)}\n")), "\n")
    gutters = F.regexp_extract_all(F.regexp_replace(F.decode(shown, "ISO-8859-1"), "[^ -~]", "."), F.lit(".{1,16}"), F.lit(0))
    joined = lambda g: F.array_join(
        F.transform(F.slice(bodies, 1, F.size(g)), lambda body, i: F.concat(F.lpad(F.lower(F.hex(16 * i)), 8, "0"), F.lit("  "), body, F.lit("  |"), F.get(g, i), F.lit("|"))), "\n"
    )
    rows = F.element_at(F.transform(F.array(gutters), joined), 1)  # bound: an expression would be made again for each line
    more = F.octet_length(data) - n
    tail = F.when(more > 0, F.concat(F.lit("\n... "), more.cast("string"), F.lit(" more bytes"))).otherwise(F.lit(""))
    return F.when(n == 0, F.lit("")).otherwise(F.concat(rows, tail))
