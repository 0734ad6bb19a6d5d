"""Redaction of ISO 8583 messages: same dialect, same length, and checked by parsing again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.functions.bytesx import to_hex
from paywire.operators import iso8583

#: Our own values for the card acceptor's fields; cut or padded with blanks to the field's length.
ACCEPTOR = {41: "REDACTED", 42: "REDACTED", 43: "REDACTED"}
LOW_ANONYMITY = 10_000


def masked_pan(pan: Column) -> Column:
    """Over 10 digits the first 6 and the last 4 stay, else the first."""
    n = F.length(pan)
    return F.when(n > 10, F.concat(F.left(pan, F.lit(6)), F.repeat(F.lit("X"), n - 10), F.right(pan, F.lit(4)))).when(n > 0, F.concat(F.left(pan, F.lit(1)), F.repeat(F.lit("X"), n - 1))).otherwise(pan)


def anonymity(pan: Column) -> Column:
    """Numbers that look like this one: the check digit takes one of the masked digits."""
    hidden = F.when(F.length(pan) > 10, F.length(pan) - 10).otherwise(F.greatest(F.length(pan) - 1, F.lit(0)))
    return F.when(hidden > 0, F.pow(F.lit(10), hidden - 1).cast("long")).otherwise(F.lit(1).cast("long"))


def masked_field(number: Column, value: Column, acceptor: dict[int, str] = ACCEPTOR) -> Column:
    text = F.decode(value, "ISO-8859-1")
    n = F.length(text)
    out = F.when(number == 2, masked_pan(text)).when(number.isin(35, 45, 48), F.repeat(F.lit("X"), n)).when(number.isin(102, 103), F.repeat(F.lit("0"), n))
    for k, own in acceptor.items():
        out = out.when(number == k, F.rpad(F.lit(own), n, " "))
    return F.encode(F.coalesce(out, text), "ISO-8859-1")


def sanitize(df: DataFrame, keys: list[str], wire: str, acceptor: dict[int, str] = ACCEPTOR) -> DataFrame:
    """keys, wire, dialect, touched array<int>, anonymity, low_anonymity, error.

    anonymity is 0 where field 2 is absent or unchanged.  A binary message with
    field 2 is refused, as packed digits can't hold the mask.
    """
    parsed = df.select(*keys, F.col(wire).alias("_w"), iso8583.sniff(F.col(wire)).alias("_m"))
    m = F.col("_m")
    masked = parsed.withColumn("_f", F.transform(m["fields"], lambda f: F.struct(f["number"].alias("number"), masked_field(f["number"], f["value"], acceptor).alias("value"))))
    built = masked.withColumn("_b", iso8583.build_read(m["mti"], F.col("_f"), m["dialect"]))
    touched = F.transform(F.filter(F.arrays_zip(m["fields"].alias("old"), F.col("_f").alias("new")), lambda x: x["old"]["value"] != x["new"]["value"]), lambda x: x["old"]["number"])
    pan = iso8583.field(m, 2)
    error = (
        F.when(m.isNull(), F.lit("NoMessage"))
        .when(m["error"].isNotNull(), m["error"]["code"])
        .when((m["dialect"] == "binary") & pan.isNotNull(), F.lit("PackedAccountNumber"))
        .when(F.col("_b.error").isNotNull(), F.col("_b.error.code"))
        .when(F.octet_length("_b.wire") != F.octet_length("_w"), F.lit("LengthChanged"))
        .when(~F.col("_b.read_back"), F.lit("NotReadBack"))
    )
    out = built.select(*keys, error.alias("error"), F.col("_b.wire").alias("wire"), m["dialect"].alias("dialect"), touched.alias("touched"), F.decode(pan, "ISO-8859-1").alias("_pan"))
    ok = F.col("error").isNull()
    size = F.when(F.array_contains("touched", 2), anonymity(F.col("_pan"))).otherwise(F.lit(0).cast("long"))
    only = lambda c: F.when(ok, c)
    return out.select(*keys, only(F.col("wire")).alias("wire"), only(F.col("dialect")).alias("dialect"), only(F.col("touched")).alias("touched"), only(size).alias("anonymity"), only((F.size("touched") > 0) & (size < LOW_ANONYMITY)).alias("low_anonymity"), "error")


SANITIZE_VERSION = 1
NOTE_48 = "field 48 auto-masked as all-X, review by hand for personal data that is left"


def with_meta(sanitized: DataFrame) -> DataFrame:
    """sanitize()'s rows with wire_hex, sha256 (of the redacted bytes), byte_length, round_trip_verified, sanitize_version and notes; NULL where refused."""
    ok = F.col("error").isNull()
    only = lambda c: F.when(ok, c)
    notes = F.when(F.array_contains("touched", 48), F.lit(NOTE_48)).otherwise(F.lit(""))
    return sanitized.select(
        "*",
        only(to_hex(F.col("wire"))).alias("wire_hex"),
        only(F.sha2("wire", 256)).alias("sha256"),
        only(F.octet_length("wire")).alias("byte_length"),
        ok.alias("round_trip_verified"),
        F.lit(SANITIZE_VERSION).alias("sanitize_version"),
        only(notes).alias("notes"),
    )


def meta_toml(*also: tuple[str, Column]) -> Column:
    """The meta columns of a with_meta() row as TOML text, after pairs of a name and a text column of the caller's own."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    line = lambda name, c: F.concat(F.lit(f"{name} = "), c.cast("string"), F.lit("\n"))
    numbers = F.concat(F.lit("["), F.array_join(F.transform("touched", lambda x: x.cast("string")), ", "), F.lit("]"))
    own = [line(name, quoted(c)) for name, c in also]
    plain = [line(n, F.col(n)) for n in ("sanitize_version", "round_trip_verified", "byte_length")]
    return F.concat(*own, *plain, line("sha256_redacted", quoted(F.col("sha256"))), line("fields_redacted", numbers), line("anonymity_set_size", F.col("anonymity")), line("dialect", quoted(F.col("dialect"))), line("notes", quoted(F.col("notes"))))
