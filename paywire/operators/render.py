"""Reports as text and JSON columns, and one-row validation and explanation of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.functions.bytesx import csv_field, printable, to_hex
from paywire.operators import iso8583
from paywire.operators.fieldspec import FieldSpec


#: What a valid message has not been tested for.
LIMITATIONS = ("the account number's check digit", "the characters of numeric and alphabetic fields", "whether a currency is in ISO 4217", "the integrity of codes and PIN blocks")


def validate(wire: Column, spec: FieldSpec = FieldSpec()) -> Column:
    """struct<valid, dialect, error, checks, limitations>; NULL bytes (such as from bad hex) are a result, not a failure."""
    told = [F.array(F.lit("wire_structure")).alias("checks"), F.array(*(F.lit(x) for x in LIMITATIONS)).alias("limitations")]
    m = iso8583.sniff(wire, spec)
    return F.element_at(
        F.transform(F.array(m), lambda x: F.struct((x.isNotNull() & x["error"].isNull()).alias("valid"), x["dialect"].alias("dialect"), F.when(x.isNull(), F.lit("InvalidHex")).otherwise(x["error"]["code"]).alias("error"), *told)), 1
    )


def _names(spec: FieldSpec) -> Column:
    return F.create_map(*[F.lit(x) for d in sorted(spec.fields.values(), key=lambda d: d.number) for x in (d.number, d.name)])


def explain(message: Column, spec: FieldSpec = FieldSpec()) -> Column:
    """array<string>: one line on the type, then a sentence a field."""
    names = _names(spec)
    kind = iso8583.decode_mti(message["mti"])
    head = F.format_string("%s: %s, %s, from %s (%s)", message["mti"], kind["class"], kind["function"], kind["origin"], kind["version"])
    one = lambda f: F.format_string("Field %d, %s, holds %d bytes: %s", f["number"], F.coalesce(F.element_at(names, f["number"]), F.lit("unknown")), F.octet_length(f["value"]), F.coalesce(printable(f["value"]), to_hex(f["value"])))
    return F.when(message["error"].isNull(), F.concat(F.array(head), F.transform(message["fields"], one))).otherwise(F.array(F.concat(F.lit("Not a message: "), message["error"]["code"])))


def message_json(message: Column, pretty: bool = False) -> Column:
    """mti, dialect, bitmap, and fields with hex and, where printable, text."""
    fields = F.transform(message["fields"], lambda f: F.struct(f["number"].alias("number"), F.octet_length(f["value"]).alias("length"), to_hex(f["value"]).alias("value_hex"), printable(f["value"]).alias("value_text")))
    view = F.struct(message["mti"].alias("mti"), message["dialect"].alias("dialect"), iso8583.bitmap_hex(F.transform(message["fields"], lambda f: f["number"])).alias("bitmap"), fields.alias("fields"), message["error"].alias("error"))
    return F.to_json(view, {"pretty": "true"} if pretty else {})


def message_tree(message: Column, spec: FieldSpec = FieldSpec()) -> Column:
    """A message as an indented text: type, bitmap, numbers of its fields, then a line a field with name, length and value."""
    names = _names(spec)
    numbers = F.transform(message["fields"], lambda f: f["number"])
    shown = lambda v: F.coalesce(F.concat(F.lit('"'), printable(v), F.lit('"')), F.concat(F.lit("hex:"), to_hex(v)))
    line = lambda f: F.format_string("  [%3d] %s (%d bytes): %s", f["number"], F.coalesce(F.element_at(names, f["number"]), F.lit("Unknown")), F.octet_length(f["value"]), shown(f["value"]))
    held = F.when(F.size(numbers) > 0, F.array_join(F.transform(numbers, lambda n: n.cast("string")), ", ")).otherwise(F.lit("(no fields)"))
    head = F.concat(F.lit("ISO 8583 Message\nMTI: "), message["mti"], F.lit("\nBitmap: "), iso8583.bitmap_hex(numbers), F.lit("\nFields set: "), held)
    return F.when(message["error"].isNull(), F.array_join(F.concat(F.array(head), F.transform(message["fields"], line)), "\n"))


def preview(text: Column, width: int = 60) -> Column:
    """One line: line ends shown as escapes, cut with three dots."""
    line = F.replace(F.replace(text, F.lit("\r"), F.lit("\\r")), F.lit("\n"), F.lit("\\n"))
    return F.when(F.length(line) > width, F.concat(F.left(line, F.lit(width - 3)), F.lit("..."))).otherwise(line)


def blocks_tree(blocks: Column) -> Column:
    """SWIFT blocks as an indented text."""
    tagged = lambda k: F.when(blocks[f"b{k}"].isNotNull(), F.concat(F.lit(f"block {k}"), F.array_join(F.transform(blocks[f"b{k}"], lambda f: F.concat(F.lit("\n  "), f["tag"], F.lit(": "), preview(f["value"]))), "")))
    plain = lambda k: F.concat(F.lit(f"block {k}: "), preview(blocks[f"b{k}"]))
    return F.concat_ws("\n", plain(1), plain(2), tagged(3), tagged(4), tagged(5))


def csv_line(*values: Column) -> Column:
    """An RFC 4180 line without its end; NULL is empty."""
    return F.concat_ws(",", *(csv_field(F.coalesce(v.cast("string"), F.lit(""))) for v in values))


def conformance_report(diff: DataFrame, keys: list[str]) -> DataFrame:
    """keys, report: a head with coverage and gate, then a line a field in order."""
    names = _names(FieldSpec())
    label = F.when(F.col("field") == 0, F.lit("MTI")).otherwise(F.coalesce(F.element_at(names, F.col("field")), F.lit("Unknown")))
    line = F.format_string("%4d  %-40s %-15s %s%s", F.col("field"), label, F.col("mask"), F.col("verdict"), F.coalesce(F.concat(F.lit(" ("), F.col("reason"), F.lit(")")), F.lit("")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", line.alias("line")))), lambda x: x["line"]), "\n")
    checked = F.count_if(F.col("counted") & F.col("verdict").isin("equal", "intended-delta"))
    gate = F.max(F.when(F.col("verdict") == "error", 2).when(F.col("verdict") == "UNEXPLAINED", 1).otherwise(0))
    head = F.format_string("coverage %d of %d, gate %d\n", checked, F.count_if("counted"), gate)
    return diff.groupBy(*keys).agg(F.concat(head, body).alias("report"))
