"""ISO 8583 messages in three wire dialects.

Parsing and building walk a cursor over bytes, which higher-order functions can
express but only interpret (measured at over 50 times the cost), so these two run
over Arrow batches; all that follows from a parsed message is column expressions.

hybrid: ASCII digits and lengths with a raw bitmap; ascii: the bitmap as hex
characters too; binary: packed-decimal type, lengths and numeric fields.  A parsed
message is struct<mti, dialect, fields array<struct<number, value>>, error>; a bad
message has an error and no job fails.  NULL bytes give a NULL message.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.functions import wire as rows
from paywire.functions.bytesx import printable, to_hex
from paywire.operators.fieldspec import FieldSpec, SpecTable

DIALECTS = rows.DIALECTS
ERROR = "struct<code:string,field:int,offset:int>"
FIELDS = "array<struct<number:int,value:binary>>"
MESSAGE = f"struct<mti:string,dialect:string,fields:{FIELDS},error:{ERROR}>"
_FIELD = pa.struct([("number", pa.int32()), ("value", pa.binary())])
_ERROR = pa.struct([("code", pa.string()), ("field", pa.int32()), ("offset", pa.int32())])


def _once(value: Column, use) -> Column:
    """use(value) with value evaluated once: a lambda's variable is bound, an expression may be repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


def bits_of_hex(bitmap: Column) -> Column:
    """'0' and '1' characters of a hex text of 16 or 32 digits."""
    quarter = lambda k: F.lpad(F.conv(F.substring(bitmap, 8 * k + 1, 8), 16, 2), 32, "0")
    first = F.concat(quarter(0), quarter(1))
    return F.when(F.length(bitmap) == 32, F.concat(first, quarter(2), quarter(3))).otherwise(first)


def set_fields(bitmap: Column) -> Column:
    """Ascending field numbers from 2 of a bitmap as 16 or 32 hex digits; bit 1 only tells that the second half is there."""
    bits = bits_of_hex(bitmap)
    return _once(bits, lambda b: F.filter(F.sequence(F.lit(2), F.length(b)), lambda n: F.substring(b, n, F.lit(1)) == "1"))


def bitmap_hex(numbers: Column) -> Column:
    """Upper-case hex of the bitmap of these fields: 16 digits, or 32 with bit 1 set if any is over 64."""
    wide = F.exists(numbers, lambda n: n > 64)
    bits = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(128)), lambda k: F.when((k == 1) & wide | (k > 1) & F.array_contains(numbers, k), F.lit("1")).otherwise(F.lit("0"))), "")
    quarter = lambda b, k: F.lpad(F.conv(F.substring(b, 32 * k + 1, 32), 2, 16), 8, "0")
    return _once(bits, lambda b: F.concat(quarter(b, 0), quarter(b, 1), F.when(wide, F.concat(quarter(b, 2), quarter(b, 3))).otherwise(F.lit(""))))


def bitmap_without(numbers: Column, number: Column) -> Column:
    """The set fields without one: a bit taken back."""
    return F.filter(numbers, lambda n: n != number)


def _plain(values: pa.Array) -> list:
    """values.to_pylist(), for numbers and bytes without NULLs by whole buffers: taking values one by one is half of the time of `_built`."""
    if values.null_count or not len(values) or not (pa.types.is_binary(values.type) or pa.types.is_integer(values.type)):
        return values.to_pylist()
    if pa.types.is_integer(values.type):
        return values.to_numpy().tolist()
    ends = pa.Array.from_buffers(pa.int32(), len(values) + 1, [None, values.buffers()[1]], offset=values.offset).to_numpy().tolist()
    data = values.buffers()[2].slice(ends[0], ends[-1] - ends[0]).to_pybytes() if ends[-1] > ends[0] else b""
    return [data[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:])]


def _messages(wires: pa.Array, read) -> pa.Array:
    """MESSAGE of each value by read(bytes) -> dialect, type, fields."""
    mti, dialect, errors, numbers, values, ends, null = [], [], [], [], [], [0], []
    for wire in _plain(wires):
        null.append(wire is None)
        try:
            d, m, fields = read(wire) if wire is not None else (None, None, ())
            error = None
        except rows.Bad as bad:
            d, m, fields, error = None, None, (), bad.error
        dialect.append(d)
        mti.append(m)
        errors.append(error)
        for number, value in fields:
            numbers.append(number)
            values.append(value)
        ends.append(len(numbers))
    missing = pa.array([x is None for x in mti], pa.bool_())
    flat = pa.StructArray.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], fields=list(_FIELD))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=missing)
    kinds = [("mti", pa.string()), ("dialect", pa.string()), ("fields", pa.list_(_FIELD)), ("error", _ERROR)]
    return pa.StructArray.from_arrays([pa.array(mti, pa.string()), pa.array(dialect, pa.string()), lists, pa.array(errors, _ERROR)], fields=[pa.field(*k) for k in kinds], mask=pa.array(null, pa.bool_()))


def parse(wire: Column, dialect: str, spec: FieldSpec = FieldSpec()) -> Column:
    """MESSAGE of one dialect: type, bitmap, then the fields in ascending order by a moving cursor; nothing may be left over."""
    table = spec.by_number()

    @F.arrow_udf(MESSAGE)
    def parsed(wires: pa.Array) -> pa.Array:
        return _messages(wires, lambda data: (dialect, *rows.parse(data, dialect, table)))

    return parsed(wire)


def sniff(wire: Column, spec: FieldSpec = FieldSpec()) -> Column:
    """The first dialect that takes all bytes; else the error of the first dialect.  Later ones are tried only where needed."""
    table = spec.by_number()

    @F.arrow_udf(MESSAGE)
    def sniffed(wires: pa.Array) -> pa.Array:
        return _messages(wires, lambda data: rows.sniff(data, table))

    return sniffed(wire)


def _built(mtis: pa.Array, lists: pa.Array, dialects: pa.Array, tables: list[list | None]) -> pa.Array:
    ends = _plain(lists.offsets)
    flat = lists.values
    numbers, values = _plain(flat.field("number")), _plain(flat.field("value"))
    wires, errors, missing = [], [], lists.is_null().to_pylist()
    for i, (m, d, table) in enumerate(zip(mtis.to_pylist(), dialects.to_pylist(), tables, strict=True)):
        own = slice(0, 0) if missing[i] else slice(ends[i], ends[i + 1])
        try:
            if table is None:
                raise rows.Bad("UnknownSpec")
            wires.append(rows.build(m, dict(zip(numbers[own], values[own], strict=True)), d, table))
            errors.append(None)
        except rows.Bad as bad:
            wires.append(None)
            errors.append(bad.error)
    return pa.StructArray.from_arrays([pa.array(wires, pa.binary()), pa.array(errors, _ERROR)], fields=[pa.field("wire", pa.binary()), pa.field("error", _ERROR)])


def _by_spec(ids: pa.Array, specs: dict[str, list]) -> list[list]:
    """The field table of each row's spec; None where the id is no spec's."""
    return [specs.get(k) for k in ids.to_pylist()]


def sniff_by(wire: Column, spec_id: Column, specs: SpecTable) -> Column:
    """As sniff, each row under the spec that its spec_id names; another id, or NULL, is the error UnknownSpec."""
    shared = specs.shared()

    @F.arrow_udf(MESSAGE)
    def sniffed(wires: pa.Array, ids: pa.Array) -> pa.Array:
        tables = iter(_by_spec(ids.filter(wires.is_valid()), shared.value))

        def read(data: bytes) -> tuple:
            table = next(tables)
            if table is None:
                raise rows.Bad("UnknownSpec")
            return rows.sniff(data, table)

        return _messages(wires, read)

    return sniffed(wire, spec_id)


def build_by(mti: Column, fields: Column, spec_id: Column, specs: SpecTable, dialect: str | Column = "hybrid") -> Column:
    """As build, each row under the spec that its spec_id names; another id, or NULL, is the error UnknownSpec."""
    shared = specs.shared()

    @F.arrow_udf(f"struct<wire:binary,error:{ERROR}>")
    def built(mtis: pa.Array, lists: pa.Array, dialects: pa.Array, ids: pa.Array) -> pa.Array:
        return _built(mtis, lists, dialects, _by_spec(ids, shared.value))

    return built(mti, fields.cast(FIELDS), dialect if isinstance(dialect, Column) else F.lit(dialect), spec_id)


def build(mti: Column, fields: Column, dialect: str | Column = "hybrid", spec: FieldSpec = FieldSpec()) -> Column:
    """struct<wire binary, error>: everything is checked before a byte is written.  fields: FIELDS, any order; of repeated numbers the last counts.

    NULL fields are no fields; dialect may be a column.
    """
    table = spec.by_number()

    @F.arrow_udf(f"struct<wire:binary,error:{ERROR}>")
    def built(mtis: pa.Array, lists: pa.Array, dialects: pa.Array) -> pa.Array:
        return _built(mtis, lists, dialects, [table] * len(mtis))

    return built(mti, fields.cast(FIELDS), dialect if isinstance(dialect, Column) else F.lit(dialect))


def wire(mti: Column, fields: Column, dialect: str | Column = "hybrid", spec: FieldSpec = FieldSpec()) -> Column:
    """The bytes that `build` makes, NULL where it has an error.

    Not being a field of a struct, they go on to a parser in the same Python worker where nothing else reads them.
    """
    table = spec.by_number()

    @F.arrow_udf("binary")
    def made(mtis: pa.Array, lists: pa.Array, dialects: pa.Array) -> pa.Array:
        return _built(mtis, lists, dialects, [table] * len(mtis)).field("wire")

    return made(mti, fields.cast(FIELDS), dialect if isinstance(dialect, Column) else F.lit(dialect))


def build_read(mti: Column, fields: Column, dialect: str | Column = "hybrid", spec: FieldSpec = FieldSpec()) -> Column:
    """`build` with read_back boolean: the dialect's parser takes the bytes and finds the same fields; NULL where there are no bytes."""
    table = spec.by_number()

    def same(data: bytes | None, dialect: str, fields: list[tuple[int, bytes]]) -> bool | None:
        try:
            return None if data is None else rows.parse(data, dialect, table)[1] == fields
        except rows.Bad:
            return False

    @F.arrow_udf(f"struct<wire:binary,error:{ERROR},read_back:boolean>")
    def built(mtis: pa.Array, lists: pa.Array, dialects: pa.Array) -> pa.Array:
        made = _built(mtis, lists, dialects, [table] * len(mtis))
        ends, flat = _plain(lists.offsets), lists.values
        pairs = list(zip(_plain(flat.field("number")), _plain(flat.field("value")), strict=True))
        wires = made.field("wire")
        given = [[] if null else pairs[ends[i] : ends[i + 1]] for i, null in enumerate(lists.is_null().to_pylist())]
        read = list(map(same, _plain(wires), dialects.to_pylist(), given))
        kinds = [pa.field("wire", pa.binary()), pa.field("error", _ERROR), pa.field("read_back", pa.bool_())]
        return pa.StructArray.from_arrays([wires, made.field("error"), pa.array(read, pa.bool_())], fields=kinds)

    return built(mti, fields.cast(FIELDS), dialect if isinstance(dialect, Column) else F.lit(dialect))


def field(message: Column, number: int) -> Column:
    """Value of a field, NULL where absent."""
    return F.get(F.filter(message["fields"], lambda f: f["number"] == number), 0)["value"]


def long_view(df: DataFrame, message: str, keys: list[str]) -> DataFrame:
    """keys, number, value: one row a field, the type as field 0."""
    all_fields = F.concat(F.array(F.struct(F.lit(0).alias("number"), F.encode(F.col(message)["mti"], "US-ASCII").alias("value"))), F.col(message)["fields"])
    good = F.when(F.col(message)["error"].isNull(), all_fields)  # a filter would be moved below the parser, which would then run twice
    return df.select(*keys, F.explode(good).alias("_f")).select(*keys, "_f.number", "_f.value")


def message_view(df: DataFrame, message: str, keys: list[str], spec: FieldSpec = FieldSpec()) -> DataFrame:
    """Long view with name, type, length, hex and, where printable, text of each field; the spec is a table of at most 128 rows."""
    table = spec.table(df.sparkSession)
    rows = long_view(df, message, keys).join(F.broadcast(table), "number", "left")
    return rows.select(*keys, "number", "name", "type", F.octet_length("value").alias("length"), to_hex(F.col("value")).alias("value_hex"), printable(F.col("value")).alias("value_text"))


# What each digit of the type stands for; any other digit is reserved.
VERSIONS = {"0": "ISO 8583:1987", "1": "ISO 8583:1993", "2": "ISO 8583:2003", "8": "National", "9": "Private"}
CLASSES = {"1": "Authorization", "2": "Financial", "3": "File action", "4": "Reversal", "5": "Reconciliation", "6": "Administrative", "7": "Fee collection", "8": "Network management"}
FUNCTIONS = {"0": "Request", "1": "Request response", "2": "Advice", "3": "Advice response", "4": "Notification", "8": "Response acknowledgment", "9": "Negative acknowledgment"}
ORIGINS = {"0": "Acquirer", "1": "Acquirer repeat", "2": "Issuer", "3": "Issuer repeat", "4": "Other", "5": "Other repeat"}


def decode_mti(mti: Column) -> Column:
    """struct<version, class, function, origin>; NULL unless four digits."""

    def label(names: dict[str, str], at: int) -> Column:
        digit, out = F.substring(mti, at, 1), F.lit("Reserved")
        for k, v in names.items():
            out = F.when(digit == k, F.lit(v)).otherwise(out)
        return out

    parts = F.struct(label(VERSIONS, 1).alias("version"), label(CLASSES, 2).alias("class"), label(FUNCTIONS, 3).alias("function"), label(ORIGINS, 4).alias("origin"))
    return F.when(mti.rlike("^[0-9]{4}$"), parts)


def round_trip(df: DataFrame, wire: str, same_dialect: bool = False, spec: FieldSpec = FieldSpec()) -> DataFrame:
    """df with `trip`: struct<ok, offsets array<int> (at most 8 places that differ), lengths_differ, error>.

    It parses any dialect and builds the hybrid one, so other valid dialects are
    reported as not ok; same_dialect compares like with like.
    """
    parsed = df.withColumn("_m", sniff(F.col(wire), spec))
    m = F.col("_m")
    made = build(m["mti"], m["fields"], m["dialect"] if same_dialect else "hybrid", spec)["wire"]
    both = parsed.withColumn("_made", F.when(m["error"].isNull(), made))
    a, b = F.hex(wire), F.hex("_made")
    n = F.least(F.octet_length(wire), F.octet_length("_made"))
    differ = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda i: F.substring(a, 2 * i + 1, F.lit(2)) != F.substring(b, 2 * i + 1, F.lit(2)))
    same = F.col(wire).eqNullSafe(F.col("_made")) & m["error"].isNull()
    offsets = F.when(same, F.array().cast("array<int>")).otherwise(F.slice(differ, 1, 8))
    trip = F.struct(same.alias("ok"), offsets.alias("offsets"), (F.octet_length(wire) != F.octet_length("_made")).alias("lengths_differ"), m["error"].alias("error"))
    return both.withColumn("trip", trip).drop("_m", "_made")


def parse_any_of(wire: Column, dialect: Column, spec: FieldSpec = FieldSpec()) -> Column:
    """parse() where each row names its dialect; NULL for a NULL in either."""
    table = spec.by_number()

    def parsed(wires: pa.Array, dialects: pa.Array) -> pa.Array:
        named = iter(dialects.to_pylist())
        pairs = [(w, d) for w, d in zip(wires.to_pylist(), named, strict=True)]
        order = iter([d for w, d in pairs if w is not None and d is not None])
        known = pa.array([w if d is not None else None for w, d in pairs], pa.binary())

        def read(data: bytes) -> tuple:
            d = next(order)
            return d, *rows.parse(data, d, table)

        return _messages(known, read)

    return F.arrow_udf(parsed, MESSAGE)(wire, dialect)
