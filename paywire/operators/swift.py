"""SWIFT MT messages: blocks, text fields and the meaning of tags 20, 32A and 50K.

Matching braces is no regular language, so the block parser runs over Arrow
batches; all else is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from paywire.functions import fin

TAGGED = "array<struct<tag:string,value:string>>"
BLOCKS = f"struct<b1:string,b2:string,b3:{TAGGED},b4:{TAGGED},b5:{TAGGED},error:string>"
_TAGGED = pa.list_(pa.struct([("tag", pa.string()), ("value", pa.string())]))
_BLOCKS = pa.struct([("b1", pa.string()), ("b2", pa.string()), ("b3", _TAGGED), ("b4", _TAGGED), ("b5", _TAGGED), ("error", pa.string())])


def _parsed(texts: pa.Array) -> pa.Array:
    out = []
    named = lambda fields: fields and [{"tag": t, "value": v} for t, v in fields]
    for text in texts.to_pylist():
        if text is None:
            out.append(None)
            continue
        try:
            found = fin.parse(text)
            out.append({k: named(v) if k in ("b3", "b4", "b5") else v for k, v in found.items()})
        except fin.Bad as bad:
            out.append({"error": str(bad)})
    return pa.array(out, _BLOCKS)


def parse(text: Column) -> Column:
    """BLOCKS; error is a code, with no blocks then.  NULL text gives NULL."""
    return F.arrow_udf(_parsed, BLOCKS)(text)


def first(fields: Column, tag: str) -> Column:
    """Value of the first field with the tag, NULL where absent."""
    return F.get(F.filter(fields, lambda f: f["tag"] == tag), 0)["value"]


def build(blocks: Column) -> Column:
    """struct<wire, error> of BLOCKS: ascending blocks, block 4 with CRLF line ends."""
    listed = lambda b: F.array_join(F.transform(b, lambda f: F.concat(F.lit("{"), f["tag"], F.lit(":"), f["value"], F.lit("}"))), "")
    raw = lambda k: F.coalesce(F.concat(F.lit("{%d:" % k), blocks[f"b{k}"], F.lit("}")), F.lit(""))
    tagged = lambda k: F.coalesce(F.concat(F.lit("{%d:" % k), listed(blocks[f"b{k}"]), F.lit("}")), F.lit(""))
    lines = F.array_join(F.transform(blocks["b4"], lambda f: F.concat(F.lit(":"), f["tag"], F.lit(":"), f["value"], F.lit("\r\n"))), "")
    text = F.coalesce(F.concat(F.lit("{4:\r\n"), lines, F.lit("-}")), F.lit(""))
    any_of = lambda b, test: F.coalesce(F.exists(blocks[b], test), F.lit(False))
    error = (
        F.when(any_of("b4", lambda f: ~f["tag"].rlike("^[A-Z0-9]+$")), F.lit("InvalidTag"))
        .when(any_of("b3", lambda f: f["tag"].rlike("[:{}]|^$")) | any_of("b5", lambda f: f["tag"].rlike("[:{}]|^$")), F.lit("InvalidSubTag"))
        .when(any_of("b4", lambda f: f["value"].rlike(r"\n:")), F.lit("ValueSplitsField"))
        .when(any_of("b4", lambda f: f["value"].rlike(r"(^|\n)-(\r?\n|$)")), F.lit("ValueEndsBlock"))
        .when(any_of("b4", lambda f: f["value"].rlike("[{}]")) | F.coalesce(blocks["b1"].rlike("[{}]"), F.lit(False)) | F.coalesce(blocks["b2"].rlike("[{}]"), F.lit(False)), F.lit("BraceInValue"))
    )
    wire = F.concat(raw(1), raw(2), tagged(3), text, tagged(5))
    return F.struct(F.when(error.isNull(), wire).alias("wire"), error.alias("error"))


SEMANTIC = "struct<kind:string,reference:string,value_date:string,currency:string,amount:string,account:string,lines:array<string>,raw:string,error:string>"
#: Fixed value: the characters of the X set.
_X = r"^[A-Z0-9/\-?:().,'+ ]*$"


def _semantic(**parts: Column) -> Column:
    names = [p.split(":")[0] for p in SEMANTIC[7:-1].split(",")]
    return F.struct(*(parts.get(n, F.lit(None)).alias(n) for n in names)).cast(SEMANTIC)


def decode_20(raw: Column) -> Column:
    error = F.when(~F.octet_length(raw).between(1, 16), F.lit("InvalidLength")).when(~raw.rlike(_X), F.lit("InvalidCharset"))
    return _semantic(kind=F.lit("reference"), reference=F.when(error.isNull(), raw), error=error)


def decode_32a(raw: Column) -> Column:
    """Date YYMMDD of this century, currency, amount of at most 15 characters with one comma and a digit."""
    yy, mm, dd = (F.substring(raw, k, 2).try_cast("int") for k in (1, 3, 5))
    leap = (yy % 4 == 0).cast("int")  # 2000..2099
    days = F.when(mm == 2, 28 + leap).when(mm.isin(4, 6, 9, 11), 30).otherwise(31)
    amount = F.substring(raw, F.lit(10), F.length(raw))
    error = (
        F.when((F.octet_length(raw) < 11) | (F.octet_length(raw) != F.length(raw)), F.lit("InvalidLength"))
        .when(~raw.rlike("^[0-9]{6}") | ~mm.between(1, 12) | ~dd.between(1, days), F.lit("InvalidDate"))
        .when(~F.substring(raw, 7, 3).rlike("^[A-Z]{3}$"), F.lit("InvalidCurrency"))
        .when((F.length(amount) > 15) | ~amount.rlike("^([0-9]+,[0-9]*|,[0-9]+)$"), F.lit("InvalidAmount"))
    )
    ok = lambda c: F.when(error.isNull(), c)
    return _semantic(kind=F.lit("value_date_amount"), value_date=ok(F.substring(raw, 1, 6)), currency=ok(F.substring(raw, 7, 3)), amount=ok(amount), error=error)


def lines_of(raw: Column) -> Column:
    """Lines by CRLF, or by LF in a text without CR; blank ones at the end dropped."""
    bare = F.when(raw.contains("\r"), F.regexp_replace(raw, "(\r\n)+$", "")).otherwise(F.regexp_replace(raw, "\n+$", ""))
    return F.when(raw.contains("\r"), F.split(bare, "\r\n")).otherwise(F.split(bare, "\n"))


def decode_50k(raw: Column) -> Column:
    lines = lines_of(raw)
    account = F.coalesce(F.get(lines, 0).startswith("/"), F.lit(False))
    number = F.when(account, F.substring(F.get(lines, 0), F.lit(2), F.length(raw)))
    names = F.when(account, F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines)
    error = (
        F.when(F.regexp_replace(raw, "[\r\n]+", "") == "", F.lit("InvalidLength"))
        .when(F.octet_length(number) > 34, F.lit("InvalidLength"))
        .when(F.size(names) > 4, F.lit("InvalidLength"))
        .when(F.exists(names, lambda x: F.octet_length(x) > 35), F.lit("InvalidLength"))
        .when(F.exists(names, lambda x: ~x.rlike(_X)), F.lit("InvalidCharset"))
    )
    return _semantic(kind=F.lit("party"), account=F.when(error.isNull(), number), lines=F.when(error.isNull(), names), error=error)


DECODERS: dict[str, Callable[[Column], Column]] = {"20": decode_20, "32A": decode_32a, "50K": decode_50k}


def decode(tag: Column, raw: Column, decoders: dict[str, Callable[[Column], Column]] = DECODERS) -> Column:
    """SEMANTIC of a field; other tags are raw and never wrong.  Add to `decoders` to teach a tag."""
    out = _semantic(kind=F.lit("raw"), raw=raw)
    for name, f in decoders.items():
        out = F.when(tag == name, f(raw)).otherwise(out)
    return out
