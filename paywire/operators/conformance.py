"""Masked conformance diff of a legacy and a migrated response.

A mask names how a field is judged: stable (equal over its full length), volatile and
crypto (not compared), intended-delta (the migrated value must be the expected one).
Where both responses stand in one row nothing shuffles; general long views of any
message kind meet in one full outer join.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.operators import iso8583
from paywire.operators.gates import Gate

MASKS = ("stable", "volatile", "crypto", "intended-delta")
DRIFT = "UNEXPLAINED"
VERDICT = "struct<verdict:string,reason:string>"


@dataclass(frozen=True)
class Mask:
    field: int
    mask: str
    expect: bytes | None = None

    def __post_init__(self) -> None:
        if self.mask not in MASKS:
            raise ValueError(f"unknown mask {self.mask}")
        if (self.mask == "intended-delta") != (self.expect is not None):
            raise ValueError(f"field {self.field}: an expected value goes with intended-delta only")


@dataclass(frozen=True)
class MaskSpec:
    """Of two masks for one field the first counts; other fields have `default`."""

    interface: str = ""
    masks: tuple[Mask, ...] = ()
    default: str = "stable"

    def __post_init__(self) -> None:
        if self.default not in MASKS[:3]:
            raise ValueError("the default mask must be stable, volatile or crypto")

    @classmethod
    def from_toml(cls, text: str) -> MaskSpec:
        """interface, default_mask, [[mask]] field, mask, expect (text) or expect_hex."""
        raw = tomllib.loads(text)
        masks = []
        for m in raw.get("mask", []):
            if "expect" in m and "expect_hex" in m:
                raise ValueError(f"field {m['field']}: expect and expect_hex")
            expect = m["expect"].encode() if "expect" in m else bytes.fromhex(m["expect_hex"]) if "expect_hex" in m else None
            masks.append(Mask(m["field"], m["mask"], expect))
        return cls(raw.get("interface", ""), tuple(masks), raw.get("default_mask", "stable"))

    def first(self) -> dict[int, Mask]:
        found: dict[int, Mask] = {}
        for m in self.masks:
            found.setdefault(m.field, m)
        return found

    def mask_of(self, field: Column) -> Column:
        out = F.lit(self.default)
        for m in self.first().values():
            out = F.when(field == m.field, F.lit(m.mask)).otherwise(out)
        return out

    def expect_of(self, field: Column) -> Column:
        out = F.lit(None).cast("binary")
        for m in self.first().values():
            if m.expect is not None:
                out = F.when(field == m.field, F.lit(bytearray(m.expect))).otherwise(out)
        return out


def classify(legacy: Column, migrated: Column, mask: Column, expect: Column) -> Column:
    """VERDICT of a field from its occurrences on either side (arrays of bytes, empty where absent)."""
    said = lambda verdict, reason=None: F.struct(F.lit(verdict).alias("verdict"), F.lit(reason).cast("string").alias("reason")).cast(VERDICT)
    drift = lambda reason: said(DRIFT, reason)
    met = lambda value: F.when(value.eqNullSafe(expect) & expect.isNotNull(), said("intended-delta")).otherwise(drift("intended_delta_unmet"))
    n_l, n_m = F.size(legacy), F.size(migrated)

    def single(a: Column, b: Column) -> Column:
        stable = F.when(a == b, said("equal")).when(F.octet_length(a) != F.octet_length(b), drift("length_diff")).otherwise(drift("value_diff"))
        return F.when(mask == "stable", stable).otherwise(met(b))

    each = F.zip_with(legacy, migrated, single)
    worst = F.coalesce(F.get(F.filter(each, lambda v: v["verdict"] == DRIFT), 0), F.get(each, 0))
    return (
        F.when(mask == "volatile", said("volatile-normalized"))
        .when(mask == "crypto", said("crypto-excluded"))
        .when((n_l == 0) & (n_m == 0), F.when(mask == "stable", said("equal")).otherwise(drift("intended_delta_unmet")))
        .when((n_l == 0) | (n_m == 0), F.when(mask == "stable", drift("presence_mismatch")).otherwise(met(F.get(migrated, 0))))
        .when(n_l != n_m, drift("occurrence_count_diff"))
        .otherwise(worst)
    )


ROWS = f"array<struct<field:int,mask:string,v:{VERDICT},counted:boolean>>"


def _in_arrays(ready: DataFrame, keys: list[str], spec: MaskSpec) -> DataFrame:
    """keys, rows (ROWS): a row a capture.  ready: keys, _bad, and _l and _m as arrays of (number, value) with a field's occurrences in order."""
    number = lambda side: F.transform(F.col(side), lambda f: f["number"])
    named = F.array(*(F.lit(m) for m in spec.first())).cast("array<int>")
    every = F.array_sort(F.array_union(F.array_union(number("_l"), number("_m")), named))
    values = lambda side, k: F.transform(F.filter(F.col(side), lambda f: f["number"] == k), lambda f: f["value"])
    found = F.transform(every, lambda k: F.struct(k.alias("field"), values("_l", k).alias("l"), values("_m", k).alias("m"), spec.mask_of(k).alias("mask")))
    judged = lambda x: F.struct(x["field"].alias("field"), x["mask"].alias("mask"), classify(x["l"], x["m"], x["mask"], spec.expect_of(x["field"])).alias("v"), (x["mask"].isin("stable", "intended-delta") & (F.size(x["l"]) > 0)).alias("counted"))
    error = F.array(F.struct(F.lit(None).cast("int").alias("field"), F.lit(None).cast("string").alias("mask"), F.struct(F.lit("error").alias("verdict"), F.lit(None).cast("string").alias("reason")).alias("v"), F.lit(False).alias("counted")))
    return ready.select(*keys, F.when(F.col("_bad"), error.cast(ROWS)).otherwise(F.transform(found, judged).cast(ROWS)).alias("rows"))


def message_diffs(df: DataFrame, keys: list[str], legacy: str, migrated: str, spec: MaskSpec, request: str | None = None) -> DataFrame:
    """keys, rows (ROWS): a row a capture; legacy and migrated are iso8583.MESSAGE columns.

    A capture whose messages don't all parse has one entry with field NULL and the verdict `error`.
    """
    sides = [F.col(legacy), F.col(migrated), *([F.col(request)] if request else [])]
    bad = F.lit(False)
    for s in sides:
        bad = bad | s.isNull() | s["error"].isNotNull()
    with_type = lambda m: F.concat(F.array(F.struct(F.lit(0).alias("number"), F.encode(m["mti"], "US-ASCII").alias("value"))), m["fields"])
    ready = df.select(*keys, bad.alias("_bad"), with_type(sides[0]).alias("_l"), with_type(sides[1]).alias("_m"))
    return _in_arrays(ready, keys, spec)


def view_diffs(legacy: DataFrame, migrated: DataFrame, keys: list[str], spec: MaskSpec) -> DataFrame:
    """As message_diffs, for long views: keys, number, occurrence, value.

    Each side's fields are gathered by capture (a message bounds them), then the sides meet in a full outer join on the
    capture alone.  Views that `bucketed_view` wrote stand together by capture already, so neither step moves a row.
    """

    def gathered(view: DataFrame, name: str) -> DataFrame:
        found = view.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", "occurrence", "value"))).alias(name))
        return found.withColumn(name, F.transform(name, lambda x: F.struct(x["number"].cast("int").alias("number"), x["value"].alias("value"))))

    both = gathered(legacy, "_l").join(gathered(migrated, "_m"), keys, "full_outer")
    empty = F.array().cast("array<struct<number:int,value:binary>>")
    return _in_arrays(both.select(*keys, F.lit(False).alias("_bad"), F.coalesce("_l", empty).alias("_l"), F.coalesce("_m", empty).alias("_m")), keys, spec)


def bucketed_view(view: DataFrame, keys: list[str], table: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a long view as a table in buckets of its capture key; both sides with the same number of buckets meet without a shuffle."""
    spark = view.sparkSession
    writer = view.repartition(buckets, *keys).write.format("parquet").mode("overwrite")
    (writer.option("path", path) if path else writer).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(table)
    return spark.table(table)


def field_rows(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, mask, verdict, reason, counted: one row a field.

    A plain explode would have Spark look for empty arrays first, below the parsers, which would then all run twice.
    """
    flat = diffs.select(*keys, F.explode_outer("rows").alias("_r")).where("_r is not null")
    return flat.select(*keys, F.col("_r.field").alias("field"), F.col("_r.mask").alias("mask"), F.col("_r.v.verdict").alias("verdict"), F.col("_r.v.reason").alias("reason"), F.col("_r.counted").alias("counted"))


def diff_messages(df: DataFrame, keys: list[str], legacy: str, migrated: str, spec: MaskSpec, request: str | None = None) -> DataFrame:
    """field_rows of message_diffs."""
    return field_rows(message_diffs(df, keys, legacy, migrated, spec, request), keys)


def diff_views(legacy: DataFrame, migrated: DataFrame, keys: list[str], spec: MaskSpec) -> DataFrame:
    """field_rows of view_diffs."""
    return field_rows(view_diffs(legacy, migrated, keys, spec), keys)


def _tally(rows: Column) -> dict[str, Column]:
    """checked, total, drift and errors of a capture, from its ROWS."""
    n = lambda f: F.size(F.filter(rows, f)).cast("long")
    return {
        "checked": n(lambda r: r["counted"] & r["v"]["verdict"].isin("equal", "intended-delta")),
        "total": n(lambda r: r["counted"]),
        "drift": n(lambda r: r["v"]["verdict"] == DRIFT),
        "errors": n(lambda r: r["v"]["verdict"] == "error"),
    }


def _graded(found: DataFrame, keys: list[str]) -> DataFrame:
    percent = F.when(F.col("total") > 0, F.floor(100 * F.col("checked") / F.col("total"))).otherwise(F.lit(0)).cast("int")
    return found.select(*keys, "checked", "total", percent.alias("percent"), F.when(F.col("errors") > 0, 2).when(F.col("drift") > 0, 1).otherwise(0).alias("gate"))


def capture_coverage(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """What `coverage` gives, from one row a capture: nothing moves."""
    return _graded(diffs.select(*keys, *(c.alias(k) for k, c in _tally(F.col("rows")).items())), keys)


def coverage(diff: DataFrame, keys: list[str]) -> DataFrame:
    """keys, checked, total, percent, gate: gate 2 for errors, 1 for drift, else 0; whole percents, 0 of 0 is 0."""
    checked = F.count_if(F.col("counted") & F.col("verdict").isin("equal", "intended-delta"))
    found = diff.groupBy(*keys).agg(checked.alias("checked"), F.count_if("counted").alias("total"), F.count_if(F.col("verdict") == DRIFT).alias("drift"), F.count_if(F.col("verdict") == "error").alias("errors"))
    return _graded(found, keys)


def batch_gate(report: DataFrame) -> DataFrame:
    """One row for all captures: inputs, drifted, errors, gate."""
    return report.agg(F.count("*").alias("inputs"), F.count_if(F.col("gate") == 1).alias("drifted"), F.count_if(F.col("gate") == 2).alias("errors"), F.coalesce(F.max("gate"), F.lit(0)).alias("gate"))


def wire_diffs(df: DataFrame, keys: list[str], request: str, legacy: str, migrated: str, spec: MaskSpec) -> DataFrame:
    """message_diffs over wire bytes: any dialect on either side, the request only has to parse."""
    parsed = df.select(*keys, *(iso8583.sniff(F.col(c)).alias(f"_{c}") for c in (request, legacy, migrated)))
    return message_diffs(parsed, keys, f"_{legacy}", f"_{migrated}", spec, f"_{request}")


def check_wires(df: DataFrame, keys: list[str], request: str, legacy: str, migrated: str, spec: MaskSpec) -> DataFrame:
    """field_rows of wire_diffs."""
    return field_rows(wire_diffs(df, keys, request, legacy, migrated, spec), keys)


def watched(diffs: DataFrame, gate: Gate) -> DataFrame:
    """The captures as they are, counted on their way; gate.result() has inputs, drifted, errors and gate, as `batch_gate`, once they are written."""
    t = _tally(F.col("rows"))
    bad = t["errors"] > 0
    return gate.watch(diffs, inputs=F.count(F.lit(1)), drifted=F.count_if(~bad & (t["drift"] > 0)), errors=F.count_if(bad))


def gate_of(counts: dict[str, int]) -> int:
    return 2 if counts["errors"] else 1 if counts["drifted"] else 0
