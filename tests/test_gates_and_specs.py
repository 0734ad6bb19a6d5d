"""Gates counted on the way to a sink, diffs that move no rows, and specs named by rows."""

import pytest
from pyspark.sql import functions as F

from paywire.operators import conformance as conf
from paywire.operators import fixed, mx
from paywire.operators import iso8583 as iso
from paywire.operators.fieldspec import Definition, FieldSpec, SpecTable
from paywire.operators.gates import Gate

SPEC = conf.MaskSpec("x", (conf.Mask(11, "volatile"), conf.Mask(49, "intended-delta", b"840"), conf.Mask(60, "crypto")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def wires(spark, rows):
    """(key, legacy fields, migrated fields); None makes a wire that does not parse."""
    kind = "k long, l map<int,string>, m map<int,string>"
    table = spark.createDataFrame(rows, kind)
    fields = lambda c: F.transform(F.map_entries(c), lambda e: F.struct(e["key"].alias("number"), F.encode(e["value"], "US-ASCII").alias("value")))
    wire = lambda c: F.when(F.col(c).isNull(), F.lit(bytearray(b"?"))).otherwise(iso.build(F.lit("0210"), fields(F.coalesce(c, F.create_map().cast("map<int,string>"))), "hybrid")["wire"])
    return table.select("k", wire("l").alias("legacy"), wire("m").alias("migrated"), wire("l").alias("request"))


CAPTURES = [
    (1, {3: "000000", 11: "000001", 49: "978"}, {3: "000000", 11: "000002", 49: "840"}),
    (2, {3: "000000", 39: "00"}, {3: "000001", 39: "00", 49: "840"}),
    (3, None, {3: "000000"}),
    (4, {3: "000000"}, None),
    (5, {49: "840"}, {49: "840", 41: "TERMINAL"}),
]


@pytest.mark.parametrize("rows", [CAPTURES, CAPTURES[:1], CAPTURES[1:2], []])
def test_conformance_gate_on_the_way(spark, tmp_path, rows):
    gate = Gate(conf.gate_of)
    diffs = conf.wire_diffs(wires(spark, rows), ["k"], "request", "legacy", "migrated", SPEC)
    conf.field_rows(conf.watched(diffs, gate), ["k"]).write.parquet(f"{tmp_path}/rows")
    fields = spark.read.parquet(f"{tmp_path}/rows")
    assert gate.result() == conf.batch_gate(conf.coverage(fields, ["k"])).first().asDict()
    assert gate.row(spark).dtypes == conf.batch_gate(conf.coverage(fields, ["k"])).dtypes
    key = lambda r: r["k"]
    assert sorted(conf.capture_coverage(diffs, ["k"]).collect(), key=key) == sorted(conf.coverage(fields, ["k"]).collect(), key=key)


def test_a_gate_needs_one_scan(spark, tmp_path):
    wires(spark, CAPTURES).write.parquet(f"{tmp_path}/captures")
    captures = spark.read.parquet(f"{tmp_path}/captures")
    plan = plan_of(conf.field_rows(conf.watched(conf.wire_diffs(captures, ["k"], "request", "legacy", "migrated", SPEC), Gate(conf.gate_of)), ["k"]))
    assert plan.count("Scan parquet") == 1 and "CollectMetrics" in plan and "Exchange" not in plan
    cover = plan_of(conf.capture_coverage(conf.wire_diffs(captures, ["k"], "request", "legacy", "migrated", SPEC), ["k"]))
    assert cover.count("Scan parquet") == 1 and "Exchange" not in cover


def test_address_and_layout_gates_on_the_way(spark, tmp_path):
    address = lambda inner: f"<Envelope><AppHdr><MsgDefIdr>pacs.008.001.08</MsgDefIdr></AppHdr><Document><FIToFICstmrCdtTrf><CdtTrfTxInf><Dbtr><PstlAdr>{inner}</PstlAdr></Dbtr><Cdtr><PstlAdr><TwnNm>T</TwnNm><Ctry>DE</Ctry></PstlAdr></Cdtr></CdtTrfTxInf></FIToFICstmrCdtTrf></Document></Envelope>"
    good, bad, broken = address("<TwnNm>T</TwnNm><Ctry>DE</Ctry>"), address("<Ctry>DE</Ctry>"), "<Envelope>"
    for k, texts in enumerate(([good, bad, broken, None], [good, bad], [good], [])):
        rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k long, xml string")
        gate = Gate(mx.gate_of)
        mx.check_addresses(rows, ["k"], "xml", gate).write.parquet(f"{tmp_path}/a{k}")
        assert gate.result() == mx.address_gate(spark.read.parquet(f"{tmp_path}/a{k}"), ["k"]).first().asDict()
    layout = fixed.Layout.from_toml('[[field]]\nname = "a"\nlen = 3\n[[field]]\nname = "b"\nlen = 2\n')
    for k, frames in enumerate(([b"12345", b"1"], [b"1"], [None], [])):
        rows = spark.createDataFrame([(f,) for f in frames], "frame binary")
        gate = Gate(fixed.gate_of)
        fixed.watched(rows, "frame", layout, gate).write.parquet(f"{tmp_path}/f{k}")
        assert gate.result() == fixed.layout_gate(rows, "frame", layout).first().asDict()


def test_bucketed_views_meet_where_they_are(spark, tmp_path):
    kind = "k long, c string, number int, occurrence int, value binary"
    left = [(k, "x", n, o, f"{k}{n}{o}".encode()) for k in range(20) for n in (0, 3, 49) for o in range(1 + (k + n) % 2)]
    right = [(k, c, n, o, v if k % 5 else b"other") for k, c, n, o, v in left if (k, n) not in ((1, 3), (2, 49))] + [(99, "y", 3, 0, b"alone")]
    views = [spark.createDataFrame(x, kind) for x in (left, right)]
    want = conf.diff_views(*views, ["k", "c"], SPEC)
    tables = [conf.bucketed_view(v, ["k", "c"], f"views_{i}", 4, f"{tmp_path}/{i}") for i, v in enumerate(views)]
    got = conf.diff_views(*tables, ["k", "c"], SPEC)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan_of(conf.diff_views(*tables, ["k", "c"], SPEC))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    rows = sorted(map(str, got.collect()))
    assert rows == sorted(map(str, want.collect())) and len(rows) == 20 * 5 + 4
    reasons = {(r["k"], r["field"]): r["reason"] for r in got.collect()}
    assert reasons[1, 3] == "presence_mismatch" and reasons[99, 3] == "presence_mismatch" and reasons[99, 49] == "intended_delta_unmet" and reasons[0, 0] == "length_diff"
    for i in range(2):
        spark.sql(f"DROP TABLE views_{i}")


def test_spec_tables(spark):
    rows = [("a", True, 60, "n", 0, 3, "x"), ("a", True, 60, "n", 2, 9, "x"), ("b", False, 3, "Numeric", 0, 6, None), ("empty", False, None, None, None, None, None), ("std", None, None, None, None, None, None)]
    table = spark.createDataFrame(rows, "spec string, extends boolean, number int, type string, prefix int, size int, name string")
    specs = SpecTable.of(table)
    assert specs.specs["a"].fields[60] == Definition(60, "n", 2, 9, "x") and set(specs.specs["b"].fields) == {3}
    assert not specs.specs["empty"].fields and specs.specs["std"].fields == FieldSpec().fields
    wire = b"0200" + bytes.fromhex("2000000000000000") + b"123456"
    data = [("a", wire), ("b", wire), ("empty", wire), ("std", wire), ("none", wire), (None, wire), ("a", None), ("b", b"02")]
    got = spark.createDataFrame(data, "s string, w binary").select("s", "w", iso.sniff_by(F.col("w"), F.col("s"), specs).alias("m")).collect()
    said = [(r["s"], r["m"] and (r["m"]["error"] and r["m"]["error"]["code"])) for r in got]
    assert said == [("a", None), ("b", None), ("empty", "UnknownField"), ("std", None), ("none", "UnknownSpec"), (None, "UnknownSpec"), ("a", None), ("b", "InsufficientBytes")]
    with pytest.raises(ValueError):
        SpecTable.of(table.where("spec = 'b'").withColumn("type", F.lit("q")))
    with pytest.raises(ValueError):
        SpecTable(spark, dict.fromkeys(map(str, range(SpecTable.MOST + 1)), FieldSpec()))


def test_a_bit_taken_back(spark):
    row = spark.range(1).select(iso.bitmap_hex(iso.bitmap_without(F.array(F.lit(3), F.lit(70)), F.lit(70))).alias("one"), iso.bitmap_hex(iso.bitmap_without(F.array(F.lit(3)), F.lit(9))).alias("same")).first()
    assert row["one"] == row["same"] == "2000000000000000"
