import gc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paywire import queries
from paywire.functions import wire as rows
from paywire.operators import conformance as conf
from paywire.operators import iso8583 as iso
from paywire.operators.fieldspec import Definition, FieldSpec
from paywire.operators.gates import Gate
from paywire.plans import synth

H = lambda text: text.encode().hex()
VECTORS = [
    ("hybrid", H("0800") + "00" * 8, "0800", {}),
    ("hybrid", H("0200") + "3200000000000000" + H("000000" + "000000010000" + "1130120000"), "0200", {3: "000000", 4: "000000010000", 7: "1130120000"}),
    ("hybrid", H("0200") + "4000000000000000" + H("16" + "4111111111111111"), "0200", {2: "4111111111111111"}),
    ("hybrid", H("0200") + "0000000000010000" + H("011" + "HELLO WORLD"), "0200", {48: "HELLO WORLD"}),
    ("hybrid", H("0800") + "8000000000000000" + "0400000000000000" + H("301"), "0800", {70: "301"}),
    ("ascii", H("0800" + "8000000000000000" + "0400000000000000" + "301"), "0800", {70: "301"}),
    ("ascii", H("0200" + "4000000000000000" + "16" + "4111111111111111"), "0200", {2: "4111111111111111"}),
    ("ascii", H("0200" + "a000000000000000" + "0" * 16 + "000000"), "0200", {3: "000000"}),
    ("binary", "0200" + "4000000000000000" + "16" + "4111111111111111", "0200", {2: "4111111111111111"}),
    ("binary", "0800" + "8000000000000000" + "0400000000000000" + "0301", "0800", {70: "301"}),
]
FAULTS = [
    ("hybrid", "ffff", "InsufficientBytes"),
    ("hybrid", H("08A0") + "00" * 8, "InvalidMti"),
    ("hybrid", H("0800") + "00" * 8 + "ff", "TrailingBytes"),
    ("hybrid", H("0800") + "80" + "00" * 7, "InsufficientBytes"),
    ("hybrid", H("0200") + "4000000000000000" + H("1x"), "InvalidLengthPrefix"),
    ("hybrid", H("0200") + "4000000000000000" + H("20" + "1" * 20), "LengthExceedsMax"),
    ("hybrid", H("0200") + "2000000000000000" + H("00"), "InsufficientBytes"),
    ("ascii", H("0800" + "g" + "0" * 15), "InvalidBitmapHex"),
    ("binary", "CA00" + "00" * 8, "InvalidBcdNibble"),
    ("binary", "0200" + "4000000000000000" + "1a", "InvalidBcdNibble"),
    ("binary", "0200" + "0000000000010000" + "1011" + "00" * 11, "InvalidLengthPrefix"),
    ("binary", "0800" + "8000000000000000" + "0400000000000000" + "1301", "InvalidBcdNibble"),
]


@pytest.mark.parametrize("dialect", iso.DIALECTS)
def test_vectors_and_faults(spark, dialect):
    rows = [(h, m, f) for d, h, m, f in VECTORS if d == dialect]
    df = spark.createDataFrame([(h,) for h, _, _ in rows], "h string").select("h", iso.parse(F.unhex("h"), dialect).alias("m"))
    got = {r["h"]: r["m"] for r in df.collect()}
    for h, mti, fields in rows:
        assert got[h]["error"] is None, (h, got[h])
        assert (got[h]["mti"], {f["number"]: bytes(f["value"]).decode() for f in got[h]["fields"]}) == (mti, fields)
    bad = [(h, c) for d, h, c in FAULTS if d == dialect]
    df = spark.createDataFrame([(h,) for h, _ in bad], "h string").select("h", iso.parse(F.unhex("h"), dialect)["error"]["code"].alias("c"))
    assert {r["h"]: r["c"] for r in df.collect()} == dict(bad)


def test_sniff_and_round_trip(spark):
    df = spark.createDataFrame([(h, d) for d, h, _, _ in VECTORS] + [("abcd", None), (None, None)], "h string, d string")
    df = df.select("h", "d", F.unhex("h").alias("w"), iso.sniff(F.unhex("h")).alias("m"))
    df = iso.round_trip(iso.round_trip(df, "w").withColumnRenamed("trip", "t"), "w", True)
    got = df.select("h", "d", "m", "t", F.col("trip.ok").alias("same")).collect()
    for r in got:
        if r["h"] is None:
            assert r["m"] is None
        elif r["d"] is None:
            assert r["m"]["error"]["code"] == "InsufficientBytes" and not r["t"]["ok"]
        else:
            assert r["m"]["dialect"] == r["d"] and r["t"]["ok"] == (r["d"] == "hybrid")
            assert r["same"] == ("61" not in r["h"][8:12])  # a lower-case bitmap with an empty second half is built in its short form


def test_build(spark):
    rows = [("0200", [(4, b"000000010000"), (3, b"000000")]), ("02x0", []), ("0200", [(3, b"12")]), ("0200", [(1, b"12345678")]), ("0200", [(129, b"")]), ("0200", [(2, b"1" * 20)]), ("0200", [(2, b"12a")]), ("0800", [(70, b"301")])]
    df = spark.createDataFrame([(i, m, f) for i, (m, f) in enumerate(rows)], f"i int, m string, f {iso.FIELDS}")
    for dialect in iso.DIALECTS:
        got = [r["b"] for r in df.select("i", iso.build(F.col("m"), F.col("f"), dialect).alias("b")).orderBy("i").collect()]
        assert [b["error"] and b["error"]["code"] for b in got] == [None, "InvalidMti", "FixedLengthMismatch", "InvalidFieldNumber", "InvalidFieldNumber", "LengthExceedsMax", "InvalidBcdDigit" if dialect == "binary" else None, None]
        back = spark.createDataFrame([(bytes(got[7]["wire"]),)], "w binary").select(iso.parse(F.col("w"), dialect).alias("m")).first()["m"]
        assert back["fields"][0]["number"] == 70 and bytes(back["fields"][0]["value"]) == b"301"


def test_bitmap(spark):
    cases = {(): "0" * 16, (3,): "2" + "0" * 15, (2, 3, 4): "7" + "0" * 15, (2, 3, 4, 70): "F" + "0" * 15 + "04" + "0" * 14, tuple(range(2, 129)): "F" * 32}
    df = spark.createDataFrame([(list(k),) for k in cases], "n array<int>")
    for r in df.select("n", iso.bitmap_hex(F.col("n")).alias("h")).withColumn("back", iso.set_fields(F.col("h"))).collect():
        assert r["h"] == cases[tuple(r["n"])] and r["back"] == r["n"]


def test_specs(spark):
    closed = FieldSpec.closed("c", [Definition(3, "n", 0, 6, "p")])
    wire = H("0200") + "3000000000000000" + H("000000" + "000000010000")
    df = spark.createDataFrame([(wire,)], "h string")
    assert df.select(iso.parse(F.unhex("h"), "hybrid", closed)["error"].alias("e")).first()["e"]["code"] == "UnknownField"
    toml = 'name = "x"\n[[field]]\nnumber = 4\ntype = "Numeric"\nlength = { llvar = 12 }\nname = "Amount"\n'
    spec = FieldSpec.from_toml(toml)
    assert spec.fields[4].prefix == 2 and spec.fields[3].size == 6
    for bad in ((0, "n", 0, 1), (129, "n", 0, 1), (5, "n", 2, 100), (5, "n", 3, 1000), (5, "q", 0, 1)):
        with pytest.raises(ValueError):
            Definition(*bad, "")
    view = iso.message_view(df.select(F.lit(1).alias("k"), iso.sniff(F.unhex("h")).alias("m")), "m", ["k"]).orderBy("number").collect()
    assert [(r["number"], r["name"], r["value_text"]) for r in view] == [(0, None, "0200"), (3, "Processing Code", "000000"), (4, "Amount, Transaction", "000000010000")]
    assert df.select(iso.decode_mti(F.lit("0210")).alias("m")).first()["m"].asDict() == {"version": "ISO 8583:1987", "class": "Financial", "function": "Request response", "origin": "Acquirer"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lost_keys_are_joined_without_a_broadcast_and_parsed_once(spark, tmp_path):
    rows = spark.range(50).selectExpr("id o_orderkey", "id * 7 o_custkey", "'F' o_orderstatus", "id + 0.5d o_totalprice", "timestamp '2026-01-02 03:04:05' o_orderdate", "'1-URGENT' o_orderpriority")
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    lost = queries.QUERIES["conformance_lost_keys"](spark, str(tmp_path))
    assert "Broadcast" not in plan_of(lost) and plan_of(lost).count("parsed(") == 2
    assert sorted(map(tuple, lost.collect())) == [(0, 41), (17, 41), (34, 41)]
    damaged = rows.select("o_orderkey", iso.parse(F.when(F.col("o_orderkey") > 0, F.unhex(F.lit(VECTORS[0][1]))), "hybrid").alias("m"))
    assert iso.long_view(damaged.union(damaged.limit(0)), "m", ["o_orderkey"]).count() == 49


def test_sniffed_batches_leave_nothing_behind():
    """An exception kept in a variable of the frame that caught it held the whole batch until a full collection."""
    table = FieldSpec().by_number()
    wires = pa.array([bytes.fromhex(h) for d, h, *_ in VECTORS + FAULTS if d != "hybrid"] * 20)
    gc.collect()
    gc.disable()
    try:
        iso._messages(wires, lambda data: rows.sniff(data, table))
        assert gc.collect() == 0
    finally:
        gc.enable()


def test_values_taken_by_whole_buffers():
    values = pa.array([b"x", b"", b"abc", b"zz"])
    for a in (values, values[1:], values[1:3], values[:0], pa.array([b"", b""]), pa.array([None, b"x"]), pa.array([1, 2, 3], pa.int32())[1:], pa.array([None, 2]), values.cast(pa.large_binary())):
        assert iso._plain(a) == a.to_pylist()


def test_redaction_builds_and_reads_back_in_one_step(spark, tmp_path):
    """Each step of its own is a Python worker more beside every task."""
    rows_ = [(1, "0210", [(3, b"000000"), (4, b"000000010000")], "hybrid"), (2, "0210", [(3, b"000000")], "binary"), (3, "0210", [(3, b"00")], "hybrid"), (4, "0210", None, "ascii"), (5, "0210", [(4, b"000000010000"), (3, b"000000")], "hybrid"), (6, None, [], "hybrid")]
    df = spark.createDataFrame(rows_, "k int, mti string, f array<struct<number:int,value:binary>>, d string")
    pair = df.select("k", "f", iso.build_read(F.col("mti"), F.col("f"), F.col("d")).alias("b"), iso.build(F.col("mti"), F.col("f"), F.col("d")).alias("plain"), "d")
    pair = pair.withColumn("a", iso.parse_any_of(F.col("plain.wire"), F.col("d"))).withColumn("same", F.when(F.col("plain.wire").isNotNull(), F.col("a.error").isNull() & F.col("a.fields").eqNullSafe(F.coalesce("f", F.array()))))
    got = pair.select("k", "b", "plain", "same").collect()
    assert all((r["b"]["wire"], r["b"]["error"], r["b"]["read_back"]) == (r["plain"]["wire"], r["plain"]["error"], r["same"]) for r in got)
    assert {r["k"]: r["b"]["read_back"] for r in got} == {1: True, 2: True, 3: None, 4: True, 5: False, 6: None}
    orders = spark.range(6).selectExpr("id o_orderkey", "id * 7 o_custkey", "'F' o_orderstatus", "id + 0.5d o_totalprice", "timestamp '2026-01-02 03:04:05' o_orderdate", "'1-URGENT' o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    done = queries.QUERIES["redact_refusals"](spark, str(tmp_path))
    assert plan_of(done).count("ArrowEvalPython") == 2 and sorted(map(tuple, done.collect())) == [("PackedAccountNumber", 2), ("ok", 4)]


def test_fields_of_a_diff_are_parsed_once(spark, tmp_path):
    orders = spark.range(6).selectExpr("id o_orderkey", "id * 7 o_custkey", "'F' o_orderstatus", "id + 0.5d o_totalprice", "timestamp '2026-01-02 03:04:05' o_orderdate", "'1-URGENT' o_orderpriority")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    fields = queries.QUERIES["conformance_fields"](spark, str(tmp_path))
    assert plan_of(fields).count("ArrowEvalPython") == 1 and fields.count() == 6 * 11 + 2
    none = spark.createDataFrame([(1, []), (2, None)], f"k int, rows {conf.ROWS}")
    assert conf.field_rows(none, ["k"]).count() == 0


@pytest.fixture(scope="module")
def six_orders(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("orders"))
    orders = spark.range(1, 7).selectExpr("id o_orderkey", "id * 7 o_custkey", "'F' o_orderstatus", "id + 0.5d o_totalprice", "timestamp '2026-01-02 03:04:05' o_orderdate", "'1-URGENT' o_orderpriority")
    orders.write.parquet(f"{folder}/orders.parquet")
    return folder


def test_coverage_builds_and_reads_in_one_worker(spark, six_orders):
    found = queries.QUERIES["conformance_coverage"](spark, six_orders)
    assert plan_of(found).count("ArrowEvalPython") == 1
    assert sorted(map(tuple, found.collect())) == [(k, 8 + (k == 5), 8 + (k == 5), 100, 0) for k in range(1, 7)]


def test_gate_builds_and_reads_in_one_worker(spark, six_orders):
    found = queries.QUERIES["conformance_gate"](spark, six_orders)
    assert plan_of(found).count("ArrowEvalPython") == 1 and [tuple(r) for r in found.collect()] == [(6, 0, 0, 0)]


def test_watched_fields_are_parsed_once_in_one_worker(spark, six_orders):
    """What conformance_gate_observed writes."""
    gate = Gate(conf.gate_of)
    fields = conf.field_rows(conf.watched(conf.wire_diffs(synth.captures(spark, six_orders), ["o_orderkey"], "request", "legacy", "migrated", queries.SPEC), gate), ["o_orderkey"])
    assert plan_of(fields).count("ArrowEvalPython") == 1
    assert fields.count() == 6 * 11 + 1 and gate.result() == {"inputs": 6, "drifted": 0, "errors": 0, "gate": 0}
