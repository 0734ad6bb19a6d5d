import datetime as dt
import json

from pyspark.sql import functions as F

from paywire.operators import conformance as conf
from paywire.operators import iso8583 as iso
from paywire.operators import render, swift
from paywire.plans import synth
from paywire.streaming import captures

WIRE = bytes.fromhex("30323030" + "3000000000000000") + b"000000" + b"000000010000"


def test_validate_explain_json(spark):
    df = spark.createDataFrame([(1, WIRE), (2, b"??"), (3, None)], "k int, w binary")
    got = {r["k"]: r for r in df.select("k", render.validate(F.col("w")).alias("v"), iso.sniff(F.col("w")).alias("m")).select("k", "v", render.explain(F.col("m")).alias("x"), render.message_json(F.col("m")).alias("j")).collect()}
    assert [(got[k]["v"]["valid"], got[k]["v"]["error"]) for k in (1, 2, 3)] == [(True, None), (False, "InsufficientBytes"), (False, "InvalidHex")]
    assert got[1]["x"] == ["0200: Financial, Request, from Acquirer (ISO 8583:1987)", "Field 3, Processing Code, holds 6 bytes: 000000", "Field 4, Amount, Transaction, holds 12 bytes: 000000010000"]
    assert json.loads(got[1]["j"])["bitmap"] == "3000000000000000" and "InsufficientBytes" in got[2]["x"][0]


def test_text_reports(spark):
    blocks = spark.createDataFrame([("{1:A}{4:\r\n:20:R\r\nS\r\n-}",)], "t string").select(swift.parse(F.col("t")).alias("b"))
    assert blocks.select(render.blocks_tree(F.col("b")).alias("t")).first()["t"] == "block 1: A\nblock 4\n  20: R\\r\\nS"
    row = spark.range(1).select(render.csv_line(F.lit('a"b'), F.lit(None), F.lit(3)).alias("c"), render.preview(F.lit("x" * 70)).alias("p")).first()
    assert row["c"] == '"a""b",,3' and row["p"] == "x" * 57 + "..."
    df = spark.createDataFrame([(1, WIRE, WIRE, WIRE[:-1] + b"1")], "k int, q binary, l binary, m binary")
    text = render.conformance_report(conf.check_wires(df, ["k"], "q", "l", "m", conf.MaskSpec()), ["k"]).first()["report"].split("\n")
    assert text[0] == "coverage 2 of 3, gate 1" and text[1].split()[:2] == ["0", "MTI"] and text[3].endswith("UNEXPLAINED (value_diff)")


def test_stream(spark, tmp_path):
    rows = synth.captures(spark, "/root/testdata/sf0.001").limit(60).withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("o_orderkey") % 3600))
    rows.write.parquet(str(tmp_path / "in"))
    spec, keys = conf.MaskSpec("s", (conf.Mask(7, "volatile"), conf.Mask(11, "volatile"))), ["o_orderkey", "at"]
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    gate = captures.window_gate(captures.stream_diff(stream, keys, spec), "at")
    q = gate.writeStream.outputMode("complete").format("memory").queryName("gates").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        got = {r["start"]: (r["fields"], r["drifted"], r["errors"], r["gate"]) for r in spark.table("gates").collect()}
    finally:
        q.stop()
    batch = captures.window_gate(captures.stream_diff(spark.read.parquet(str(tmp_path / "in")), keys, spec), "at")
    assert got == {r["start"]: (r["fields"], r["drifted"], r["errors"], r["gate"]) for r in batch.collect()} and all(isinstance(k, dt.datetime) for k in got)
