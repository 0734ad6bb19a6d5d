"""Encodings, digests, ciphers, frames, traces and logs."""

import hashlib
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paywire import queries
from paywire.functions import bytesx, ebcdic, sm
from paywire.operators import conformance as conf
from paywire.operators import fixed
from paywire.sources import files, log


def test_hex_bcd_and_text(spark):
    rows = [("30 3\n1", b"01", True), ("abc", None, None), ("zz", None, None), ("", b"", True)]
    df = spark.createDataFrame([(i, h) for i, (h, *_) in enumerate(rows)], "i int, h string").select("i", bytesx.from_hex(F.col("h")).alias("b")).orderBy("i")
    assert [r["b"] if r["b"] is None else bytes(r["b"]) for r in df.collect()] == [b for _, b, _ in rows]
    one = spark.range(1)
    bcd = one.select(*(bytesx.to_hex(bytesx.bcd_encode(F.lit(d), n)).alias(f"e{k}") for k, (d, n) in enumerate([("0800", 2), ("100", 2), ("9", 1), ("1a", 1), ("123", 1)]))).first()
    assert list(bcd) == ["0800", "0100", "09", None, None]
    back = one.select(*(bytesx.bcd_decode(F.unhex(F.lit(h)), n).alias(f"d{k}") for k, (h, n) in enumerate([("0800", 4), ("0100", 3), ("1100", 3), ("A0", 2), ("0F", 2)]))).first()
    assert list(back) == ["0800", "100", None, None, None]
    text = one.select(bytesx.printable(F.lit(bytearray(b"a~"))).alias("p"), bytesx.printable(F.lit(bytearray(b"\x7f"))).alias("q"), bytesx.csv_field(F.lit('a"b')).alias("c"), bytesx.hexdump(F.lit(bytearray(b"A" * 16 + b"\n"))).alias("h"), bytesx.hexdump(F.lit(bytearray(b""))).alias("e"), bytesx.hexdump(F.lit(bytearray(b"x" * 20)), 16).alias("m")).first()
    assert (text["p"], text["q"], text["c"], text["e"]) == ("a~", None, '"a""b"', "")
    assert text["h"].split("\n")[1].startswith("00000010  0a") and text["h"].endswith("|.|") and text["m"].endswith("... 4 more bytes")


@pytest.mark.parametrize("page", ["cp037", "cp500"])
def test_ebcdic_tables(spark, page):
    every = bytes(range(256))
    row = spark.createDataFrame([(every, "é1", "a\U0001f600b")], "b binary, t string, bad string").select(ebcdic.decode(F.col("b"), page).alias("d"), ebcdic.encode(F.col("t"), page)["data"].alias("e"), ebcdic.encode(F.col("bad"), page).alias("x"), ebcdic.encode(ebcdic.decode(F.col("b"), page), page)["data"].alias("back")).first()
    assert row["d"] == every.decode(page) and bytes(row["e"]) == "é1".encode(page) and bytes(row["back"]) == every
    assert row["x"]["data"] is None and (row["x"]["bad"], row["x"]["position"]) == ("\U0001f600", 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=200))
def test_sm_properties(data):
    assert sm.sm3_plain(data) == hashlib.new("sm3", data).digest() if "sm3" in hashlib.algorithms_available else True
    key, iv = bytes(range(16)), bytes(range(16, 32))
    for v in (None, iv):
        sealed = sm.sm4_encrypt(data, key, v)
        assert len(sealed) == len(data) // 16 * 16 + 16 and sm.sm4_decrypt(sealed, key, v) == data


def test_sm_vectors(spark):
    assert sm.sm3_plain(b"abc").hex() == "66c7f0f462eeedd9d1f2d46bdc10e4e24167c4875cf2f7a2297da02b8f4ba8e0"
    assert sm.sm3_plain(b"abcd" * 16).hex() == "debe9ff92275b8a138604889c18e5a4d6fdb70e5387e5765293dcba39c0c5732"
    block = bytes.fromhex("0123456789abcdeffedcba9876543210")
    assert sm.sm4_block(block, sm.sm4_keys(block)).hex() == "681edf34d206965e86b3e94f536e4246" and sorted(sm.sm4_box()) == list(range(256))
    for bad, why in ((b"x" * 15, "unaligned"), (sm.sm4_block(bytes(16), sm.sm4_keys(block)), "bad padding")):
        with pytest.raises(ValueError, match=why):
            sm.sm4_decrypt(bad, block)
    df = spark.createDataFrame([(b"abc",), (None,)], "b binary").select(bytesx.to_hex(sm.sm3(F.col("b"))).alias("d"), sm.sm4(F.col("b"), block, decrypt=True)["error"].alias("e")).collect()
    assert {(r["d"] or "")[:8] for r in df} == {"66c7f0f4", ""} and {r["e"] for r in df} == {"unaligned", None}


def test_layouts(spark):
    layout = fixed.Layout.from_toml('name = "l"\n[[field]]\nname = "a"\nlen = 4\n[[field]]\nname = "b"\nrest = true\n')
    df = spark.createDataFrame([(1, b"abcdef"), (2, b"abcd"), (3, b"abc")], "k int, f binary")
    got = {r["k"]: r["t"] and [bytes(x["value"]) for x in r["t"]] for r in df.select("k", layout.tiles(F.col("f")).alias("t")).collect()}
    assert got == {1: [b"abcd", b"ef"], 2: [b"abcd", b""], 3: None}
    for bad in ((), (("a", 0),), (("a", None), ("b", 1))):
        with pytest.raises(ValueError):
            fixed.Layout("x", bad)
    assert fixed.layout_gate(df.limit(0), "f", layout).first()["gate"] == 2 and fixed.layout_gate(df.where("k = 3"), "f", layout).first()["gate"] == 1
    view = fixed.long_view(df, "f", ["k"], layout).drop("name")
    other = fixed.long_view(df.withColumn("f", F.when(F.col("k") == 1, F.lit(bytearray(b"abcdeX"))).otherwise(F.col("f"))), "f", ["k"], layout).drop("name")
    diff = {(r["k"], r["field"]): (r["verdict"], r["reason"]) for r in conf.diff_views(view, other, ["k"], conf.MaskSpec("", (conf.Mask(9, "crypto"),))).collect()}
    assert diff == {(1, 0): ("equal", None), (1, 1): ("UNEXPLAINED", "value_diff"), (2, 0): ("equal", None), (2, 1): ("equal", None), (1, 9): ("crypto-excluded", None), (2, 9): ("crypto-excluded", None)}


def test_traces(spark):
    body = lambda n: "".join(" ".join(f"{(i + j) % 256:02x}" for j in range(min(16, n - i))) + "  ab cd gutter\n" for i in range(0, n, 16))
    text = "noise\n[buffer dump: in length=12]\n\n" + body(12) + "[buffer dump: in length=20]\n" + body(20) + "[buffer dump end]\n"
    assert [len(f) for f in files.frames_of(text)[0]] == [12, 20] and files.frames_of(text)[1] == 0
    assert files.frames_of("[buffer dump: length=4]\n00 01\n") == ([], 1)
    assert files.frames_of("[buffer dump: length=0]\n00\n[buffer dump: none]\n00") == ([], 0)
    assert files.frames_of("[buffer dump: length=2]\n[buffer dump: length=1]\nff\n") == ([b"\xff"], 1)
    assert files.frames_of("[buffer dump: length=2]\n[buffer dump end]\n00 01\n") == ([], 1)
    assert files.frames_of("[buffer dump: length=1]\r\n\r\n00\r\n") == ([], 1)
    df = spark.createDataFrame([("a", text), ("b", ""), ("c", None)], "path string, content string")
    assert sorted((r["path"], r["seq"]) for r in files.explode_traces(df).collect() if r["frame"]) == [("a", 0), ("a", 1)]
    assert files.explode_traces(df).count() == 4


def test_logs(spark, tmp_path):
    def made(*payloads):
        return log.MAGIC + b"".join(log.HEADER.pack(len(p), zlib.crc32(p)) + p for p in payloads)

    good = made(b"one", b"", b"three")
    cases = {"clean": (good, None), "empty": (log.MAGIC, None), "garbage": (good + b"xyz", "TruncatedHeader"), "short": (good + log.HEADER.pack(100, 0) + b"12345", "TruncatedPayload"), "flip": (good[:-1] + b"X", "Checksum"), "huge": (good + log.HEADER.pack(1 << 30, 0), "HeaderPayloadTooLarge"), "magic": (b"nope", "BadMagic")}
    for name, (data, _) in cases.items():
        (tmp_path / name).write_bytes(data)
    rows = log.read_log(spark, str(tmp_path)).collect()
    for name, (_, kind) in cases.items():
        own = [r for r in rows if r["path"].endswith("/" + name)]
        assert [r["tail"]["kind"] for r in own if r["tail"]] == ([kind] if kind else [])
        want = {"empty": [], "magic": [], "flip": [b"one", b""]}.get(name, [b"one", b"", b"three"])
        assert [bytes(r["payload"]) for r in sorted(own, key=lambda r: r["offset"]) if r["payload"] is not None] == want
    df = spark.createDataFrame([(1, 0, b"one"), (1, 1, b""), (1, 2, b"three")], "f int, o int, p binary")
    assert bytes(log.log_files(df, "f", "o", "p").first()["content"]) == good


def test_dumps_of_whole_texts(spark, tmp_path):
    texts = ["", "Customer#000000001", "eight by", " a\t\u00a0b\n", "\u20ac" * 6, "x y\n" * 2500, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def dump(data):
        lines = []
        for at in range(0, len(data), 16):
            part = data[at : at + 16]
            lines.append(f"{at:08x}  {part[:8].hex(' '):23}  {part[8:].hex(' '):23}  |{''.join(chr(b) if 32 <= b < 127 else '.' for b in part)}|")
        return "\n".join(lines)

    got = {r["doc_id"]: (r["dump"], r["squeezed"]) for r in queries.QUERIES["hexdump_texts"](spark, str(tmp_path)).collect()}
    assert got == {i: (None, None) if t is None else (dump(t.encode()), " ".join(t.split())) for i, t in enumerate(texts)}


def test_a_long_dump_takes_no_longer_than_its_bytes_in_many(spark):
    """Each line once encoded its whole text again: the time grew with the square of a text."""

    def took(rows: int, words: int) -> float:
        texts = spark.range(rows).select(F.repeat(F.lit("word \u00e9\n\x7f|"), words).alias("t")).repartition(1).cache()
        texts.count()
        began = time.perf_counter()
        n = texts.select(F.sum(F.length(bytesx.hexdump(F.encode("t", "UTF-8"), 2**31 - 1)))).first()[0]
        assert n == rows * (79 * (10 * words // 16) - 1)
        return time.perf_counter() - began

    took(64, 160)
    assert took(1, 160 * 320) < 4 * took(320, 160) + 1


def test_logs_stay_of_one_size(spark):
    rows = [("big", i, bytes([i % 256]) * 92) for i in range(2000)] + [("small", 7, b"x")]
    made = log.log_files(spark.createDataFrame(rows, "f string, o int, p binary"), "f", "o", "p", segment_bytes=10_000)
    logs = made.collect()
    assert max(len(r["content"]) for r in logs) < 20_000 and len(logs) > 15
    assert sorted(r["path"] for r in logs if r["latest"]) == ["big", "small"]
    got = []
    for r in logs:
        own = list(log.records(bytes(r["content"])))
        assert all(tail is None for _, _, tail in own)
        got += [(r["path"], p) for _, p, _ in own]
        if r["latest"]:
            assert own[-1][1] == {"big": rows[1999][2], "small": b"x"}[r["path"]]
    assert sorted(got) == sorted((f, p) for f, _, p in rows)


def test_trace_files_stay_of_one_size(spark, tmp_path):
    orders = spark.range(12_000).select(F.col("id").alias("o_orderkey"), F.lit(50).cast("long").alias("o_custkey"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(str(tmp_path / "orders.parquet"))
    made = queries._trace_files(spark, str(tmp_path)).selectExpr("size(split(content, 'gutter')) - 1 n").collect()
    assert sorted(r["n"] for r in made) == [2000, 5000, 5000]
    assert [tuple(r) for r in queries.trace_frames(spark, str(tmp_path)).collect()] == [(0, 12_000, 96_000, 1)]


def test_file_sources(spark, tmp_path):
    (tmp_path / "a.XML").write_text("<a/>")
    (tmp_path / "b.txt").write_text("b")
    assert [r["xml"] for r in files.xml_folder(spark, str(tmp_path)).collect()] == ["<a/>"]
    got = {r["path"]: r["content"] is not None for r in files.listed_files(spark, [str(tmp_path / "b.txt"), str(tmp_path / "none")]).collect()}
    assert list(got.values()) == [True, False]
    assert [r["label"] for r in files.labelled_batch(spark, [(None, "x"), ("l", "y")]).collect()] == ["1", "l"]
    with pytest.raises(ValueError):
        files.labelled_batch(spark, [])
    m = spark.createDataFrame([('{"mti":"0200","fields":{"3":"000000","4":"hex:3031","5":{"hex":"ff"}}}',)], "t string").select(files.json_message(F.col("t")).alias("m")).first()["m"]
    assert m["mti"] == "0200" and {f["number"]: bytes(f["value"]) for f in m["fields"]} == {3: b"000000", 4: b"01", 5: b"\xff"}
