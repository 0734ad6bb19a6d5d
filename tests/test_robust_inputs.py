"""Bad input becomes an error column; lists of files, logs and reports at their edges."""

import zlib

from pyspark.sql import functions as F

from paywire.operators import iso8583 as iso
from paywire.operators import mtmx, redact, render
from paywire.sources import files, log


def test_build_takes_null_numbers_and_values(spark):
    rows = [(1, "0210", [(3, b"000000"), (None, b"x")]), (2, "0210", [(3, None)]), (3, "0210", [(None, None)]), (4, None, None), (5, "0210", []), (6, "0210", [(300, None)])]
    df = spark.createDataFrame(rows, "k int, mti string, f array<struct<number:int,value:binary>>")
    got = {r["k"]: (r["b"]["error"]["code"] if r["b"]["error"] else None, r["b"]["wire"] is not None) for r in df.select("k", iso.build(F.col("mti"), F.col("f")).alias("b")).collect()}
    assert got == {1: ("InvalidFieldNumber", False), 2: ("InvalidValue", False), 3: ("InvalidFieldNumber", False), 4: ("InvalidMti", False), 5: (None, True), 6: ("InvalidFieldNumber", False)}


def test_json_messages_end_to_end(spark):
    texts = ['{"mti": "0210", "fields": {"3": "000000"}}', '{"mti": "0210", "fields": {"three": "1"}}', '{"mti": "0210", "fields": {"3": "hex:0"}}', '{"mti": "0210", "fields": {"3": null}}', "no json", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", files.json_message(F.col("t")).alias("j"))
    got = {r["k"]: r["b"]["error"]["code"] if r["b"]["error"] else None for r in df.select("k", iso.build(F.col("j.mti"), F.col("j.fields")).alias("b")).collect()}
    assert got == {0: None, 1: "InvalidFieldNumber", 2: "InvalidValue", 3: "InvalidValue", 4: "InvalidMti", 5: "InvalidMti", 6: "InvalidMti"}


def test_listed_files_in_one_read(spark, tmp_path):
    for name in ("a.bin", "b c.bin"):
        (tmp_path / name).write_bytes(name.encode())
    paths = [str(tmp_path / n) for n in ("a.bin", "none.bin", "b c.bin", "a.bin")]
    found = [(r["path"], r["content"]) for r in files.listed_files(spark, paths).collect()]
    assert sorted(found, key=str) == sorted([(p, None if "none" in p else p.rsplit("/", 1)[1].encode()) for p in paths], key=str)
    assert [r["content"] for r in files.listed_files(spark, [str(tmp_path / "none.bin")]).collect()] == [None]
    assert files.listed_files(spark, []).count() == 0


def test_logs_grow_and_shrink(spark):
    frame = lambda p: len(p).to_bytes(4, "little") + zlib.crc32(p).to_bytes(4, "little") + p
    logs = spark.createDataFrame([("a", log.MAGIC + frame(b"one")), ("bad", b"x"), ("c", log.MAGIC)], "path string, content binary")
    more = spark.createDataFrame([("a", 2, b"3"), ("a", 1, b"2"), ("bad", 1, b"y"), ("new", 1, b"z"), ("c", 1, None)], "path string, o int, payload binary")
    got = {r["path"]: (r["content"], r["offset"]) for r in log.appended(logs, more).collect()}
    assert got == {"a": (log.MAGIC + frame(b"one") + frame(b"2") + frame(b"3"), 19), "bad": (b"x", None), "new": (log.MAGIC + frame(b"z"), 8), "c": (log.MAGIC, None)}
    cut = lambda at: {r["path"]: r["content"] for r in log.truncated(logs, F.lit(at)).collect()}["a"]
    assert (cut(0), cut(8), cut(12), cut(99)) == (log.MAGIC, log.MAGIC, log.MAGIC + frame(b"one")[:4], log.MAGIC + frame(b"one"))


def test_trees_limits_and_meta(spark):
    df = spark.createDataFrame([(1,)], "k int").select("k", iso.build(F.lit("0210"), F.array(F.struct(F.lit(2).alias("number"), F.encode(F.lit("412345"), "US-ASCII").alias("value"))))["wire"].alias("w"))
    tree = df.select(iso.sniff(F.col("w")).alias("m")).select(render.message_tree(F.col("m")).alias("t")).first()["t"].split("\n")
    assert tree[0] == "ISO 8583 Message" and tree[1] == "MTI: 0210" and tree[3] == "Fields set: 2" and tree[4].endswith('(6 bytes): "412345"')
    assert len(df.select(render.validate(F.col("w")).alias("v")).first()["v"]["limitations"]) == 4
    meta = redact.with_meta(redact.sanitize(df, ["k"], "w")).select("low_anonymity", redact.meta_toml(("source", F.lit('a "b"'))).alias("t")).first()
    assert meta["t"].startswith('source = "a \\"b\\""\nsanitize_version = 1\n') and "fields_redacted = [2]" in meta["t"]
    short = df.select("k", iso.build(F.lit("0210"), F.array(F.struct(F.lit(2).alias("number"), F.encode(F.lit("4123"), "US-ASCII").alias("value"))))["wire"].alias("w"))
    assert redact.sanitize(short, ["k"], "w").first()["low_anonymity"] is True


def test_pairs_without_a_side(spark):
    left = spark.createDataFrame([(1, "{1:A}"), (2, "{1:A}")], "k int, mt string")
    right = spark.createDataFrame([(2, "<x>"), (3, "<x>")], "k int, xml string")
    got = {r["k"]: r["error"] for r in mtmx.diff(mtmx.pair(left, right, ["k"], "mt", "xml"), ["k"], "mt", "xml").collect()}
    assert got == {1: "MissingMx", 2: "MalformedXml", 3: "MissingMt"}


def test_json_values_of_other_shapes(spark):
    """Text that looks like JSON stays text; numbers, lists and other objects are NULL values, wrong hex and types too."""
    value = lambda v: '{"mti": "0200", "fields": {"48": ' + v + "}}"
    cases = {'"{not json"': b"{not json", '"[1]"': b"[1]", '"hex:4a4B"': b"JK", '{"hex": "4a"}': b"J", "12": None, "1.5": None, "true": None, "null": None, "[\"a\"]": None, "{}": None, '{"hex": 12}': None, '{"hex": "4a", "x": 1}': None, '{"hex": {"hex": "4a"}}': None, '"hex:4"': None, '{"hex": "zz"}': None, '"é"': "é".encode()}
    rows = spark.createDataFrame([(k, value(k)) for k in cases], "k string, t string")
    got = {r["k"]: r["j"]["fields"][0]["value"] for r in rows.select("k", files.json_message(F.col("t")).alias("j")).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == cases
    odd = ["", None, "[]", "{", '{"mti": 200}', '{"mti": "0200", "fields": []}', '{"mti": "0200", "fields": {"3": "1", "3": "2"}}']
    got = [r["j"] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(files.json_message(F.col("t")).alias("j")).collect()]
    assert [x["mti"] for x in got] == [None, None, None, None, None, "0200", None] and all(x["fields"] is None for x in got)
