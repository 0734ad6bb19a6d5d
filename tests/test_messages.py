"""Vectors for the comparison operators, SWIFT text, envelopes and redaction."""

import pytest
from pyspark.sql import functions as F

from paywire.functions import fin
from paywire.operators import conformance as conf
from paywire.operators import iso8583 as iso
from paywire.operators import mtmx, mx, redact, swift

B = "binary"


def occurrences(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, l array<binary>, m array<binary>, mask string, expect binary")
    got = df.select("i", conf.classify(F.col("l"), F.col("m"), F.col("mask"), F.col("expect")).alias("v")).orderBy("i").collect()
    return [(r["v"]["verdict"], r["v"]["reason"]) for r in got]


def test_presence_matrix(spark):
    drift = lambda why: ("UNEXPLAINED", why)
    cases = [
        ([], [], "stable", None, ("equal", None)),
        ([], [], "intended-delta", b"x", drift("intended_delta_unmet")),
        ([b"a"], [], "stable", None, drift("presence_mismatch")),
        ([], [b"a"], "stable", None, drift("presence_mismatch")),
        ([], [b"x"], "intended-delta", b"x", ("intended-delta", None)),
        ([b"x"], [], "intended-delta", b"x", drift("intended_delta_unmet")),
        ([], [b"x", b"y"], "intended-delta", b"x", ("intended-delta", None)),
        ([b"a"], [b"a", b"a"], "stable", None, drift("occurrence_count_diff")),
        ([b"a"], [b"x", b"x"], "intended-delta", b"x", drift("occurrence_count_diff")),
        ([b"a"], [b"a"], "stable", None, ("equal", None)),
        ([b"ABCDEFGHIJ"], [b"ABCDEFGHIJKL"], "stable", None, drift("length_diff")),
        ([b"a"], [b"b"], "stable", None, drift("value_diff")),
        ([b"a", b"b"], [b"a", b"c"], "stable", None, drift("value_diff")),
        ([b"a", b"b"], [b"a", b"b"], "stable", None, ("equal", None)),
        ([b"1"], [b"2"], "volatile", None, ("volatile-normalized", None)),
        ([b"1"], [], "crypto", None, ("crypto-excluded", None)),
        ([b"old"], [b"x"], "intended-delta", b"x", ("intended-delta", None)),
        ([b"x"], [b"old"], "intended-delta", b"x", drift("intended_delta_unmet")),
    ]
    assert occurrences(spark, [c[:4] for c in cases]) == [c[4] for c in cases]


def test_masks():
    spec = conf.MaskSpec.from_toml('interface = "i"\ndefault_mask = "volatile"\n[[mask]]\nfield = 63\nmask = "intended-delta"\nexpect_hex = "5632"\n[[mask]]\nfield = 63\nmask = "stable"\n')
    assert spec.first()[63].expect == b"V2" and spec.default == "volatile"
    for bad in ((1, "intended-delta", None), (1, "stable", b"x"), (1, "other", None)):
        with pytest.raises(ValueError):
            conf.Mask(*bad)


def test_errors_reach_the_gate(spark):
    good = bytes.fromhex("30383030" + "00" * 8)
    df = spark.createDataFrame([(1, good, good, good), (2, b"??", good, good), (3, good, None, good)], "k int, q binary, l binary, m binary")
    diff = conf.check_wires(df, ["k"], "q", "l", "m", conf.MaskSpec())
    got = {r["k"]: (r["percent"], r["gate"]) for r in conf.coverage(diff, ["k"]).collect()}
    assert got == {1: (100, 0), 2: (0, 2), 3: (0, 2)}
    assert conf.batch_gate(conf.coverage(diff, ["k"])).first().asDict() == {"inputs": 3, "drifted": 0, "errors": 2, "gate": 2}
    assert conf.batch_gate(conf.coverage(diff.limit(0), ["k"])).first()["gate"] == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{1:A}{4:\r\n:20:R\r\n:50K:/1\r\nN\r\n-}", {"b1": "A", "b4": [("20", "R"), ("50K", "/1\r\nN")]}),
        ("{4:\n::20X:R\n-}", {"b4": [("20X", "R")]}),
        (" {1:A}\n{3:{108:REF}{x:{y}}} ", {"b1": "A", "b3": [("108", "REF"), ("x", "{y}")]}),
        ("{4:-}", {"b4": []}),
        ("", {}),
        ("{4:\r\n:20:R\r\n}", "MissingTextTerminator"),
        ("{4:\r\n:20:R\r\n- }", "MissingTextTerminator"),
        ("{4:\r\n:abc\r\n-}", "MalformedField"),
        ("{1:A}x", "UnexpectedTrailingBytes"),
        ("{1:A", "UnbalancedBrace"),
        ("{1:A}{1:B}", "DuplicateBlock"),
        ("{10:A}", "InvalidBlockId"),
        ("{1A}", "MissingBlockSeparator"),
        ("{3:{:v}}", "MalformedTag"),
    ],
)
def test_blocks(text, want):
    if isinstance(want, str):
        with pytest.raises(fin.Bad, match=want):
            fin.parse(text)
    else:
        assert fin.parse(text) == want


def test_swift_build_and_values(spark):
    rows = [("A", [("20", "R\r\n:x")]), ("A", [("2o", "R")]), ("A", [("20", "a\r\n-\r\nb")]), ("A", [("20", "a{b")]), ("{", [("20", "a")]), ("A", [("20", "a")])]
    df = spark.createDataFrame([(i, a, None, None, f, None, None) for i, (a, f) in enumerate(rows)], f"i int, b1 string, b2 string, b3 {swift.TAGGED}, b4 {swift.TAGGED}, b5 {swift.TAGGED}, error string")
    got = [r["e"] for r in df.select("i", swift.build(F.struct("b1", "b2", "b3", "b4", "b5", "error"))["error"].alias("e")).orderBy("i").collect()]
    assert got == ["ValueSplitsField", "InvalidTag", "ValueEndsBlock", "BraceInValue", "BraceInValue", None]
    values = [
        ("20", "REF-1", None), ("20", "", "InvalidLength"), ("20", "x" * 17, "InvalidLength"), ("20", "ref", "InvalidCharset"),
        ("32A", "240229EUR1,", None), ("32A", "230229EUR1,", "InvalidDate"), ("32A", "241301EUR1,0", "InvalidDate"), ("32A", "240101EuR1,0", "InvalidCurrency"),
        ("32A", "240101EUR1.0", "InvalidAmount"), ("32A", "240101EUR,", "InvalidLength"), ("32A", "240101EUR1,2,3", "InvalidAmount"), ("32A", "240101EUR,,", "InvalidAmount"),
        ("50K", "/123\r\nNAME", None), ("50K", "NAME\r\n\r\n", None), ("50K", "", "InvalidLength"), ("50K", "/" + "1" * 35, "InvalidLength"), ("50K", "A\nB\nC\nD\nE", "InvalidLength"), ("50K", "A" * 36, "InvalidLength"), ("50K", "a", "InvalidCharset"),
        ("71A", "anything", None),
    ]
    df = spark.createDataFrame([(i, t, v) for i, (t, v, _) in enumerate(values)], "i int, t string, v string")
    got = [r["d"] for r in df.select("i", swift.decode(F.col("t"), F.col("v")).alias("d")).orderBy("i").collect()]
    assert [d["error"] for d in got] == [e for *_, e in values]
    assert (got[4]["value_date"], got[4]["currency"], got[4]["amount"]) == ("240229", "EUR", "1,") and (got[12]["account"], got[12]["lines"]) == ("123", ["NAME"]) and got[-1]["raw"] == "anything"


def envelope(body, kind="pacs.008.001.08"):
    return f"<E><AppHdr><MsgDefIdr>{kind}</MsgDefIdr></AppHdr><Document>{body}</Document></E>"


def test_addresses(spark):
    tx = lambda d, c: envelope(f"<FIToFICstmrCdtTrf><CdtTrfTxInf><Dbtr>{d}</Dbtr><Cdtr>{c}</Cdtr></CdtTrfTxInf></FIToFICstmrCdtTrf>")
    rows = [
        ("a", tx("<PstlAdr><TwnNm>T</TwnNm><Ctry>DE</Ctry></PstlAdr>", "<PstlAdr><AdrLine>x</AdrLine><AdrLine>y</AdrLine></PstlAdr>")),
        ("b", tx("<Nm>N</Nm>", "<PstlAdr/>")),
        ("c", "<E><oops"),
        ("d", "<E><Document><x/></Document></E>"),
        ("e", envelope("<Other><y/></Other>", "camt.053.001.08")),
        ("f", None),
        ("g", envelope("<PmtRtr><TxInf><RtrChain><Dbtr><Pty><PstlAdr><TwnNm>T</TwnNm><Ctry>FR</Ctry></PstlAdr></Pty></Dbtr><Cdtr><Agt>z</Agt></Cdtr></RtrChain></TxInf></PmtRtr>", "pacs.004.001.09")),
    ]
    found = mx.check_addresses(spark.createDataFrame(rows, "k string, xml string"), ["k"], "xml")
    got = {(r["k"], r["party"]): (r["verdict"], r["unstructured_lines"], r["error"]) for r in found.collect()}
    assert got == {
        ("a", "debtor"): ("compliant", 0, None), ("a", "creditor"): ("missing_structured", 2, None),
        ("b", "debtor"): ("no_address", None, None), ("b", "creditor"): ("missing_structured", 0, None),
        ("c", None): (None, None, "MalformedXml"), ("d", None): (None, None, "MissingHeader"), ("e", None): (None, None, "UnsupportedDocument"), ("f", None): (None, None, "MalformedXml"),
        ("g", "debtor"): ("compliant", 0, None), ("g", "creditor"): ("no_address", None, None),
    }
    assert mx.address_gate(found, ["k"]).first().asDict() == {"compliant": 0, "non_compliant": 3, "errors": 4, "gate": 2}


def test_mt_mx_verdicts(spark):
    def pair(name_mt, name_mx, note_mt=None, note_mx=None, amount=("1,50", "1.5")):
        mt = "{4:\r\n:32A:240101EUR" + amount[0] + (f"\r\n:50K:{name_mt}" if name_mt else "") + (f"\r\n:70:{note_mt}" if note_mt else "") + "\r\n-}"
        tx = f'<IntrBkSttlmAmt Ccy="EUR">{amount[1]}</IntrBkSttlmAmt>' + (f"<Dbtr><Nm>{name_mx}</Nm></Dbtr>" if name_mx else "") + (f"<RmtInf><Ustrd>{note_mx}</Ustrd></RmtInf>" if note_mx else "")
        return mt, envelope(f"<FIToFICstmrCdtTrf><CdtTrfTxInf>{tx}</CdtTrfTxInf></FIToFICstmrCdtTrf>")

    rows = [pair("/1\r\nA  B", "A B"), pair("A" * 140, "A" * 140 + "Z"), pair(None, "A"), pair("A", None), pair("A", "B", "x", "x"), pair("A" * 150, "A" * 150, amount=("100,", "100.00")), pair("A", "A", amount=(",50", "0.5"))]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, mt string, mx string")
    got = {(r["i"], r["role"]): (r["verdict"], r["lost_suffix"]) for r in mtmx.diff(df, ["i"], "mt", "mx").collect()}
    assert [got[i, "debtor_name"] for i in range(6)] == [("reformatted", None), ("truncated", "Z"), ("dropped", None), ("added", None), ("mismatch", None), ("equal", None)]
    assert got[0, "creditor_name"] == ("absent_both", None) and got[4, "remittance_info"] == ("equal", None)
    assert [got[i, "settlement_amount"][0] for i in (0, 5, 6)] == ["equal", "equal", "mismatch"] and got[0, "settlement_currency"] == ("equal", None)
    bad = spark.createDataFrame([(1, "x", rows[0][1]), (2, rows[0][0], "<"), (3, None, rows[0][1]), (4, rows[0][0], envelope("<PmtRtr/>"))], "i int, mt string, mx string")
    assert {r["i"]: r["error"] for r in mtmx.diff(bad, ["i"], "mt", "mx").collect()} == {1: "UnexpectedTrailingBytes", 2: "MalformedXml", 3: "MissingMt", 4: "UnsupportedDocument"}


def test_redaction(spark):
    fields = [(2, b"4111111111111111"), (35, b"4111=2512"), (41, b"TERM0001"), (102, b"DE12")]
    df = spark.createDataFrame([("hybrid", fields), ("binary", fields), ("binary", [(41, b"TERM0001")]), ("ascii", [(2, b"12345")])], f"d string, f {iso.FIELDS}")
    wires = df.select(F.monotonically_increasing_id().alias("k"), "d", iso.build(F.lit("0200"), F.col("f"), F.col("d"))["wire"].alias("w"))
    got = {(r["d"], r["error"]): r for r in redact.sanitize(wires, ["k", "d"], "w").collect()}
    a, c = got["hybrid", None], got["ascii", None]
    assert b"411111XXXXXX1111" in bytes(a["wire"]) and b"XXXXXXXXX" in bytes(a["wire"]) and b"0000" in bytes(a["wire"])
    assert (a["touched"], a["anonymity"], a["low_anonymity"]) == ([2, 35, 41, 102], 100_000, False)
    assert (c["anonymity"], c["low_anonymity"]) == (1000, True) and b"1XXXX" in bytes(c["wire"])
    assert got["binary", None]["anonymity"] == 0 and got["binary", None]["low_anonymity"] and ("binary", "PackedAccountNumber") in got
