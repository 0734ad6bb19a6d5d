"""Ordered reports as files, and lists of files."""

import csv
import io

from paywire.operators import mx
from paywire.sources import files, reports


def joined(path):
    return b"".join(p.read_bytes() for p in sorted(path.rglob("part-*")))


def checked(spark, n):
    address = lambda inner: f"<Envelope><AppHdr><MsgDefIdr>pacs.008.001.08</MsgDefIdr></AppHdr><Document><FIToFICstmrCdtTrf><CdtTrfTxInf><Dbtr><PstlAdr>{inner}</PstlAdr></Dbtr><Cdtr><PstlAdr><TwnNm>A, B</TwnNm><Ctry>DE</Ctry></PstlAdr></Cdtr></CdtTrfTxInf></FIToFICstmrCdtTrf></Document></Envelope>"
    texts = [address("<TwnNm>T</TwnNm><Ctry>DE</Ctry>"), address("<AdrLine>x</AdrLine>"), "<Envelope>"]
    rows = [(f"m{i:03}" if i else 'a "b"', texts[i % 3]) for i in range(n)]
    return mx.check_addresses(spark.createDataFrame(rows, "file string, xml string").repartition(3), ["file"], "xml")


def test_csv_in_several_parts_is_the_plain_form(spark, tmp_path):
    rows = checked(spark, 60)
    reports.write_csv(rows, "file", f"{tmp_path}/r", parts=5)
    assert len(list((tmp_path / "r/1-rows").glob("part-*"))) > 2
    out = io.StringIO()
    plain = csv.writer(out, lineterminator="\r\n")
    plain.writerow(reports.CSV_COLUMNS)
    for r in sorted(rows.collect(), key=lambda r: (r["file"], r["party"] != "debtor")):
        if r["error"]:
            plain.writerow([r["file"], "error", *[""] * 6, r["error"]])
        else:
            plain.writerow([r["file"], "ok", r["message_type"], r["party"], r["verdict"], r["town_name"] or "", r["country"] or "", r["unstructured_lines"] or 0, r["remediation"] or ""])
    assert joined(tmp_path / "r").decode() == out.getvalue()


def test_text_in_several_parts(spark, tmp_path):
    rows = checked(spark, 60)
    counts = reports.write_text(rows, "file", f"{tmp_path}/r", parts=5)
    assert counts == mx.address_gate(rows, ["file"]).first().asDict()
    lines = joined(tmp_path / "r").decode().split("\n")
    assert lines[0] == "Addresses of messages" and lines[-2:] == ["60 messages: 20 compliant, 20 not compliant, 20 failed; gate 2", ""]
    assert lines[1] == 'ok       a "b"  pacs.008.001.08  debtor=compliant creditor=compliant'
    assert lines[2] == "lacking  m001  pacs.008.001.08  debtor=missing_structured creditor=compliant" and lines[3].startswith("error    m002  ")
    assert lines[1:-2] == [lines[1], *sorted(lines[2:-2], key=lambda x: x.split()[1])] and len(lines) == 63


def test_one_message_and_none(spark, tmp_path):
    assert reports.write_text(checked(spark, 1), "file", f"{tmp_path}/one")["gate"] == 0
    assert "         debtor  compliant" in joined(tmp_path / "one").decode()
    assert reports.write_text(checked(spark, 1).limit(0), "file", f"{tmp_path}/none")["gate"] == 0
    assert joined(tmp_path / "none").decode().endswith("0 messages: 0 compliant, 0 not compliant, 0 failed; gate 0\n")


def test_listed_files_with_reasons(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"1")
    (tmp_path / "b[1]*.bin").write_bytes(b"2")
    (tmp_path / "sub").mkdir()
    paths = [f"{tmp_path}/{x}" for x in ("a.bin", "b[1]*.bin", "none", "sub", "nowhere/x", "a.bin")]
    got = sorted(((r["path"].rsplit("/", 1)[-1], r["content"] and bytes(r["content"]), r["error"]) for r in files.listed_files(spark, paths).collect()), key=str)
    assert got == sorted([("a.bin", b"1", None), ("a.bin", b"1", None), ("b[1]*.bin", b"2", None), ("none", None, "not found"), ("sub", None, "is a folder"), ("x", None, "not found")], key=str)
    assert [r["error"] for r in files.listed_files(spark, paths[2:3]).collect()] == ["not found"]
