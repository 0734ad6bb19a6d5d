"""ISO 20022 envelopes: the paths that the address rule and the MT/MX diff need, and the structured-address rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.operators.gates import Gate

_ADDRESS = "PstlAdr STRUCT<TwnNm: STRING, Ctry: STRING, AdrLine: ARRAY<STRING>>"
_PARTY = f"STRUCT<Nm: STRING, {_ADDRESS}>"
_PTY = f"STRUCT<Pty: {_PARTY}>"
_TX8 = f"STRUCT<Dbtr: {_PARTY}, Cdtr: {_PARTY}, RmtInf: STRUCT<Ustrd: ARRAY<STRING>>, IntrBkSttlmAmt: STRUCT<_VALUE: STRING, _Ccy: STRING>>"
#: Only the paths that are read: XML text is not pruned by Spark, so the schema is kept small by hand.
SCHEMA = (
    "AppHdr STRUCT<MsgDefIdr: STRING>, Document STRUCT<"
    f"FIToFICstmrCdtTrf: STRUCT<CdtTrfTxInf: ARRAY<{_TX8}>>, "
    f"PmtRtr: STRUCT<TxInf: ARRAY<STRUCT<RtrChain: STRUCT<Dbtr: {_PTY}, Cdtr: {_PTY}>>>>, "
    f"FIToFICstmrDrctDbt: STRUCT<DrctDbtTxInf: ARRAY<STRUCT<Dbtr: {_PARTY}, Cdtr: {_PARTY}>>>, "
    f"CstmrCdtTrfInitn: STRUCT<PmtInf: ARRAY<STRUCT<Dbtr: {_PARTY}, CdtTrfTxInf: ARRAY<STRUCT<Cdtr: {_PARTY}>>>>>>, "
    "_broken STRING"
)


def parse(xml: Column) -> Column:
    """struct<AppHdr, Document, _broken>; a broken text has _broken set and the rest NULL."""
    return F.from_xml(xml, SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"})


def message_type(doc: Column) -> Column:
    """The type as the header names it."""
    return doc["AppHdr"]["MsgDefIdr"]


def to_json(doc: Column) -> Column:
    """The paths that are read, as JSON; what is absent is left out."""
    return F.to_json(F.struct(doc["AppHdr"].alias("AppHdr"), doc["Document"].alias("Document")))


def to_xml(doc: Column) -> Column:
    """The paths that are read, as an envelope that parse() reads back to the same value."""
    whole = F.struct(doc["AppHdr"].alias("AppHdr"), doc["Document"].alias("Document"))
    return F.when(parse_error(doc).isNull(), F.to_xml(whole, {"rowTag": "Envelope", "attributePrefix": "_", "valueTag": "_VALUE"}))


def once(value: Column, use) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def parse_error(doc: Column) -> Column:
    """NULL where the envelope is whole: XML that parses, a header that names the type, and a document."""
    return (
        F.when(doc.isNull() | doc["_broken"].isNotNull(), F.lit("MalformedXml"))
        .when(doc["AppHdr"]["MsgDefIdr"].isNull(), F.lit("MissingHeader"))
        .when(doc["Document"].isNull(), F.lit("MissingDocument"))
    )


def parties(doc: Column) -> Column:
    """struct<message_type, debtor, creditor> by the kind of document; NULL where it is not one of the four.

    The first transaction counts.  debtor and creditor are addresses, NULL where there is none.
    """
    d = doc["Document"]
    adr = "struct<TwnNm:string,Ctry:string,AdrLine:array<string>>"

    def made(name: str, debtor: Column, creditor: Column) -> Column:
        return F.struct(F.lit(name).alias("message_type"), debtor["PstlAdr"].cast(adr).alias("debtor"), creditor["PstlAdr"].cast(adr).alias("creditor"))

    t8, t4 = F.get(d["FIToFICstmrCdtTrf"]["CdtTrfTxInf"], 0), F.get(d["PmtRtr"]["TxInf"], 0)["RtrChain"]
    t3, p1 = F.get(d["FIToFICstmrDrctDbt"]["DrctDbtTxInf"], 0), F.get(d["CstmrCdtTrfInitn"]["PmtInf"], 0)
    return (
        F.when(d["FIToFICstmrCdtTrf"].isNotNull(), made("pacs.008.001.08", t8["Dbtr"], t8["Cdtr"]))
        .when(d["PmtRtr"].isNotNull(), made("pacs.004.001.09", t4["Dbtr"]["Pty"], t4["Cdtr"]["Pty"]))
        .when(d["FIToFICstmrDrctDbt"].isNotNull(), made("pacs.003.001.08", t3["Dbtr"], t3["Cdtr"]))
        .when(d["CstmrCdtTrfInitn"].isNotNull(), made("pain.001.001.09", p1["Dbtr"], F.get(p1["CdtTrfTxInf"], 0)["Cdtr"]))
    )


def address_verdict(adr: Column) -> Column:
    """no_address, compliant (town and country are there, even empty), else missing_structured."""
    return F.when(adr.isNull(), F.lit("no_address")).when(adr["TwnNm"].isNotNull() & adr["Ctry"].isNotNull(), F.lit("compliant")).otherwise(F.lit("missing_structured"))


def remediation(verdict: Column, adr: Column) -> Column:
    lines = F.coalesce(F.size(adr["AdrLine"]), F.lit(0))
    lines = F.when(lines > 0, lines).otherwise(F.lit(0))
    missing = F.array_join(F.filter(F.array(F.when(adr["TwnNm"].isNull(), F.lit("TwnNm")), F.when(adr["Ctry"].isNull(), F.lit("Ctry"))), lambda x: x.isNotNull()), " and ")
    text = F.concat(F.lit("add "), missing, F.when(lines > 0, F.concat(F.lit("; "), lines.cast("string"), F.lit(" unstructured line(s) present"))).otherwise(F.lit("")))
    return F.when(verdict == "missing_structured", text).when(verdict == "no_address", F.lit("add a postal address with TwnNm and Ctry"))


def check_addresses(df: DataFrame, keys: list[str], xml: str, gate: Gate | None = None) -> DataFrame:
    """keys, message_type, party, verdict, town_name, country, unstructured_lines, remediation, error: two rows a message, one where it fails.

    gate: counts the messages on their way, as `address_gate` counts them afterwards.
    """
    # bound once: an expression that is read often would be worked out as often
    found = once(parse(F.col(xml)), lambda d: F.struct(parse_error(d).alias("e"), parties(d).alias("p")))
    found = df.select(*keys, found.alias("_f")).select(*keys, F.col("_f.e").alias("_e"), F.col("_f.p").alias("_p"))
    error = F.coalesce("_e", F.when(F.col("_p").isNull(), F.lit("UnsupportedDocument")))
    if gate:
        good = (address_verdict(F.col("_p.debtor")) == "compliant") & (address_verdict(F.col("_p.creditor")) == "compliant")
        found = gate.watch(found, compliant=F.count_if(error.isNull() & good), non_compliant=F.count_if(error.isNull() & ~good), errors=F.count_if(error.isNotNull()))
    one = lambda party, adr: F.struct(F.lit(party).alias("party"), adr.alias("adr"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("party"), F.lit(None).cast("struct<TwnNm:string,Ctry:string,AdrLine:array<string>>").alias("adr")))
    rows = found.select(*keys, error.alias("error"), F.when(error.isNull(), F.col("_p.message_type")).alias("message_type"), F.explode(F.when(error.isNull(), F.array(one("debtor", F.col("_p.debtor")), one("creditor", F.col("_p.creditor")))).otherwise(none)).alias("_r"))
    adr, verdict = F.col("_r.adr"), F.when(F.col("error").isNull(), address_verdict(F.col("_r.adr")))
    lines = F.when(adr.isNotNull(), F.greatest(F.coalesce(F.size(adr["AdrLine"]), F.lit(0)), F.lit(0)))
    return rows.select(*keys, "message_type", F.col("_r.party").alias("party"), verdict.alias("verdict"), adr["TwnNm"].alias("town_name"), adr["Ctry"].alias("country"), lines.alias("unstructured_lines"), remediation(verdict, adr).alias("remediation"), "error")


def address_gate(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: compliant, non_compliant, errors (messages) and gate 2 for errors, else 1 for a non-compliant message, else 0."""
    each = rows.groupBy(*keys).agg(F.max(F.col("error").isNotNull()).alias("error"), F.min(F.coalesce(F.col("verdict") == "compliant", F.lit(False))).alias("good"))
    counts = each.agg(F.count_if(~F.col("error") & F.col("good")).alias("compliant"), F.count_if(~F.col("error") & ~F.col("good")).alias("non_compliant"), F.count_if("error").alias("errors"))
    return counts.withColumn("gate", F.when(F.col("errors") > 0, 2).when(F.col("non_compliant") > 0, 1).otherwise(0))


def gate_of(counts: dict[str, int]) -> int:
    return 2 if counts["errors"] else 1 if counts["non_compliant"] else 0


def address_reports(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, all_compliant, failing (parties in order), report (JSON with its nulls kept), error: one row a message."""
    line = F.struct("party", "verdict", "town_name", "country", "unstructured_lines", "remediation")
    each = rows.groupBy(*keys).agg(F.first("message_type").alias("message_type"), F.first("error").alias("error"), F.array_sort(F.collect_list(F.struct((F.col("party") != "debtor").alias("second"), line.alias("line")))).alias("lines"))
    found = each.withColumn("lines", F.when(F.col("error").isNull(), F.transform("lines", lambda x: x["line"])))
    bad = F.filter("lines", lambda x: x["verdict"] != "compliant")
    good = F.size(bad) == 0
    report = F.to_json(F.struct("message_type", good.alias("compliant"), F.col("lines").alias("rows")), {"ignoreNullFields": "false"})
    ok = F.col("error").isNull()
    return found.select(*keys, F.when(ok, good).alias("all_compliant"), F.transform(bad, lambda x: x["party"]).alias("failing"), F.when(ok, report).alias("report"), "error")


def csv_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Columns in the order of the CSV report; write with header, quote and escape as a double quote and CRLF."""
    return rows.select(*keys, "message_type", "party", "verdict", F.col("town_name").isNotNull().alias("has_town"), F.col("country").isNotNull().alias("has_country"), "unstructured_lines", "remediation", "error")
