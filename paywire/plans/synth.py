"""Deterministic wire messages made from the relational tables, for queries whose answers follow from the source columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywire.operators import iso8583


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; one of fewer files than there are cores is dealt out, as a small file is one task."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df if len(df.inputFiles()) >= cores else df.repartition(cores)


def _text(c: Column) -> Column:
    return F.encode(c, "US-ASCII")


def cents(price: Column) -> Column:
    return F.floor(price * 100 + 0.5).cast("long")


def order_fields(migrated: bool = False) -> Column:
    """Fields of a response for a row of orders; the migrated side differs by rules on the key."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    code = F.when(F.col("o_orderstatus") == "F", "00").when(F.col("o_orderstatus") == "O", "05").otherwise("12")
    note = F.col("o_orderpriority")
    trace = F.lpad((key % 1000000).cast("string"), 6, "0")
    when = F.date_format("o_orderdate", "MMddHHmmss")
    terminal = F.concat(F.lit("T"), F.lpad((cust % 10000000).cast("string"), 7, "0"))
    if migrated:
        code = F.when(key % 11 == 0, "91").otherwise(code)
        note = F.when(key % 13 == 0, F.left(note, F.lit(3))).otherwise(note)
        trace = F.lpad(((key + 1) % 1000000).cast("string"), 6, "0")
        when = F.date_format(F.col("o_orderdate") + F.expr("interval 1 second"), "MMddHHmmss")
    fields = [
        (2, F.concat(F.lit("4"), F.lpad(cust.cast("string"), 15, "0"))),
        (3, F.concat(F.left(note, F.lit(1)), F.lit("00000"))) if not migrated else (3, F.concat(F.left(F.col("o_orderpriority"), F.lit(1)), F.lit("00000"))),
        (4, F.lpad(cents(F.col("o_totalprice")).cast("string"), 12, "0")),
        (7, when),
        (11, trace),
        (39, code),
        (41, F.when(key % 17 != 0, terminal) if migrated else terminal),
        (48, note),
        (49, F.lit("840")),
        (70, F.when(key % 5 == 0, F.lit("301"))),
    ]
    return F.filter(F.array(*(F.struct(F.lit(n).alias("number"), _text(v).alias("value")) for n, v in fields)), lambda f: f["value"].isNotNull())


def iso_wires(spark: SparkSession, sf_dir: str, migrated: bool = False, dialect: str | None = "hybrid") -> DataFrame:
    """o_orderkey and wire; dialect None takes one of the three by the key."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", order_fields(migrated).alias("f"))
    which = F.element_at(F.array(*(F.lit(d) for d in iso8583.DIALECTS)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return rows.select("o_orderkey", iso8583.wire(F.lit("0210"), F.col("f"), dialect or which).alias("wire"))


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, request, legacy, migrated as wire bytes; the migrated side speaks another dialect for some."""
    orders = table(spark, sf_dir, "orders")
    request = F.array(F.struct(F.lit(3).alias("number"), _text(F.lit("000000")).alias("value")))
    rows = orders.select("o_orderkey", order_fields().alias("l"), order_fields(True).alias("m"))
    wire = lambda mti, f, d: iso8583.wire(F.lit(mti), f, d)
    return rows.select("o_orderkey", wire("0200", request, "hybrid").alias("request"), wire("0210", F.col("l"), "hybrid").alias("legacy"), wire("0210", F.col("m"), F.when(F.col("o_orderkey") % 3 == 0, "binary").otherwise("hybrid")).alias("migrated"))


def mt_mx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey, mt, mx: a payment for each order, with differences by rules on the key."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    key = F.col("o_orderkey")
    name = F.regexp_replace(F.repeat(F.concat(F.col("c_name"), F.lit(" ")), (1 + key % 9).cast("int")), " $", "")
    amount = cents(F.col("o_totalprice"))
    whole, part = F.floor(amount / 100).cast("string"), F.lpad((amount % 100).cast("string"), 2, "0")
    creditor = F.when(key % 7 == 0, "OTHER CREDITOR").otherwise("SOME CREDITOR")
    note = F.concat(F.lit("ORDER "), key.cast("string"), F.when(key % 5 == 0, F.lit("  PAID")).otherwise(F.lit(" PAID")))
    mt = F.concat(
        F.lit("{1:F01AAAABBCCXXXX0000000000}{2:I103DDDDEEFFXXXXN}{4:\r\n:20:"), key.cast("string"),
        F.lit("\r\n:32A:"), F.date_format("o_orderdate", "yyMMdd"), F.lit("USD"), whole, F.lit(","), part,
        F.lit("\r\n:50K:/12345\r\n"), F.left(name, F.lit(140)), F.lit("\r\n:59:/67890\r\nSOME CREDITOR"),
        F.when(key % 4 != 0, F.concat(F.lit("\r\n:70:ORDER "), key.cast("string"), F.lit(" PAID"))).otherwise(F.lit("")),
        F.lit("\r\n-}"),
    )
    xml = F.concat(
        F.lit('<Envelope><AppHdr><MsgDefIdr>pacs.008.001.08</MsgDefIdr></AppHdr><Document><FIToFICstmrCdtTrf><CdtTrfTxInf><IntrBkSttlmAmt Ccy="USD">'),
        whole, F.lit("."), part, F.lit("</IntrBkSttlmAmt><Dbtr><Nm>"), name, F.lit("</Nm></Dbtr><Cdtr><Nm>"), creditor, F.lit("</Nm></Cdtr>"),
        F.when(key % 6 != 0, F.concat(F.lit("<RmtInf><Ustrd>"), note, F.lit("</Ustrd></RmtInf>"))).otherwise(F.lit("")),
        F.lit("</CdtTrfTxInf></FIToFICstmrCdtTrf></Document></Envelope>"),
    )
    return orders.select("o_orderkey", mt.alias("mt"), xml.alias("mx"))


def address_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """c_custkey, xml: shape by key % 4 (full, lines only, town only, none), message type by key % 5 (4: broken XML)."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    town = F.concat(F.lit("<TwnNm>Town "), key.cast("string"), F.lit("</TwnNm>"))
    country = F.concat(F.lit("<Ctry>"), F.left("n_name", F.lit(2)), F.lit("</Ctry>"))
    inner = F.when(key % 4 == 0, F.concat(town, country)).when(key % 4 == 1, F.lit("<AdrLine>1 Road</AdrLine><AdrLine>Place</AdrLine>")).when(key % 4 == 2, town)
    adr = F.when(key % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("<PstlAdr>"), inner, F.lit("</PstlAdr>")))
    full = F.concat(F.lit("<PstlAdr>"), town, country, F.lit("</PstlAdr>"))
    debtor, creditor = F.concat(F.lit("<Dbtr>"), full, F.lit("</Dbtr>")), F.concat(F.lit("<Cdtr>"), adr, F.lit("</Cdtr>"))
    wrap = lambda name, body: F.concat(F.lit(f"<Envelope><AppHdr><MsgDefIdr>{name}</MsgDefIdr></AppHdr><Document>"), body, F.lit("</Document></Envelope>"))
    tag = lambda path, body: F.concat(F.lit("".join(f"<{p}>" for p in path)), body, F.lit("".join(f"</{p}>" for p in reversed(path))))
    pty = lambda side, a: tag((side, "Pty"), a)
    xml = (
        F.when(key % 5 == 0, wrap("pacs.008.001.08", tag(("FIToFICstmrCdtTrf", "CdtTrfTxInf"), F.concat(debtor, creditor))))
        .when(key % 5 == 1, wrap("pacs.004.001.09", tag(("PmtRtr", "TxInf", "RtrChain"), F.concat(pty("Dbtr", full), pty("Cdtr", adr)))))
        .when(key % 5 == 2, wrap("pacs.003.001.08", tag(("FIToFICstmrDrctDbt", "DrctDbtTxInf"), F.concat(debtor, creditor))))
        .when(key % 5 == 3, wrap("pain.001.001.09", tag(("CstmrCdtTrfInitn", "PmtInf"), F.concat(debtor, tag(("CdtTrfTxInf",), creditor)))))
        .otherwise(F.lit("<Envelope><AppHdr>"))
    )
    return rows.select("c_custkey", "n_name", xml.alias("xml"))
