"""MT against MX: what five roles lose between a SWIFT MT103 and a pacs.008, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.functions.bytesx import squeeze
from paywire.operators import mx, swift

ROLES = ("debtor_name", "creditor_name", "remittance_info", "settlement_amount", "settlement_currency")
#: What the MT side can hold, in characters; NULL is unknown.
CAPACITY = {"debtor_name": 140, "creditor_name": 140, "remittance_info": 140, "settlement_amount": None, "settlement_currency": 3}


def _joined(lines: Column) -> Column:
    kept = F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))
    return F.regexp_replace(F.array_join(kept, " "), r"^(?U)\s+|\s+$", "")


def text_of(raw: Column) -> Column:
    return _joined(F.split(raw, "\n"))


def party_of(raw: Column) -> Column:
    """As text_of, without a first line that holds an account."""
    lines = F.split(raw, "\n")
    return _joined(F.when(F.get(lines, 0).startswith("/"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))).otherwise(lines))


def plain_amount(amount: Column) -> Column:
    """Comma as point, no zeros at the end of a fraction, no bare point; zeros in front stay."""
    dotted = F.replace(amount, F.lit(","), F.lit("."))
    return F.when(dotted.contains("."), F.regexp_replace(dotted, r"\.?0*$", "")).otherwise(dotted)


def mt_roles(b4: Column) -> dict[str, Column]:
    raw = swift.first(b4, "32A")
    return {
        "debtor_name": party_of(swift.first(b4, "50K")),
        "creditor_name": party_of(swift.first(b4, "59")),
        "remittance_info": text_of(swift.first(b4, "70")),
        "settlement_amount": plain_amount(F.when(F.length(raw) > 9, F.substring(raw, F.lit(10), F.length(raw)))),
        "settlement_currency": F.when(F.length(raw) >= 9, F.substring(raw, 7, 3)),
    }


def mx_roles(doc: Column) -> dict[str, Column]:
    """The amount is read as a number and written in full, so 1.50 and 1.5 are the same."""
    tx = F.get(doc["Document"]["FIToFICstmrCdtTrf"]["CdtTrfTxInf"], 0)
    present = lambda c: F.nullif(F.regexp_replace(c, r"^(?U)\s+|\s+$", ""), F.lit(""))
    number = tx["IntrBkSttlmAmt"]["_VALUE"].try_cast("double").try_cast("decimal(38,10)").cast("string")
    return {
        "debtor_name": present(tx["Dbtr"]["Nm"]),
        "creditor_name": present(tx["Cdtr"]["Nm"]),
        "remittance_info": present(F.array_join(tx["RmtInf"]["Ustrd"], " ")),
        "settlement_amount": plain_amount(number),
        "settlement_currency": present(tx["IntrBkSttlmAmt"]["_Ccy"]),
    }


def classify(mt: Column, xml: Column, capacity: int | None) -> Column:
    """Verdict; the order counts: an identical over-long pair is equal, and length is tested before white space."""
    long = F.length(xml) > capacity if capacity is not None else F.lit(False)
    return (
        F.when(mt.isNull() & xml.isNull(), F.lit("absent_both"))
        .when(xml.isNull(), F.lit("added"))
        .when(mt.isNull(), F.lit("dropped"))
        .when(mt == xml, F.lit("equal"))
        .when(long, F.lit("truncated"))
        .when(squeeze(mt) == squeeze(xml), F.lit("reformatted"))
        .otherwise(F.lit("mismatch"))
    )


def diff(df: DataFrame, keys: list[str], mt: str, xml: str) -> DataFrame:
    """keys, role, mt_value, mx_value, verdict, lost_suffix, error: five rows a pair; one with an error where a side can't be read."""
    def read(d: Column) -> Column:
        error = F.coalesce(mx.parse_error(d), F.when(d["Document"]["FIToFICstmrCdtTrf"].isNull(), F.lit("UnsupportedDocument")))
        return F.struct(error.alias("error"), *(v.alias(k) for k, v in mx_roles(d).items()))

    parsed = df.select(*keys, swift.parse(F.col(mt)).alias("_m"), F.col(xml).isNull().alias("_none"), mx.once(mx.parse(F.col(xml)), read).alias("_x"))
    m, x = F.col("_m"), F.col("_x")
    error = F.coalesce(m["error"], F.when(m.isNull(), F.lit("MissingMt")), F.when(F.col("_none"), F.lit("MissingMx")), x["error"])
    left = mt_roles(m["b4"])
    pair = lambda r: F.struct(F.lit(r).alias("role"), left[r].alias("mt"), x[r].alias("mx"))
    none = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("mt"), F.lit(None).cast("string").alias("mx")))
    flat = parsed.select(*keys, error.alias("error"), F.explode(F.when(error.isNull(), F.array(*(pair(r) for r in ROLES))).otherwise(none)).alias("_r"))
    a, b, role = F.col("_r.mt"), F.col("_r.mx"), F.col("_r.role")
    verdict = F.lit(None).cast("string")
    lost = F.lit(None).cast("string")
    for r in ROLES:
        verdict = F.when(role == r, classify(a, b, CAPACITY[r])).otherwise(verdict)
        if CAPACITY[r] is not None:
            lost = F.when(role == r, F.substring(b, F.lit(CAPACITY[r] + 1), F.length(b))).otherwise(lost)
    rows = flat.select(*keys, role.alias("role"), a.alias("mt_value"), b.alias("mx_value"), verdict.alias("verdict"), lost.alias("_lost"), "error")
    return rows.withColumn("lost_suffix", F.when(F.col("verdict") == "truncated", F.col("_lost"))).drop("_lost")


def pair(mts: DataFrame, mxs: DataFrame, keys: list[str], mt: str, xml: str) -> DataFrame:
    """keys, mt, xml of two tables by a full outer join; diff() tells which side of a pair is missing.

    Repeated keys pair each with each; of NULL keys none has a partner.
    """
    left = mts.select(*keys, F.col(mt).alias("mt"))
    return left.join(mxs.select(*keys, F.col(xml).alias("xml")), keys, "full_outer")


def payloads(rows: DataFrame) -> DataFrame:
    """rows with `payload`, JSON of role, verdict and only what the verdict needs: the lost suffix and its length, or the values that differ."""
    verdict = F.col("verdict")
    show = lambda c, *verdicts: F.when(verdict.isin(*verdicts), c)
    told = F.struct(
        "role",
        "verdict",
        show(F.col("mt_value"), "added", "mismatch", "reformatted").alias("mt"),
        show(F.col("mx_value"), "dropped", "mismatch", "reformatted").alias("mx"),
        show(F.col("lost_suffix"), "truncated").alias("lost_suffix"),
        show(F.length("lost_suffix"), "truncated").alias("lost_chars"),
    )
    return rows.withColumn("payload", F.when(F.col("role").isNotNull(), F.to_json(told)))


def lossy(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("verdict").isin("truncated", "dropped"))
