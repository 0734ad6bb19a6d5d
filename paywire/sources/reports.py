"""Ordered reports of an address check as files: text with a footer, and CSV.

A report is a folder whose files, taken in the order of their paths, are the report:
`0-head`, then `1-rows` in parts by ranges of the label, then `2-foot`.  Each part is
sorted by its own task, and the footer comes from counts that the tasks take along, so no task
sees the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywire.operators import mx
from paywire.operators.gates import Gate
from paywire.operators.render import csv_line

# The columns of the CSV form.
CSV_COLUMNS = ("file", "status", "message_type", "party", "verdict", "town_name", "country", "unstructured_lines", "remediation")


def _write(spark: SparkSession, lines: list[str], path: str, end: str) -> None:
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.option("lineSep", end).text(path)


def _in_order(rows: DataFrame, order: list[str], parts: int) -> DataFrame:
    return rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)


def _write_lines(ranged: DataFrame, line: Column, path: str, end: str) -> None:
    ranged.select(line.alias("value")).write.option("lineSep", end).text(path)


def write_csv(rows: DataFrame, label: str, path: str, parts: int = 200) -> None:
    """The rows of `mx.check_addresses`, by label, as RFC 4180 with CRLF: one line a party, one a failed message with its error in the last column."""
    bad = F.col("error").isNotNull()
    good = lambda c: F.when(~bad, c)
    line = csv_line(F.col(label), F.when(bad, F.lit("error")).otherwise(F.lit("ok")), *(good(F.col(c)) for c in CSV_COLUMNS[2:7]), good(F.coalesce("unstructured_lines", F.lit(0))), F.when(bad, F.col("error")).otherwise(F.col("remediation")))
    second = (F.coalesce(F.col("party"), F.lit("")) != "debtor").alias("_second")
    _write(rows.sparkSession, [",".join(CSV_COLUMNS)], f"{path}/0-head", "\r\n")
    _write_lines(_in_order(rows.select("*", second), [label, "_second"], parts), line, f"{path}/1-rows", "\r\n")


def write_text(rows: DataFrame, label: str, path: str, parts: int = 200) -> dict[str, int]:
    """One line a message by label, then the counts; the gate's result is returned too.  A single message gets a line a party instead."""
    spark = rows.sparkSession
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((F.col("party") != "debtor").alias("second"), F.concat_ws("=", "party", "verdict").alias("said")))), lambda x: x["said"]), " ")
    each = rows.groupBy(label).agg(F.first("message_type").alias("message_type"), F.first("error").alias("error"), F.min(F.coalesce(F.col("verdict") == "compliant", F.lit(False))).alias("good"), said.alias("said"))
    bad = F.col("error").isNotNull()
    gate = Gate(mx.gate_of)
    each = gate.watch(_in_order(each, [label], parts), compliant=F.count_if(~bad & F.col("good")), non_compliant=F.count_if(~bad & ~F.col("good")), errors=F.count_if(bad))
    status = F.when(bad, F.lit("error")).when(F.col("good"), F.lit("ok")).otherwise(F.lit("lacking"))
    line = F.concat_ws("  ", F.rpad(status, 7, " "), F.col(label).cast("string"), F.when(~bad, F.col("message_type")), F.when(bad, F.col("error")).otherwise(F.col("said")))
    _write_lines(each, line, f"{path}/1-rows", "\n")
    counts = gate.result()
    n = counts["compliant"] + counts["non_compliant"] + counts["errors"]
    _write(spark, ["Addresses of messages"], f"{path}/0-head", "\n")
    _write(spark, [f"{n} messages: {counts['compliant']} compliant, {counts['non_compliant']} not compliant, {counts['errors']} failed; gate {counts['gate']}"], f"{path}/2-foot", "\n")
    if n == 1:
        detail = F.concat_ws("  ", F.lit("       "), F.col("party"), F.col("verdict"), F.col("remediation"))
        rows.where("error is null").orderBy(F.col("party") != "debtor").select(detail.alias("value")).coalesce(1).write.text(f"{path}/1-rows-detail")
    return counts
