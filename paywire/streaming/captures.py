"""The conformance diff over a stream of captures.

The diff of a capture needs that capture alone, so it runs unchanged on a stream; the
roll-up to windows is a watermarked aggregate, and the state is one row a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywire.operators import conformance


def stream_diff(captures: DataFrame, keys: list[str], spec: conformance.MaskSpec, request: str = "request", legacy: str = "legacy", migrated: str = "migrated") -> DataFrame:
    """Field rows of each capture; keys should hold the event time for window_gate."""
    return conformance.check_wires(captures, keys, request, legacy, migrated, spec)


def window_gate(diff: DataFrame, time: str, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """start, fields, drifted, errors, gate by window of event time; captures later than `late` are left out by the watermark."""
    counts = diff.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("fields"), F.count_if(F.col("verdict") == conformance.DRIFT).alias("drifted"), F.count_if(F.col("verdict") == "error").alias("errors"))
    return counts.select(F.col("w.start").alias("start"), "fields", "drifted", "errors", F.when(F.col("errors") > 0, 2).when(F.col("drifted") > 0, 1).otherwise(0).alias("gate"))
