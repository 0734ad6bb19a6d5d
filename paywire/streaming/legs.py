"""Captures whose request, legacy and migrated responses arrive apart, put together by keyed state.

The state is one capture's legs, so it is bounded by a message's size and goes when the wait is over; a capture's
rows are the only ones that meet in a task.  A query that uses it needs the RocksDB state store
(`spark.sql.streaming.stateStore.providerClass`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from paywire.operators import conformance

LEGS = ("request", "legacy", "migrated")


class _Legs(StatefulProcessor):
    """Emits a capture once its legs are there; what came later than the wait after the first leg is missing.

    Of several rows for one leg the first counts, and legs that come again before the wait is over
    are dropped.
    """

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("legs", "request binary, legacy binary, migrated binary, has string")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        legs = dict(zip(LEGS, held[:3], strict=True)) if held else dict.fromkeys(LEGS)
        has = set(held[3].split(",")) - {""} if held else set()
        first = None
        for r in rows:
            first = r["_ms"] if first is None else min(first, r["_ms"])
            if r["leg"] in LEGS and r["leg"] not in has and "done" not in has:
                legs[r["leg"]] = r["wire"]
                has.add(r["leg"])
        if held is None:
            self.handle.registerTimer(max(first, timerValues.getCurrentWatermarkInMs()) + self.wait_ms)
        if has.issuperset(LEGS):
            yield Row(capture=key[0], **legs, missing=None)
            legs, has = dict.fromkeys(LEGS), {"done"}
        self.state.update((*(legs[x] for x in LEGS), ",".join(sorted(has))))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        *wires, has = self.state.get()
        self.state.clear()
        if "done" not in has.split(","):
            yield Row(capture=key[0], **dict(zip(LEGS, wires, strict=True)), missing=",".join(x for x in LEGS if x not in has.split(",")))

    def close(self) -> None:
        pass


def assembled(legs: DataFrame, key: str, leg: str, wire: str, time: str, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """capture, request, legacy, migrated, missing: a row a capture, whole, or after the wait with the names of its missing legs.

    legs: a stream of (key, leg, wire, event time); rows later than `late` may be dropped by the watermark.
    """
    rows = legs.select(F.col(key).cast("string").alias("capture"), F.col(leg).alias("leg"), F.col(wire).alias("wire"), F.col(time).alias("_time"), F.unix_millis(F.col(time)).alias("_ms")).withWatermark("_time", late)
    schema = StructType([StructField("capture", StringType()), *(StructField(x, BinaryType()) for x in LEGS), StructField("missing", StringType())])
    return rows.groupBy("capture").transformWithState(_Legs(1000 * _seconds(legs.sparkSession, wait)), schema, "Append", "EventTime")


def _seconds(spark: SparkSession, wait: str) -> int:
    start = "timestamp '2000-01-01 00:00:00 UTC'"
    return spark.sql(f"SELECT unix_seconds({start} + interval {wait}) - unix_seconds({start})").first()[0]


def diff_of_legs(legs: DataFrame, key: str, leg: str, wire: str, time: str, spec: conformance.MaskSpec, wait: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """capture, missing and the field rows of the conformance diff; a capture without all its legs is one row with the verdict `error`."""
    whole = assembled(legs, key, leg, wire, time, wait, late)
    return conformance.check_wires(whole, ["capture", "missing"], *LEGS, spec)
