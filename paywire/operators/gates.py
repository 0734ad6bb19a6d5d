"""Gates that count rows on their way to a sink, so that they need no scan of their own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Gate:
    """Counts of the rows that one action writes; `rule` turns them into the gate: 0, 1 or 2.

    Spark adds the counts up in the tasks of the stage in which the rows are watched.  Watch them behind the last shuffle, in
    the stage that writes: a stage before it may run again, and a range shuffle runs it once more to sample it.
    """

    def __init__(self, rule: Callable[[dict[str, int]], int]):
        self.rule, self.seen = rule, Observation()

    def watch(self, rows: DataFrame, **counts: Column) -> DataFrame:
        return rows.observe(self.seen, *(F.coalesce(c, F.lit(0)).cast("long").alias(k) for k, c in counts.items()))

    def result(self) -> dict[str, int]:
        """The counts and `gate`; waits for the action."""
        counts = dict(self.seen.get)
        return counts | {"gate": self.rule(counts)}

    def row(self, spark: SparkSession) -> DataFrame:
        """result() as a table of one row."""
        found = self.result()
        return spark.createDataFrame([tuple(found.values())], ", ".join(f"{k} {'int' if k == 'gate' else 'long'}" for k in found))
