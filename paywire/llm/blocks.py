"""Rows in blocks, in a bucketed table: what is found out about single rows comes to them, so whole rows never shuffle.

A block belongs to the place (the task) that packed it, and the table is bucketed by place, so that a task writes
all its blocks to one file.  Messages to blocks are joined by place, and within it by block: the number of buckets
is bounded, whatever the number of tasks and blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from paywire.llm.common import arrow_batches, bucket_count, bucketed, free_memory, saved

BLOCK_BYTES = 1 << 20  # a task holds a few copies of a block
MAX_ROWS = 20_000  # of whole rows; a batch more at most
PLACE_SHIFT = 20  # a place has fewer blocks than that many bits can number


def _halves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    if batch.num_rows > 1 and batch.nbytes > BLOCK_BYTES:
        half = batch.num_rows // 2
        yield from _halves(batch.slice(0, half))
        yield from _halves(batch.slice(half))
    else:
        yield batch


def blocks_of(rows: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """place, block, n, and each column of rows as an array; a block is a run of one task's rows, of about `BLOCK_BYTES` at most."""
    names = ["place", "block", "n", *rows.columns]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        block, held, n, size = TaskContext.get().partitionId() << PLACE_SHIFT, [], 0, 0

        def done() -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lists = [pa.ListArray.from_arrays(np.array([0, n], np.int32), c) for c in whole.columns]
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (block >> PLACE_SHIFT, block, n)] + lists, names)

        for batch in batches:
            for part in _halves(batch):
                held.append(part)
                n, size = n + part.num_rows, size + part.nbytes
                if n >= max_rows or size >= BLOCK_BYTES:
                    if n:
                        yield done()
                    block, held, n, size = block + 1, [], 0, 0
        if n:
            yield done()

    schema = StructType([*(StructField(x, LongType()) for x in names[:3]), *(StructField(f.name, ArrayType(f.dataType)) for f in rows.schema.fields)])
    with arrow_batches(rows.sparkSession, 1_000):
        return bucketed(rows.mapInArrow(packed, schema), "blocks", "place", bucket_count(rows))


def with_messages(blocks: DataFrame, messages: DataFrame, how: str = "inner") -> DataFrame:
    """The blocks (place, block, ..) with the columns of their messages (block, ..).

    Only the messages move.  The two ends of `block` are one equality, in a form that leaves `place` the only
    key of the join, which is what the table is bucketed by; blocks stream past the messages unsorted.
    """
    sent = messages.withColumnRenamed("block", "_to").withColumn("_place", F.shiftright("_to", PLACE_SHIFT))
    meet = (F.col("place") == F.col("_place")) & (F.col("block") <= F.col("_to")) & (F.col("block") >= F.col("_to"))
    return blocks.join(sent.hint("shuffle_hash"), meet, how).drop("_place", "_to")


def places(which: DataFrame) -> DataFrame:
    """block, places: the rows (block, pos) of each block; a block bounds them."""
    return saved(which.groupBy("block").agg(F.collect_list("pos").alias("places")), "places")


def rows_but(blocks: DataFrame, which: DataFrame) -> DataFrame:
    """The columns of the blocks' `row` structs, without the rows `which` (block, pos)."""
    both = with_messages(blocks.select("place", "block", "row"), places(which), "left")
    every = F.sequence(F.lit(0), F.size("row") - 1)
    left = F.when(F.col("places").isNull(), every).otherwise(F.array_except(every, "places"))  # by hash, so in proportion to the block
    return both.select(F.explode(F.transform(left, lambda pos: F.get("row", pos))).alias("row")).select("row.*")
