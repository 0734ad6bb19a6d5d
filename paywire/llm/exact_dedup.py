"""Exact dedup by two passes over a Bloom filter that is dealt over the cluster.

Rows are written once in blocks, with a digest each.  The filter is cut into ranges
of at most `max_filter_bytes` at `bits_per_row`; a digest's first word picks its range,
the next two its four bits there.  Pass 1: blocks send a range the bits that their
rows set, marking those that two rows of one block set; the task that owns a range
finds the bits set twice and answers with one bit for each that was sent.  Pass 2: a row that misses
such a bit is surely alone and passes straight through; the others, true repeats and a
few false positives, shuffle by digest and are grouped exactly.

Only bits, and digests and ids of rows that may repeat, ever shuffle; texts never do, as
blocks are bucketed and what comes back meets them where they are.  No part of the
filter reaches the driver, so any number of rows takes this one path.  A repeated text
counts once a block, so one text in a third of all rows loads no range.

Defined results: NULL counts as the empty text; texts are equal when they are
after each run of ASCII white space is replaced by one space; of equal texts the
smallest id in the id's own order stays (NULL ids last), of rows with the same id and
text the one written first; an empty table gives an empty result; other columns pass
through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywire.llm.blocks import blocks_of, rows_but, with_messages
from paywire.llm.common import free_memory, saved

PROBES = 4
GROUP_ROWS = 500_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


class Filter:
    """How the filter is cut: `ranges` of `bits` bits each."""

    def __init__(self, n_rows: int, bits_per_row: int, max_filter_bytes: int):
        total = max(1, n_rows) * bits_per_row
        self.ranges = max(8, -(-total // (8 * max_filter_bytes)))
        self.bits = max(64, -(-total // self.ranges))

    def probes(self, digests: pa.Array) -> np.ndarray:
        """Four positions a row, range by range: [rows, PROBES]."""
        if not len(digests):
            return np.zeros((0, PROBES), np.int64)
        words = np.frombuffer(b"".join(digests.to_pylist()), "<u8").reshape(-1, 4)
        halves = words[:, 1:3].copy().view("<u4").astype(np.int64)
        return (words[:, :1] % np.uint64(self.ranges)).astype(np.int64) * self.bits + halves % self.bits


def messages_to_ranges(blocks: DataFrame, how: Filter, group_rows: int = GROUP_ROWS) -> DataFrame:
    """range, group, blocks, lens, bits, twice: the bits that a group of blocks sets in a range.

    A group is a run of one task's blocks of at least `group_rows` rows, if it has so many, so that messages
    stay few however many ranges there are.  bits: block after block, in order within each; lens: how many
    each block has; twice: a bit for each, set where two rows of the block set it; blocks: their numbers, in
    the group's first message only.
    """

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free_memory()
        held, rows = [], 0  # block, bits set, how often

        def done() -> pa.RecordBatch:
            where = np.concatenate([x[1] for x in held])
            often = np.concatenate([x[2] for x in held])
            block = np.repeat(np.arange(len(held)), [len(x[1]) for x in held])
            order = np.argsort(where // how.bits, kind="stable")
            where, often, block = where[order], often[order] > 1, block[order]
            owner, at = where // how.bits, (where % how.bits).astype("<u4")
            cuts = np.flatnonzero(np.diff(owner, prepend=-1)).tolist()
            parts = [slice(a, b) for a, b in zip(cuts, [*cuts[1:], len(where)], strict=True)]
            numbers = np.array([x[0] for x in held], "<i8").tobytes()
            columns = [
                pa.array(owner[cuts], pa.int64()),
                pa.array([held[0][0]] * len(parts), pa.int64()),
                pa.array([b"" if k else numbers for k in range(len(parts))], pa.binary()),
                pa.array([np.bincount(block[p], minlength=len(held)).astype("<u4").tobytes() for p in parts], pa.binary()),
                pa.array([at[p].tobytes() for p in parts], pa.binary()),
                pa.array([np.packbits(often[p]).tobytes() for p in parts], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["range", "group", "blocks", "lens", "bits", "twice"])

        for batch in batches:
            for block, digests in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                held.append((block, *np.unique(how.probes(digests.values), return_counts=True)))
                rows += len(digests)
                if rows >= group_rows:
                    yield done()
                    held, rows = [], 0
        if held:
            yield done()

    return blocks.select("block", "digest").mapInArrow(sent, "range long, group long, blocks binary, lens binary, bits binary, twice binary")


def _bits_set_twice(blocks: DataFrame, how: Filter) -> DataFrame:
    """block, mask: a bit for each of the positions that its rows set, in order, set where several rows of the table set it."""

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # group, blocks, lens, bits, twice

        def done() -> Iterator[pa.RecordBatch]:
            each = [np.frombuffer(x[3], "<u4") for x in held]
            order = np.sort(np.concatenate(each))
            again = np.zeros(how.bits, bool)
            again[order[1:][order[1:] == order[:-1]]] = True
            for x, at in zip(held, each, strict=True):
                again[at[np.unpackbits(np.frombuffer(x[4], np.uint8), count=len(at)).view(bool)]] = True
            for k in range(0, len(held), 1000):
                some = range(k, min(k + 1000, len(held)))
                masks = [np.packbits(again[each[i]]).tobytes() for i in some]
                columns = [pa.array([held[i][0] for i in some], pa.int64()), pa.array([now] * len(some), pa.int64()), *(pa.array([held[i][c] for i in some], pa.binary()) for c in (1, 2)), pa.array(masks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["group", "range", "blocks", "lens", "mask"])

        for batch in batches:
            for owner, *message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and owner != now:
                    yield from done()
                    held = []
                now = owner
                held.append(message)
        if held:
            yield from done()

    def by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []  # blocks, lens, mask

        def done() -> pa.RecordBatch:
            numbers = np.frombuffer(b"".join(x[0] for x in held), "<i8")
            lens = [np.frombuffer(x[1], "<u4") for x in held]
            bits = np.concatenate([np.unpackbits(np.frombuffer(x[2], np.uint8), count=int(n.sum())) for x, n in zip(held, lens, strict=True)])
            block = np.concatenate([np.repeat(np.arange(len(numbers)), n) for n in lens])
            bits = bits[np.argsort(block, kind="stable")]
            ends = np.cumsum(sum(lens))
            return pa.RecordBatch.from_arrays([pa.array(numbers), pa.array([np.packbits(x).tobytes() for x in np.split(bits, ends[:-1])], pa.binary())], ["block", "mask"])

        for batch in batches:
            for group, _, *message in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and group != now:
                    yield done()
                    held = []
                now = group
                held.append(message)
        if held:
            yield done()

    owned = messages_to_ranges(blocks, how).repartition(how.ranges, "range").sortWithinPartitions("range")
    answers = owned.mapInArrow(answered, "group long, range long, blocks binary, lens binary, mask binary")
    return saved(answers.repartition("group").sortWithinPartitions("group", "range").mapInArrow(by_block, "block long, mask binary"), "twice")


def possibly_repeated(blocks: DataFrame, bits_per_row: int = 16, max_filter_bytes: int = 8 << 20) -> DataFrame:
    """block, pos, id, digest and a boolean `maybe` of each row of the blocks."""
    how = Filter(blocks.agg(F.sum("n")).first()[0] or 0, bits_per_row, max_filter_bytes)

    @F.arrow_udf("array<boolean>")
    def probe(digests: pa.Array, masks: pa.Array) -> pa.Array:
        out = []
        for d, mask in zip(digests, masks, strict=True):
            at = how.probes(d.values)
            places, inverse = np.unique(at, return_inverse=True)
            hit = np.unpackbits(np.frombuffer(mask.as_py(), np.uint8), count=len(places))[inverse.reshape(at.shape)]
            out.append(hit.all(1).tolist())
        return pa.array(out, pa.list_(pa.bool_()))

    rows = with_messages(blocks.select("place", "block", "id", "digest"), _bits_set_twice(blocks, how))
    each = rows.select("block", F.posexplode(F.arrays_zip("id", "digest", probe("digest", "mask").alias("maybe"))).alias("pos", "x"))
    return each.select("block", "pos", F.col("x.id").alias("id"), F.col("x.digest").alias("digest"), F.col("x.maybe").alias("maybe"))


def _repeated(marked: DataFrame) -> DataFrame:
    """digest, first (none, id, block, pos) and group_size of each digest that several rows have.

    Written, so that a join with it stands alone and adaptive execution can split a hot digest.
    """
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "block", "pos")).alias("first")
    return saved(marked.where("maybe").groupBy("digest").agg(first, F.count("*").alias("group_size")).where("group_size > 1"), "digest-groups")


def duplicate_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """One row a document: doc_id, keep_id, group_size, kept, text_sha256."""
    blocks = blocks_of(docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest")), 250_000)
    marked = possibly_repeated(blocks, **bounds)
    groups = _repeated(marked)
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    one = F.lit(1).cast("long")
    straight = marked.where("not maybe").select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), one.alias("group_size"), F.lit(True).alias("kept"), sha)
    grouped = (
        marked.where("maybe")
        .join(groups, "digest", "left")
        .select(
            F.col("id").alias("doc_id"),
            F.when(F.col("first").isNull(), F.col("id")).otherwise(F.col("first.id")).alias("keep_id"),
            F.coalesce("group_size", one).alias("group_size"),
            F.coalesce((F.col("block") == F.col("first.block")) & (F.col("pos") == F.col("first.pos")), F.lit(True)).alias("kept"),
            sha,
        )
    )
    return straight.unionByName(grouped)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **bounds) -> DataFrame:
    """The rows that stay, with all columns of docs.  Only the places of rows to drop go back to the blocks."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    blocks = blocks_of(docs.select(F.col(f"`{id_col}`").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), whole))
    marked = possibly_repeated(blocks, **bounds)
    repeats = marked.where("maybe").join(_repeated(marked), "digest").where("block != first.block or pos != first.pos")
    return rows_but(blocks, repeats.select("block", "pos"))
