"""Best-fit packing of token pieces into fixed sequences, improved by swaps.

Documents are encoded once; only (piece, length) rows shuffle, dealt by hash
into groups of about `group_tokens` tokens.  A group starts from best fit on
falling lengths.  If that takes more bins than the tokens need, a local search goes
through the bins from the emptiest on and moves one or two pieces into another bin,
for none, one or two of its pieces, so that the sum of squared fills rises.  An
index from the room a bin can make to the least length that leaves for it finds the
largest step over all bins of the group.  The search ends when the tokens' bound is
met or no bin has a step left; bins that run empty go.

Defined results: a NULL or empty text is one piece that holds the end id; only a
document of more than `capacity` ids is cut, its first piece taking the
remainder; NULL or repeated ids are packed row by row; ids keep their type; an empty
table gives an empty result.  Rows are dealt to groups by their place in docs, so equal
rows don't meet in one; give a table, whose rows a repeated task reads in the same order.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from paywire.llm.common import arrow_batches, free_memory, saved

if TYPE_CHECKING:
    from paywire.llm.tokens import Encoder

PIECES = "piece int, start long, length long, ids binary"
BATCH_IDS = 250_000  # in an Arrow batch: 1 MB, which the worker and the JVM hold a few times


def _cut(batches: Iterator[pa.RecordBatch], enc: Encoder, end_id: int, capacity: int) -> Iterator[pa.RecordBatch]:
    """doc_id and PIECES of each row (id, text), in batches of about `BATCH_IDS` ids however long the texts are."""
    end = end_id.to_bytes(enc.width, "little")
    out, held = [], 0

    def done(key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = np.frombuffer(enc.encode(text.as_py()) + end, f"<u{enc.width}").astype("<u4")
            at, n = 0, len(ids) % capacity or capacity
            for piece in range(-(-len(ids) // capacity)):
                out.append((key, piece, at, n, ids[at : at + n].tobytes()))
                held += n
                at, n = at + n, capacity
                if held >= BATCH_IDS:
                    yield done(batch.schema.field(0).type)
                    out, held = [], 0
        if out:
            yield done(batch.schema.field(0).type)
            out, held = [], 0


def pieces(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """doc_id and PIECES of each document, the ids as little-endian unsigned 32-bit integers."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from paywire.llm.tokens import encoder

        free_memory(keep="tokens")
        yield from _cut(batches, encoder(vocabulary, special_as_text), end_id, capacity)
        free_memory(keep="tokens")  # an idle worker keeps its memo, not the batches' memory

    schema = StructType([StructField("doc_id", docs.schema[id_col].dataType), *StructType.fromDDL(PIECES).fields])
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(cut, schema)


def sums(lengths: Iterable[int]) -> list[int]:
    """0, each length and each sum of two of them, rising and without repeats."""
    once = twice = both = 0
    for n in lengths:
        twice |= once & (1 << n)
        once |= 1 << n
    rest = once
    while rest:
        low = rest & -rest
        n = low.bit_length() - 1
        rest ^= low
        both |= (rest | twice & low) << n
    every = 1 | once | both
    raw = np.frombuffer(every.to_bytes(every.bit_length() // 8 + 1, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


class Rooms:
    """Of bins with free space: the room that is there once up to two pieces leave, and the least length that must leave for it."""

    def __init__(self, bins: Bins):
        self.least = np.full(bins.capacity + 1, 1 << 62)
        self.lengths: list[list[int]] = [[] for _ in self.least]  # for each room, what may leave, sorted
        self.counts: dict[tuple[int, int], int] = {}
        self.sums: dict[int, tuple[int, list[int]]] = {}
        self.by_free: dict[int, set[int]] = {}
        for b in range(len(bins.items)):
            self.put(b, bins)

    def put(self, b: int, bins: Bins) -> None:
        free = bins.capacity - bins.fill[b]
        if not 0 < free < bins.capacity:
            return
        own = sums(bins.lengths[i] for i in bins.items[b])
        self.sums[b] = free, own
        self.by_free.setdefault(free, set()).add(b)
        for n in own:
            key = (free + n, n)
            self.counts[key] = self.counts.get(key, 0) + 1
            if self.counts[key] == 1:
                insort(self.lengths[free + n], n)
                self.least[free + n] = self.lengths[free + n][0]

    def drop(self, b: int) -> None:
        if b not in self.sums:
            return
        free, own = self.sums.pop(b)
        self.by_free[free].remove(b)
        for n in own:
            key = (free + n, n)
            self.counts[key] -= 1
            if not self.counts[key]:
                del self.counts[key]
                kept = self.lengths[free + n]
                del kept[bisect_left(kept, n)]
                self.least[free + n] = kept[0] if kept else 1 << 62

    def bin_with(self, free: int, n: int) -> int:
        def holds(b: int) -> bool:
            own = self.sums[b][1]
            at = bisect_left(own, n)
            return at < len(own) and own[at] == n

        return next(b for b in self.by_free[free] if holds(b))


class Bins:
    """Bins of one group; free space is kept sorted as (free, bin)."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.items: list[list[int]] = []
        self.fill: list[int] = []
        self.order: list[tuple[int, int]] = []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            self.place(i)

    def place(self, item: int) -> None:
        """Best fit: the fullest bin that has room, else a new one."""
        n = self.lengths[item]
        at = bisect_left(self.order, (n, -1))
        if at == len(self.order):
            self.items.append([item])
            self.fill.append(n)
            if n < self.capacity:
                insort(self.order, (self.capacity - n, len(self.items) - 1))
            return
        self.change(self.order[at][1], [], [item])

    def change(self, b: int, out: list[int], into: list[int]) -> None:
        free = self.capacity - self.fill[b]
        at = bisect_left(self.order, (free, b))
        if at < len(self.order) and self.order[at] == (free, b):
            del self.order[at]
        for i in out:
            self.items[b].remove(i)
        self.items[b] += into
        self.fill[b] += sum(self.lengths[i] for i in into) - sum(self.lengths[i] for i in out)
        if 0 < self.fill[b] < self.capacity:
            insort(self.order, (self.capacity - self.fill[b], b))

    def _step(self, victim: int, rooms: Rooms) -> bool:
        """The step that moves most length from the victim, which is not in rooms, into another bin and raises squared fill."""
        free = self.capacity - self.fill[victim]
        best = None
        for x in sums(self.lengths[i] for i in self.items[victim]):
            # the other bin is fuller afterwards than the victim was, which is when squared fill rises
            window = rooms.least[x : x + free]
            if x and len(window):
                room = int(window.argmin())
                if window[room] < x and (best is None or x - window[room] > best[0]):
                    best = (x - int(window[room]), x, x + room, int(window[room]))
        if best is None:
            return False
        _, x, room, less = best
        other = rooms.bin_with(room - less, less)
        out, into = (self._summing(b, n) for b, n in ((other, less), (victim, x)))
        rooms.drop(other)
        self.change(other, out, into)
        self.change(victim, into, out)
        rooms.put(other, self)
        return True

    def _summing(self, b: int, total: int) -> list[int]:
        """No, one or two items of a bin with these lengths together."""
        if not total:
            return []
        for i in self.items[b]:
            if self.lengths[i] == total:
                return [i]
        last: dict[int, int] = {}
        for i in self.items[b]:
            if total - self.lengths[i] in last:
                return [last[total - self.lengths[i]], i]
            last[self.lengths[i]] = i
        raise AssertionError("no such pieces")

    def improve(self) -> None:
        """Empty bins from the least full on, until the bound is met or no bin has a step left; each step looks at all bins of the group."""
        need = -(-sum(self.lengths) // self.capacity)
        count = sum(f > 0 for f in self.fill)
        if count <= need:
            return
        rooms = Rooms(self)
        steps, without = 0, {}  # steps so far, and how many there were when a bin last had none
        before = -1
        while before < steps:
            before = steps
            for victim in [b for _, b in reversed(self.order)]:
                if not 0 < self.fill[victim] < self.capacity or without.get(victim) == steps:
                    continue
                rooms.drop(victim)
                while self.fill[victim] and self._step(victim, rooms):
                    steps += 1
                without[victim] = steps
                rooms.put(victim, self)
                count -= not self.fill[victim]
                if count <= need:
                    return


def pack_lengths(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; bins are numbered from 0 without gaps."""
    bins = Bins(lengths, capacity)
    bins.improve()
    which, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for items in bins.items:
        at = 0
        for i in items:
            which[i], offset[i] = n, at
            at += lengths[i]
        n += bool(items)
    return which, offset


def assign(parts: DataFrame, n_groups: int, capacity: int = 2048) -> DataFrame:
    """parts (at least piece, length and what else should pass through, no ids) with sequence_id and offset.

    Full pieces need no partner, but go through their group as well, which keeps one path.
    """
    columns = parts.columns
    schema = StructType([*parts.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())])
    key = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n_groups))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, so one group is held at a time."""

        def done(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            which, offset = pack_lengths(rows.column("length").to_pylist(), capacity)
            group = rows.column("_group")[0].as_py()
            keep = [rows.column(c) for c in columns]
            return pa.RecordBatch.from_arrays([*keep, pa.array(which + (group << 32), pa.int64()), pa.array(offset, pa.int64())], [*columns, "sequence_id", "offset"])

        held, now = [], None
        for batch in batches:
            groups = batch.column("_group").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and groups[a] != now:
                    yield done(held)
                    held = []
                now = groups[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield done(held)

    dealt = parts.withColumn("_group", key).repartition(n_groups, "_group").sortWithinPartitions("_group", *(f"`{c}`" for c in columns))
    return dealt.mapInArrow(packed, schema)


def group_count(docs: DataFrame, text_col: str = "text", group_tokens: int = 8_000_000) -> int:
    """Groups for about `group_tokens` tokens each, taken from the bytes of all texts at 3 bytes a token."""
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    return max(1, round(total / 3 / group_tokens))


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = 8_000_000, special_as_text: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece."""
    cut = pieces(docs, vocabulary, end_id, capacity, id_col, text_col, special_as_text).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    with arrow_batches(docs.sparkSession, 1_000):
        cut = saved(cut, "pieces")  # lengths only; a lost executor doesn't cost the tokenizing
    return assign(cut, group_count(docs, text_col, group_tokens), capacity)


def sequences(docs: DataFrame, vocabulary: str, pad_id: int = 0, **how) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids (array of `capacity` ids, padded)."""
    capacity, text_col = how.get("capacity", 2048), how.get("text_col", "text")
    cut = pieces(docs, vocabulary, how.get("end_id", 0), capacity, how.get("id_col", "doc_id"), text_col)
    whole = assign(cut, group_count(docs, text_col), capacity)

    @F.pandas_udf("array<int>")
    def padded(blobs):
        return blobs.map(lambda b: np.pad(np.frombuffer(b, "<u4").astype(np.int32), (0, capacity - len(b) // 4), constant_values=pad_id))

    ordered = whole.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"]))
    return ordered.select("sequence_id", "n_tokens", padded(joined).alias("ids"))
