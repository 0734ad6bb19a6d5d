"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A file is a set of shards in ascending document order.  Each shard is one
self-contained binary value: header, then boundaries and document ids, both rising
and both in Elias-Fano form with a rank directory, then the ids.  Shards are written by
Spark as a Parquet table with one row a shard, so that commits, retries and any
store that Spark knows work as for other tables; only the codes and the id array are
ours.  A shard's row says how many ids its part holds before it, so a reader adds
up one total a part and no shard moves.

Defined results: a NULL or empty text has no ids but the end id; an empty table
gives an empty file; rows of one document id stand next to each other, ordered by
their text's hash; NULL document ids come first and come back as NULL; further
columns are ignored.  Ids must be of an integer type, as the code stores their order.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

MAGIC = b"PWTOKEN2"
_HEADER = struct.Struct("<8sIIQQQqIII4x")  # magic, id width, low bits, documents, ids, NULL document ids, least document id, high words, low bits and high words of the document ids
_BLOCK = 16  # 64-bit words for each entry of the rank directory


class EliasFano:
    """A non-decreasing sequence of n values below `universe` + 1 in about n * (2 + log2(universe / n)) bits.

    select(i) reads the position of the i-th one of the high part: a rank
    directory entry every 1024 bits, then popcounts within that block.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.ranks = n, low_bits, low, high, ranks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        universe = int(values[-1]) if n else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        span = (universe >> low_bits) + n + 1
        high = np.zeros(-(-span // (64 * _BLOCK)) * 64 * _BLOCK, np.uint8)
        high[(values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(high, bitorder="little").view("<u8")
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little") if low_bits else np.zeros(0, np.uint8)
        return cls(n, low_bits, low, high, cls._directory(high))

    @staticmethod
    def _directory(high: np.ndarray) -> np.ndarray:
        each = np.bitwise_count(high).reshape(-1, _BLOCK).sum(1, dtype=np.int64)
        return (np.cumsum(each) - each).astype("<u4")

    def to_bytes(self) -> bytes:
        return self.high.tobytes() + self.ranks.tobytes() + self.low.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview, n: int, low_bits: int, words: int) -> tuple[EliasFano, int]:
        """The sequence and the bytes that it takes."""
        high = np.frombuffer(data, "<u8", words)
        ranks = np.frombuffer(data, "<u4", words // _BLOCK, 8 * words)
        at = 8 * words + 4 * (words // _BLOCK)
        low = np.frombuffer(data, np.uint8, -(-n * low_bits // 8), at)
        return cls(n, low_bits, low, high, ranks), at + len(low)

    def select(self, index: np.ndarray) -> np.ndarray:
        """The values at these indexes."""
        i = np.asarray(index, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        block = np.searchsorted(self.ranks, i, "right") - 1
        words = self.high.reshape(-1, _BLOCK)[block]
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        left = i - self.ranks[block]
        word = (upto <= left[:, None]).sum(1)
        rows = np.arange(len(i))
        left = left - np.where(word > 0, upto[rows, word - 1], 0)
        value, bit = words[rows, word].astype(np.uint64), np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            below = np.bitwise_count(value & np.uint64((1 << step) - 1)).astype(np.int64)
            right = left >= below
            left = np.where(right, left - below, left)
            value = np.where(right, value >> np.uint64(step), value & np.uint64((1 << step) - 1))
            bit += np.where(right, step, 0)
        high = (block * _BLOCK + word) * 64 + bit - i
        if not self.low_bits:
            return high
        bits = i[:, None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[bits >> 3] >> (bits & 7)) & 1).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return (high << self.low_bits) | low


def pack_shard(doc_ids: list[int | None], ids: list[bytes], width: int) -> bytes:
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    code = EliasFano.encode(ends)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    keys = EliasFano.encode(known.view(np.uint64) - np.int64(least).view(np.uint64))  # a difference of any two 64-bit ids fits without a sign
    head = _HEADER.pack(MAGIC, width, code.low_bits, len(ids), int(ends[-1]) if len(ends) else 0, len(ids) - len(known), least, len(code.high), keys.low_bits, len(keys.high))
    return b"".join([head, code.to_bytes(), keys.to_bytes(), *ids])


class Shard:
    """Random access to the documents of one packed shard."""

    def __init__(self, blob: bytes):
        data = memoryview(blob)
        magic, self.width, low_bits, self.n, self.n_ids, self.n_null, least, words, key_bits, key_words = _HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = _HEADER.size
        self.ends, used = EliasFano.from_bytes(data[at:], self.n, low_bits, words)
        at += used
        known = self.n - self.n_null
        keys, used = EliasFano.from_bytes(data[at:], known, key_bits, key_words)
        # NULL ids come first
        self.doc_ids = np.concatenate([np.zeros(self.n_null, np.int64), keys.select(np.arange(known)) + np.int64(least)])
        self.nulls = np.arange(self.n) < self.n_null
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + used)

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        ends = self.ends.select(np.arange(self.n))
        return np.concatenate([np.zeros(min(1, self.n), np.int64), ends[:-1]]), ends

    def document(self, i: int) -> np.ndarray:
        lo = int(self.ends.select(np.array([i - 1]))[0]) if i else 0
        return self.ids[lo : int(self.ends.select(np.array([i]))[0])]


SHARDS = "part int, seq int, before long, n_docs long, n_tokens long, blob binary"


def write_token_file(docs: DataFrame, path: str, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = 8 << 20, special_as_text: bool = False) -> None:
    """Encode `text_col` and write shards of about `shard_bytes` in ascending `id_col` order to `path`.

    The rows are dealt by range of (id, text hash), so that a repeated id does not
    land in one task; only then are they encoded, and the ids never shuffle.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from paywire.llm.tokens import encoder

        enc = encoder(vocabulary, special_as_text)
        end, part, seq, before = end_id.to_bytes(enc.width, "little"), TaskContext.get().partitionId(), 0, 0
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch:
            blob = pack_shard(keys, ids, enc.width)
            counts = [pa.array([x], pa.int64()) for x in (before, len(keys), held // enc.width)]
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *counts, pa.array([blob], pa.binary())], ["part", "seq", "before", "n_docs", "n_tokens", "blob"])

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(enc.encode(text.as_py()) + end)
                keys.append(key)
                held += len(ids[-1])
                if held >= shard_bytes:
                    yield flush()
                    keys, ids, held, seq, before = [], [], 0, seq + 1, before + held // enc.width
        if keys:
            yield flush()

    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be of an integer type, not {docs.schema[id_col].dataType.simpleString()}")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("k"), text.alias("t"), F.xxhash64(text).alias("h"))
    dealt = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    dealt.mapInArrow(shards, SHARDS).write.parquet(path)


def shard_starts(shards: DataFrame) -> DataFrame:
    """part and `start`, the ids in all parts before it: a row for each task that wrote."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    return parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("start"))


def read_token_file(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, read from its shard; with_ids adds the ids."""
    shards = spark.read.parquet(path)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                shard = Shard(blob.as_py())
                starts, ends = shard.bounds()
                cut = [shard.ids[a:b] for a, b in zip(starts, ends, strict=True)]
                columns = [pa.array(shard.doc_ids, pa.int64(), mask=shard.nulls), pa.array(starts + base, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in cut], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(shard.ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    starts = F.broadcast(shard_starts(shards))  # 12 bytes for each task that wrote
    return shards.join(starts, "part").select("blob", (F.col("start") + F.col("before")).alias("base")).mapInArrow(documents, schema)
