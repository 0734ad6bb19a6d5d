"""Append-only logs of CRC-framed records, read as a table.

A file is the 8-byte mark, then records: length and CRC-32 as little-endian 32-bit
numbers, then the payload.  A damaged tail becomes a row, not a failure.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paywire.sources.places import located

MAGIC = b"WFWAL\x00\x01\n"  # fixed value: the format's mark
HEADER = struct.Struct("<II")
HEADER_BYTES = HEADER.size
MAX_PAYLOAD = 16 << 20

RECORDS = "path string, offset long, payload binary, tail struct<kind:string,have:long,need:long>"
_TAIL = pa.struct([("kind", pa.string()), ("have", pa.int64()), ("need", pa.int64())])


def records(data: bytes) -> Iterator[tuple[int, bytes | None, dict | None]]:
    """(offset, payload, None) of each record, then (offset, None, tail) if the file ends badly."""
    tail = lambda at, kind, have, need: (at, None, {"kind": kind, "have": have, "need": need})
    if data[:8] != MAGIC:
        yield tail(0, "BadMagic", min(8, len(data)), 8)
        return
    at, end = 8, len(data)
    while at < end:
        if end - at < HEADER.size:
            yield tail(at, "TruncatedHeader", end - at, HEADER.size)
            return
        size, crc = HEADER.unpack_from(data, at)
        begin = at + HEADER.size
        if size > MAX_PAYLOAD:
            yield tail(at, "HeaderPayloadTooLarge", end - begin, size)
            return
        if end - begin < size:
            yield tail(at, "TruncatedPayload", end - begin, size)
            return
        payload = data[begin : begin + size]
        if zlib.crc32(payload) != crc:
            yield tail(at, "Checksum", size, size)
            return
        yield at, payload, None
        at = begin + size


def explode_logs(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """RECORDS of a table of whole files, such as spark.read.format("binaryFile")."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("tail", _TAIL)])
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                out, held = [], 0
                for at, payload, tail in records(data.as_py() or b""):
                    out.append({"path": name, "offset": at, "payload": payload, "tail": tail})
                    held += len(payload or b"")
                    if held > 32 << 20:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema)

    return files.select(F.col(path), F.col(content)).mapInArrow(read, RECORDS)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return explode_logs(spark.read.format("binaryFile").load(path))


BATCH = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("tail", _TAIL)])


def opened(path: str) -> BinaryIO:
    store, place = located(path)
    return store.open_input_file(place)


def hops(f: BinaryIO, at: int, end: int) -> Iterator[tuple[int, int, dict | None]]:
    """(offset, size of the payload, None) of each record from `at` on, by the headers alone; then (offset, 0, tail) if the file ends badly.

    Payloads are skipped and checksums not checked.
    """
    bad = lambda kind, have, need: (at, 0, {"kind": kind, "have": have, "need": need})
    if at < len(MAGIC):
        at = 0
        f.seek(0)
        if f.read(len(MAGIC)) != MAGIC:
            yield bad("BadMagic", min(len(MAGIC), end), len(MAGIC))
            return
        at = len(MAGIC)
    held, first = b"", at  # bytes read ahead, from `first` on
    while at < end:
        if end - at < HEADER.size:
            yield bad("TruncatedHeader", end - at, HEADER.size)
            return
        if at + HEADER.size > first + len(held):
            f.seek(at)
            held, first = f.read(min(1 << 16, end - at)), at
        size = HEADER.unpack_from(held, at - first)[0]
        begin = at + HEADER.size
        if size > MAX_PAYLOAD:
            yield bad("HeaderPayloadTooLarge", end - begin, size)
            return
        if end - begin < size:
            yield bad("TruncatedPayload", end - begin, size)
            return
        yield at, size, None
        at = begin + size


def checked(f: BinaryIO, at: int, stop: int) -> Iterator[tuple[int, bytes, dict | None]]:
    """(offset, payload, tail) of the whole records from `at` up to `stop`; tail where the checksum is wrong."""
    f.seek(at)
    held = b""
    while at < stop:
        if len(held) < HEADER.size:
            held += f.read(min(1 << 20, stop - at - len(held)))
        size, crc = HEADER.unpack_from(held)
        need = HEADER.size + size
        if len(held) < need:
            held += f.read(min(max(1 << 20, need - len(held)), stop - at - len(held)))
        payload = held[HEADER.size : need]
        yield at, payload, None if zlib.crc32(payload) == crc else {"kind": "Checksum", "have": size, "need": size}
        held, at = held[need:], at + need


def batches_of(path: str, rows: Iterator[tuple[int, bytes | None, dict | None]], batch_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """BATCH rows, about `batch_bytes` at a time."""
    out, size = [], 0
    for offset, payload, tail in rows:
        out.append({"path": path, "offset": offset, "payload": payload, "tail": tail})
        size += len(payload or b"") + 64
        if size >= batch_bytes:
            yield pa.RecordBatch.from_pylist(out, BATCH)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, BATCH)


_PIECES = "path string, begin long, end long, tail struct<kind:string,have:long,need:long>"


def log_pieces(files: DataFrame, split_bytes: int) -> DataFrame:
    """path, begin, end: runs of whole records of about `split_bytes` of each file (path, length), and its structural damage as a piece without bytes.

    A task goes through a file by its record headers and skips the payloads, which makes this sparse index in one pass.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces, begin, end = [], len(MAGIC), len(MAGIC)
                with opened(path) as f:
                    for at, size, tail in hops(f, 0, length):
                        if tail:
                            pieces.append((begin, at, None)) if at > begin else None
                            pieces.append((at, at, tail))
                            begin = end = at
                            break
                        end = at + HEADER_BYTES + size
                        if end - begin >= split_bytes:
                            pieces.append((begin, end, None))
                            begin = end
                if end > begin:
                    pieces.append((begin, end, None))
                columns = [pa.array([path] * len(pieces), pa.string()), *(pa.array([p[k] for p in pieces], pa.int64()) for k in (0, 1)), pa.array([p[2] for p in pieces], _TAIL)]
                yield pa.RecordBatch.from_arrays(columns, ["path", "begin", "end", "tail"])

    return files.select("path", "length").mapInArrow(cut, _PIECES)


def read_log_split(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """RECORDS as `read_log` has them, for logs too large for one task: a log is read in pieces, by as many tasks.

    First the pieces are found by the headers, then each piece's checksums are checked, then the records up to a
    file's first damage are handed out; only places move between the steps.  Addresses must be such that
    Arrow's file systems open them.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    total = files.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, min(-(-total // split_bytes), 100_000))
    pieces = log_pieces(files, split_bytes).repartition(tasks, "path", "begin")

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                bad = None
                if r["end"] > r["begin"]:
                    with opened(r["path"]) as f:
                        bad = next(((at, tail) for at, _, tail in checked(f, r["begin"], r["end"]) if tail), None)
                out.append(r | {"end": bad[0], "tail": bad[1]} if bad else r)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("tail", _TAIL)]))

    before = Window.partitionBy("path").orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    good = pieces.mapInArrow(sound, _PIECES).withColumn("bad", F.coalesce(F.max(F.col("tail").isNotNull()).over(before), F.lit(False))).where("not bad").drop("bad")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["end"] > r["begin"]:
                    with opened(r["path"]) as f:
                        yield from batches_of(r["path"], checked(f, r["begin"], r["end"]))
                if r["tail"]:
                    yield from batches_of(r["path"], iter([(r["end"], None, r["tail"])]))

    return good.repartition(tasks, "path", "begin").mapInArrow(read, RECORDS)


def framed(payload: F.Column) -> F.Column:
    """A record's bytes as an expression."""
    little = lambda n: F.unhex(F.concat(*(F.substring(F.lpad(F.hex(n), 8, "0"), k, 2) for k in (7, 5, 3, 1))))
    return F.concat(little(F.octet_length(payload).cast("long")), little(F.crc32(payload)), payload)


def appended(logs: DataFrame, more: DataFrame, key: str = "path", content: str = "content", order: str = "o", payload: str = "payload", segment_bytes: int = 64 << 20) -> DataFrame:
    """key, content, offset of logs with the records of `more` (key, order, payload) at their ends; offset: where the first new record stands.

    A key without a log gets a new one, and no key has two.  A log that does not begin with the format's mark, and one
    that would take a NULL or over-long payload, stays as it is, with offset NULL.  Where a key's new records are
    over `segment_bytes`, a hash deals them to several logs, the first of which is the key's own, so no row holds more; the
    records that a log takes stand in order.
    """
    mark = F.lit(bytearray(MAGIC))
    p = F.col(payload)
    fits = F.coalesce(F.octet_length(p) <= MAX_PAYLOAD, F.lit(False))
    size = F.coalesce(F.octet_length(p), F.lit(0)).cast("long") + HEADER.size
    rows = more.select(F.col(key).alias("_key"), F.col(order).alias("_o"), F.when(fits, framed(p)).alias("_r"), fits.alias("_fit"), size.alias("_n"))
    own = logs.select(F.col(key).alias("_log"), F.col(content).alias("_old"), (F.substring(content, 1, 8) == mark).alias("_sound"))
    keys = rows.groupBy("_key").agg(F.ceil(F.sum("_n") / segment_bytes).alias("_k"), F.min("_fit").alias("_fits")).withColumnRenamed("_key", "_of")
    keys = keys.join(own.drop("_old"), F.col("_of") == F.col("_log"), "left").select("_of", "_k", (F.col("_fits") & F.coalesce("_sound", F.lit(True))).alias("_fits"))
    dealt = rows.join(keys, F.col("_key").eqNullSafe(F.col("_of"))).withColumn("_segment", F.when(F.col("_fits"), F.pmod(F.xxhash64("_o", "_r"), F.col("_k"))).otherwise(F.lit(0)))
    new = dealt.groupBy("_key", "_segment").agg(F.array_sort(F.collect_list(F.when(F.col("_fits"), F.struct(F.col("_o").alias("o"), F.col("_r").alias("r"))))).alias("_rs"), F.min("_fits").alias("_fits"))
    both = own.join(new, (F.col("_log") == F.col("_key")) & (F.col("_segment") == 0), "full_outer")
    old = F.coalesce("_old", mark)
    body = F.unhex(F.array_join(F.transform("_rs", lambda x: F.hex(x["r"])), ""))
    done = F.coalesce("_fits", F.lit(False))
    return both.select(F.coalesce("_log", "_key").alias(key), F.when(done, F.concat(old, body)).otherwise(F.col("_old")).alias(content), F.when(done, F.octet_length(old).cast("long")).alias("offset"))


def truncated(logs: DataFrame, at: F.Column, content: str = "content") -> DataFrame:
    """logs cut to `at` bytes, such as the offset of a damaged tail; never inside the mark, and a place past the end changes nothing."""
    keep = F.greatest(at, F.lit(len(MAGIC)))
    return logs.withColumn(content, F.when(keep < F.octet_length(content), F.substring(F.col(content), F.lit(1), keep.cast("int"))).otherwise(F.col(content)))


def log_files(df: DataFrame, file_key: str, order: str, payload: str, segment_bytes: int = 4 << 20) -> DataFrame:
    """path, segment, latest, content: logs of about `segment_bytes` a key, records in order in each; a payload over the limit makes its log's content NULL.

    A key's number of logs follows its bytes, and a hash of the record tells which of them takes it, so a log
    stays of one size however large the key.  `latest`: the log holds the key's greatest order value.
    """
    size = F.coalesce(F.octet_length("p"), F.lit(0)).cast("long") + HEADER.size
    rows = df.select(F.col(file_key).cast("string").alias("path"), F.col(order).alias("o"), F.col(payload).alias("p"))
    keys = rows.groupBy(F.col("path").alias("key")).agg(F.ceil(F.sum(size) / segment_bytes).alias("k"), F.max("o").alias("end"))
    dealt = rows.join(keys, F.col("path").eqNullSafe(F.col("key"))).withColumn("segment", F.pmod(F.xxhash64("o", "p"), F.col("k")))
    logs = dealt.groupBy("path", "segment").agg(
        F.array_sort(F.collect_list(F.struct("o", framed(F.col("p")).alias("r")))).alias("rs"),
        F.max(F.octet_length("p")).alias("most"),
        F.count_if(F.col("p").isNull()).alias("none"),
        F.max("o").eqNullSafe(F.max("end")).alias("latest"),
    )
    body = F.concat(F.lit(bytearray(MAGIC)), F.unhex(F.array_join(F.transform("rs", lambda x: F.hex(x["r"])), "")))
    return logs.select("path", "segment", "latest", F.when((F.col("most") <= MAX_PAYLOAD) & (F.col("none") == 0), body).alias("content"))
