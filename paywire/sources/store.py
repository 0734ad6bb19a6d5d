"""Logs and traces as Spark data sources.

`paywire_log` is a folder of log segments with a list of what is committed:

    <folder>/_commits/<number>.json    segments of one write: name, bytes, records, marks
    <folder>/<number>-<k>.log          a segment in the log format
    <folder>/_staging/<write>/         segments that are still being written

Each task of a write appends to segments of its own in the staging folder and syncs them before it
reports them; `commit` moves them in place and then publishes them all at once by one list, `abort`
removes them.  A killed or repeated task leaves nothing in the log: what isn't reported goes with the
staging folder.  Marks are offsets of records every megabyte or so, so a reader cuts large segments between tasks.

`paywire_log_tail` follows a log, or a folder of logs that others append to, as a stream.
`paywire_trace` reads dump traces, large ones by several tasks.

All of them open files by Arrow's file systems.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from paywire.sources import files, log
from paywire.sources.places import listed, located

MARK_BYTES = 1 << 20


def register(spark: SparkSession) -> None:
    """Make the sources known to a session by their names."""
    for source in (LogStore, LogTail, Traces):
        spark.dataSource.register(source)


@dataclass
class Segment:
    name: str
    bytes: int = 0
    records: int = 0
    marks: list[int] = field(default_factory=list)


@dataclass
class Segments(WriterCommitMessage):
    segments: list[Segment]


class _Open:
    """A segment that is being written, in a folder of the staging area."""

    def __init__(self, folder: str, name: str, mark_bytes: int = MARK_BYTES):
        store, place = located(folder)
        store.create_dir(place, recursive=True)
        self.path, self.store = f"{place}/{name}", store
        self.local = isinstance(store, fs.LocalFileSystem)
        self.file = open(self.path, "wb") if self.local else store.open_output_stream(self.path)  # noqa: SIM115
        self.file.write(log.MAGIC)
        self.segment, self.mark_bytes = Segment(name, len(log.MAGIC), 0, [len(log.MAGIC)]), mark_bytes

    def append(self, payload: bytes | None) -> int:
        """The offset of the record; it isn't durable before the next sync."""
        if payload is None or len(payload) > log.MAX_PAYLOAD:
            raise ValueError(f"a log takes no NULL and no payload over {log.MAX_PAYLOAD} bytes")
        s = self.segment
        at = s.bytes
        if at - s.marks[-1] >= self.mark_bytes:
            s.marks.append(at)
        self.file.write(log.HEADER.pack(len(payload), zlib.crc32(payload)) + payload)  # one write a record
        s.bytes += log.HEADER.size + len(payload)
        s.records += 1
        return at

    def sync(self) -> None:
        self.file.flush()
        if self.local:
            os.fsync(self.file.fileno())

    def close(self) -> Segment:
        self.sync()
        self.file.close()  # elsewhere than on a local disk a file is durable once it is closed
        return self.segment


class _Writer:
    """Shared by batch and stream: options path, column (`payload`), segmentBytes, syncEvery (records; 0: at a segment's end), markBytes."""

    def __init__(self, options: dict[str, str], schema: StructType, app: str | None = None):
        self.root, self.column = options["path"].rstrip("/"), options.get("column", "payload")
        if self.column not in schema.names:
            raise ValueError(f"no column {self.column!r} to append")
        self.most, self.every = int(options.get("segmentbytes", 128 << 20)), int(options.get("syncevery", 0))
        self.mark_bytes = int(options.get("markbytes", MARK_BYTES))
        self.stage, self.app = f"{self.root}/_staging/{f'app-{app}' if app else uuid.uuid4().hex}", app  # of a stream Spark makes several writers

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Segments:
        task, done, now = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}", [], None
        for batch in iterator:
            for payload in batch.column(batch.schema.get_field_index(self.column)):
                if now is None:
                    now = _Open(self.stage, f"{task}-{len(done)}", self.mark_bytes)
                now.append(payload.as_py())
                if self.every and now.segment.records % self.every == 0:
                    now.sync()
                if now.segment.bytes >= self.most:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        return Segments(done)

    def publish(self, messages: list[Segments | None], batch: int | None = None) -> None:
        store, root = located(self.root)
        store.create_dir(f"{root}/_commits", recursive=True)
        known = _commits(self.root)
        if batch is not None and any((c.get("app"), c.get("batch")) == (self.app, batch) for _, c in known):
            self.remove()  # published before a restart
            return
        staged = [s for m in messages if m for s in m.segments]
        number = known[-1][0] + 1 if known else 1
        number = self._reserved(store, root, number)
        out = []
        for k, s in enumerate(staged):
            name = f"{number:020d}-{k:06d}.log"
            store.move(f"{located(self.stage)[1]}/{s.name}", f"{root}/{name}")
            out.append({"name": name, "bytes": s.bytes, "records": s.records, "marks": s.marks})
        text = json.dumps({"segments": out} | ({"app": self.app, "batch": batch} if batch is not None else {}))
        temporary = f"{root}/_commits/.{number:020d}-{uuid.uuid4().hex}"
        with store.open_output_stream(temporary) as f:
            f.write(text.encode())
        store.move(temporary, f"{root}/_commits/{number:020d}.json")
        self.remove()

    @staticmethod
    def _reserved(store: fs.FileSystem, root: str, number: int) -> int:
        """A commit's number.  On a local disk several writers may publish at once; elsewhere one at a time."""
        while isinstance(store, fs.LocalFileSystem):
            try:
                os.close(os.open(f"{root}/_commits/.{number:020d}.taken", os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                number += 1
        return number

    def remove(self) -> None:
        store, place = located(self.stage)
        if store.get_file_info(place).type != fs.FileType.NotFound:
            store.delete_dir(place)


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Segments | None]) -> None:
        self.publish(messages)

    def abort(self, messages: list[Segments | None]) -> None:
        self.remove()


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Segments | None], batchId: int) -> None:
        self.publish(messages, batchId)

    def abort(self, messages: list[Segments | None], batchId: int) -> None:
        self.remove()


def _commits(root: str) -> list[tuple[int, dict]]:
    store, _ = located(root)
    out = []
    for f in listed(f"{root}/_commits", ".json"):
        with store.open_input_stream(f.path) as stream:
            out.append((int(f.base_name[:20]), json.loads(stream.read())))
    return out


@dataclass
class Piece(InputPartition):
    path: str
    begin: int
    end: int
    tail: dict | None = None


def _read(piece: Piece) -> Iterator[pa.RecordBatch]:
    if piece.end > piece.begin:
        with log.opened(piece.path) as f:
            yield from log.batches_of(piece.path, log.checked(f, piece.begin, piece.end))
    if piece.tail:
        yield from log.batches_of(piece.path, iter([(piece.end, None, piece.tail)]))


class _StoreReader(DataSourceReader):
    """Committed segments, cut at their marks.  A record with a wrong checksum comes with its payload and a tail."""

    def __init__(self, options: dict[str, str]):
        self.root, self.split = options["path"].rstrip("/"), int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[Piece]:
        out = []
        for _, c in _commits(self.root):
            for s in c["segments"]:
                begin = len(log.MAGIC)
                for mark in [*s["marks"], s["bytes"]]:
                    if mark - begin >= self.split or mark == s["bytes"] and mark > begin:
                        out.append(Piece(f"{self.root}/{s['name']}", begin, mark))
                        begin = mark
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition)


class LogStore(DataSource):
    """Options: path; splitBytes to read; column, segmentBytes, syncEvery, markBytes to write; app names a stream that writes."""

    @classmethod
    def name(cls) -> str:
        return "paywire_log"

    def schema(self) -> str:
        return log.RECORDS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _StoreReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a log is appended to; use mode('append')")
        return _BatchWriter(dict(self.options), schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return _StreamWriter(dict(self.options), schema, self.options.get("app", "stream"))


class _TailReader(DataSourceStreamReader):
    """Offsets are {file: [offset, size]}: records before the offset are handed out; size: the file's when its damaged tail was last told, else 0."""

    def __init__(self, options: dict[str, str]):
        self.path, self.most = options["path"].rstrip("/"), int(options.get("maxbytespertrigger", 64 << 20))
        self.known: dict[str, list[int]] = {}
        self.tails: dict[str, dict] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def _files(self) -> list[tuple[str, int]]:
        commits = _commits(self.path)
        if commits:
            return [(f"{located(self.path)[1]}/{s['name']}", s["bytes"]) for _, c in commits for s in c["segments"]]
        return [(f.path, f.size) for f in listed(self.path, ".log")]

    def latestOffset(self) -> dict:  # noqa: N802
        """Goes through new records by their headers, at most `maxBytesPerTrigger` of a file, and checks the last one's sum."""
        store, _ = located(self.path)
        for path, size in self._files():
            at, told = self.known.get(path, [0, 0])
            if size <= max(at, told):
                continue
            tail, last = None, None
            with store.open_input_file(path) as f:
                start = at
                for offset, length, bad in log.hops(f, at, size):
                    if bad:
                        tail = bad
                        break
                    last, at = offset, offset + log.HEADER.size + length
                    if at - start >= self.most:
                        break
                if last is not None and at == size and (wrong := next(log.checked(f, last, at))[2]):
                    tail, at = wrong, last
            self.known[path] = [at, size if tail else 0]
            if tail:
                self.tails[path] = tail
        return {path: list(x) for path, x in self.known.items()}

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.known = {path: list(x) for path, x in end.items()} | self.known
        out = []
        for path, (at, told) in sorted(end.items()):
            before, said = start.get(path, [0, 0])
            tail = self._tail(path, at, told) if told and told != said else None
            if at > before or tail:
                out.append(Piece(path, min(max(before, len(log.MAGIC)), at), at, tail))
        return out

    def _tail(self, path: str, at: int, size: int) -> dict | None:
        """What is wrong behind an offset, as the file stood at that size; found again after a restart."""
        if path not in self.tails:
            store, _ = located(path)
            with store.open_input_file(path) as f:
                _, length, bad = next(log.hops(f, at, size))
                self.tails[path] = bad or next(log.checked(f, at, at + log.HEADER.size + length))[2]
        return self.tails[path]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        return _read(partition)

    def commit(self, end: dict) -> None:
        pass


class LogTail(DataSource):
    """A stream of RECORDS from a log, a folder of `.log` files, or a `paywire_log` folder.  Options: path, maxBytesPerTrigger.

    Each whole record comes once.  A file that ends in a damaged record gives one row with its tail for each size it is
    seen with, and its offset stays before the damage until the record is complete.  A wrong checksum with records
    behind it is a row with payload and tail, and the stream goes on.
    """

    @classmethod
    def name(cls) -> str:
        return "paywire_log_tail"

    def schema(self) -> str:
        return log.RECORDS

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _TailReader(dict(self.options))


class _TraceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.suffix = options["path"].rstrip("/"), int(options.get("splitbytes", 64 << 20)), options.get("suffix", "")

    def partitions(self) -> list[Piece]:
        return [Piece(f.path, a, min(a + self.split, f.size)) for f in listed(self.path, self.suffix) for a in range(0, f.size, self.split)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("at", pa.int64()), ("frame", pa.binary())])
        store, _ = located(self.path)
        out, size = [], 0
        with store.open_input_file(partition.path) as f:
            for at, frame in files.dumps_between(f, partition.begin, partition.end):
                out.append({"path": partition.path, "at": at, "frame": frame})
                size += len(frame or b"") + 64
                if size >= 4 << 20:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


class Traces(DataSource):
    """path, at, frame: a row for each dump of a trace file or of a folder's, frame NULL where it was dropped; at: where its header stands.

    Options: path, suffix, splitBytes.  A part of a file owns the dumps whose headers begin in it, so any cut gives the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return "paywire_trace"

    def schema(self) -> str:
        return "path string, at long, frame binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _TraceReader(dict(self.options))
