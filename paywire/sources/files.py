"""File sources: XML folders, explicit lists, dump traces, and messages as JSON."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paywire.functions.bytesx import from_hex


def xml_folder(spark: SparkSession, path: str) -> DataFrame:
    """path, xml of the files of one folder that end in .xml, in any case."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][mM][lL]").option("recursiveFileLookup", "false").load(path)
    return files.select("path", F.decode("content", "UTF-8").alias("xml"))


def listed_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content, error; a file that can't be read has NULL content and its reason, and fails nothing.

    Each folder is listed once, however many of its files are asked for.  A file that goes between
    the listing and the read counts as not found.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    places = {p: hadoop.Path(p) for p in dict.fromkeys(paths)}
    folders: dict[str, dict[str, bool]] = {}  # of a folder: is each entry a file?
    full, error, there = {}, {}, []
    for p, place in places.items():
        store = place.getFileSystem(conf)
        whole = store.makeQualified(place)
        full[p] = whole.toString()
        parent = whole.getParent()
        if parent is None:
            error[p] = "is a folder"
            continue
        if (key := parent.toString()) not in folders:
            try:
                folders[key] = {s.getPath().getName(): s.isFile() for s in store.listStatus(parent)} if store.exists(parent) else {}
            except Py4JJavaError as bad:
                folders[key] = {"": False}
                error[key] = str(bad.java_exception.getMessage())
        kind = folders[key].get(whole.getName())
        if kind:
            there.append(p)
        else:
            error[p] = error.get(key) or ("not found" if kind is None else "is a folder")
    wanted = spark.createDataFrame([(p, full[p], error.get(p)) for p in paths], "path string, place string, error string")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    if not there:
        return wanted.select("path", F.lit(None).cast("binary").alias("content"), "error")
    found = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load([_escaped(p) for p in there]).select(plain(F.col("path")).alias("place"), "content")
    both = wanted.withColumn("place", plain(F.col("place"))).join(found, "place", "left")
    return both.select("path", "content", F.coalesce("error", F.when(F.col("content").isNull(), F.lit("not found"))).alias("error"))


def _escaped(path: str) -> str:
    """A path whose special characters stand for themselves; Spark's readers take patterns."""
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path)


def labelled_batch(spark: SparkSession, entries: list[tuple[str | None, str]]) -> DataFrame:
    """label, mx of an in-memory batch; a missing label is the entry's place from 1."""
    if not entries:
        raise ValueError("an empty batch")
    return spark.createDataFrame([(label or str(k), text) for k, (label, text) in enumerate(entries, 1)], "label string, mx string")


def json_message(text: Column) -> Column:
    """struct<mti, fields> of `{"mti": ..., "fields": {"n": "text" | "hex:.." | {"hex": ".."}}}`, ready to build.

    A value of another shape (a number, a list, an object with anything else), and hex that is none, is NULL, which
    building takes for an error; so is a type or a field number that is none.  Text that isn't such JSON has NULL for both.
    """
    whole = F.try_parse_json(text)
    mti = F.when(F.schema_of_variant(F.try_variant_get(whole, "$.mti", "variant")) == "STRING", F.try_variant_get(whole, "$.mti", "string"))

    def value(v: Column) -> Column:
        plain = F.try_variant_get(v, "$", "string")
        by_kind = F.when(F.schema_of_variant(v) == "OBJECT<hex: STRING>", from_hex(F.try_variant_get(v, "$.hex", "string")))
        as_text = F.when(plain.startswith("hex:"), from_hex(F.substring(plain, F.lit(5), F.length(plain)))).otherwise(F.encode(plain, "UTF-8"))
        return F.when(F.schema_of_variant(v) == "STRING", as_text).otherwise(by_kind)

    fields = F.try_variant_get(whole, "$.fields", "map<string,variant>")
    listed = F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].try_cast("int").alias("number"), value(e["value"]).alias("value")))
    return F.struct(mti.alias("mti"), listed.alias("fields"))


# The marks of a dump trace.
_HEAD, _LENGTH, _END = "[buffer dump:", re.compile(r"length=(\d+)"), "[buffer dump end]"
_PAIR = re.compile("[0-9A-Fa-f]{2}")


def _share(line: str, left: int) -> bytes | None:
    """What a line gives an open dump that lacks `left` bytes; None where it drops the dump."""
    words = [w for w in line.split(" ") if w]
    want = min(16, left)
    share = words[:want]
    if line.startswith(_END) or words and (len(share) < want or not all(_PAIR.fullmatch(w) for w in share)):
        return None
    return bytes.fromhex("".join(share))


def frames_of(text: str) -> tuple[list[bytes], int]:
    """Frames of a dump trace, and how many dumps were dropped.

    A header with a length opens a dump (one without, or with 0, is ignored); each
    line then gives its share of up to 16 hex pairs, and what follows on the line is a
    gutter.  A bad pair, a new header, an end mark or the end of the text drop an open dump.
    """
    frames, dropped, need, got = [], 0, 0, bytearray()
    for line in text.split("\n"):
        if line.startswith(_HEAD):
            size = _LENGTH.search(line)
            dropped += need > 0
            need, got = int(size[1]) if size else 0, bytearray()
            continue
        if not need:
            continue
        share = _share(line, need - len(got))
        if share is None:
            dropped, need = dropped + 1, 0
            continue
        got += share
        if len(got) == need:
            frames.append(bytes(got))
            need = 0
    return frames, dropped + (need > 0)


def dumps_between(f: BinaryIO, begin: int, end: int) -> Iterator[tuple[int, bytes | None]]:
    """(offset, frame) of each dump whose header line begins from `begin` up to `end`; None where it is dropped.

    The reader finds the first line that begins there and goes on until the last of these dumps is closed.
    """
    f.seek(max(0, begin - 1))
    lines = io.BufferedReader(_Raw(f), 1 << 20)
    at = begin
    if begin:
        at = begin - 1 + len(lines.readline())  # the rest of the line before, or the line feed itself
    opened, need, got = 0, 0, bytearray()
    while need or at < end:
        raw = lines.readline()
        if not raw:
            break
        here, at = at, at + len(raw)
        line = raw.removesuffix(b"\n").decode("utf-8", "replace")
        if line.startswith(_HEAD):
            if need:
                yield opened, None
            size = _LENGTH.search(line)
            opened, need, got = here, int(size[1]) if size and here < end else 0, bytearray()
            continue
        if not need:
            continue
        share = _share(line, need - len(got))
        if share is None:
            yield opened, None
            need = 0
            continue
        got += share
        if len(got) == need:
            yield opened, bytes(got)
            need = 0
    if need:
        yield opened, None


class _Raw(io.RawIOBase):
    """An Arrow file from where it stands, for Python's buffered reader."""

    def __init__(self, f: BinaryIO):
        self.f = f

    def readable(self) -> bool:
        return True

    def readinto(self, into: bytearray) -> int:
        found = self.f.read(len(into))
        into[: len(found)] = found
        return len(found)


def explode_traces(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, seq, frame, dropped: a row a frame; a file without frames has one row with NULL."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                frames, dropped = frames_of((data or b"").decode("utf-8", "replace"))
                n = max(1, len(frames))
                yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(range(n) if frames else [None], pa.int32()), pa.array(frames or [None], pa.binary()), pa.array([dropped] * n, pa.int32())], ["path", "seq", "frame", "dropped"])

    return files.select(F.col(path), F.col(content).cast("binary")).mapInArrow(read, "path string, seq int, frame binary, dropped int")
