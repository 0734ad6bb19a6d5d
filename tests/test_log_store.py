"""Log sink, tail and split readers."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from paywire.sources import files, log, store


@pytest.fixture(autouse=True)
def known(spark):
    store.register(spark)


def written(spark, path, values, tasks=3, **options):
    rows = spark.createDataFrame([(v,) for v in values], "payload binary").repartition(tasks)
    rows.write.format("paywire_log").options(**options).mode("append").save(path)


def read(spark, path, **options):
    return spark.read.format("paywire_log").options(**options).load(path)


def test_write_and_read(spark, tmp_path):
    path = f"{tmp_path}/log"
    values = [bytes([i % 256]) * (i % 300) for i in range(500)]
    written(spark, path, values, segmentBytes=5000, syncEvery=7)
    written(spark, path, [b"", b"later"])
    got = read(spark, path)
    assert sorted(bytes(r["payload"]) for r in got.collect()) == sorted([*values, b"", b"later"])
    assert got.where("tail is not null").count() == 0
    segments = sorted(p.name for p in (tmp_path / "log").glob("*.log"))
    assert len(segments) > 10 and not list((tmp_path / "log/_staging").glob("*"))
    # the segments are plain logs, and offsets are what truncation takes
    plain = log.read_log(spark, f"{path}/*.log")
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["offset"], bytes(r["payload"]))
    assert sorted(map(key, plain.collect())) == sorted(map(key, got.collect()))


def test_split_reading_by_marks(spark, tmp_path):
    path = f"{tmp_path}/log"
    values = [f"{i} ".encode() * 20 for i in range(1000)]
    written(spark, path, values, tasks=1, markBytes=1000)
    many = read(spark, path, splitBytes=4000)
    assert many.rdd.getNumPartitions() > 10
    assert sorted(bytes(r["payload"]) for r in many.collect()) == sorted(values)


@pytest.mark.parametrize("bad", [None, b"x" * (log.MAX_PAYLOAD + 1)])
def test_a_failed_write_leaves_nothing(spark, tmp_path, bad):
    path = f"{tmp_path}/log"
    written(spark, path, [b"first"])
    with pytest.raises(Exception, match="takes no NULL"):
        written(spark, path, [b"a"] * 50 + [bad], tasks=4)
    assert [bytes(r["payload"]) for r in read(spark, path).collect()] == [b"first"]
    assert not list((tmp_path / "log/_staging").glob("*")) and len(list((tmp_path / "log").glob("*.log"))) == 1
    with pytest.raises(Exception, match="no column"):
        spark.range(1).write.format("paywire_log").mode("append").save(path)
    with pytest.raises(Exception, match="appended to"):
        spark.createDataFrame([(b"x",)], "payload binary").write.format("paywire_log").mode("overwrite").save(path)


def test_a_killed_task_leaves_nothing(spark, tmp_path):
    """A task that dies before it reports leaves its segment in the staging folder only, which goes when the write ends."""
    writer = store._Writer({"path": f"{tmp_path}/log"}, spark.createDataFrame([], "payload binary").schema)
    dead = store._Open(writer.stage, "dead")
    dead.append(b"half a seg")
    whole = store._Open(writer.stage, "whole")
    assert whole.append(b"one") == 8 and whole.append(b"two") == 8 + 8 + 3
    writer.publish([store.Segments([whole.close()]), None])
    assert [bytes(r["payload"]) for r in read(spark, f"{tmp_path}/log").collect()] == [b"one", b"two"]
    assert sorted(p.name for p in (tmp_path / "log").rglob("*") if p.is_file() and p.name[0] != ".") == ["00000000000000000001-000000.log", "00000000000000000001.json"]


def test_a_stream_writes_each_batch_once(spark, tmp_path):
    writer = lambda: store._StreamWriter({"path": f"{tmp_path}/log"}, spark.createDataFrame([], "payload binary").schema, "app")
    for batch in (0, 1, 1):  # the last one comes again after a restart
        w = writer()
        one = store._Open(w.stage, "s")
        one.append(str(batch).encode())
        w.commit([store.Segments([one.close()])], batch)
    assert sorted(bytes(r["payload"]) for r in read(spark, f"{tmp_path}/log").collect()) == [b"0", b"1"]
    spark.range(40).select(F.col("id").cast("string").cast("binary").alias("payload")).repartition(4).write.parquet(f"{tmp_path}/in")
    rows = spark.readStream.schema("payload binary").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):
        query = rows.writeStream.format("paywire_log").option("checkpointLocation", f"{tmp_path}/state").option("app", "other").trigger(availableNow=True).start(f"{tmp_path}/stream")
        assert query.awaitTermination(60)
    assert sorted(int(bytes(r["payload"])) for r in read(spark, f"{tmp_path}/stream").collect()) == list(range(40))
    assert len(list((tmp_path / "stream/_commits").glob("*.json"))) >= 4


def frame(payload, crc=None):
    return log.HEADER.pack(len(payload), zlib.crc32(payload) if crc is None else crc) + payload


class Tail:
    """A stream into a table, a run at a time."""

    def __init__(self, spark, tmp_path, **options):
        self.spark, self.at, self.options = spark, tmp_path, options
        self.rows = []

    def run(self):
        spark, at = self.spark, self.at
        rows = spark.readStream.format("paywire_log_tail").options(**self.options).load(f"{at}/logs")
        rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start(f"{at}/seen").awaitTermination()
        found = [(r["path"].rsplit("/", 1)[-1], r["offset"], bytes(r["payload"]) if r["payload"] is not None else None, r["tail"] and r["tail"]["kind"]) for r in spark.read.schema(log.RECORDS).parquet(f"{at}/seen").collect()]
        new = [r for r in found if r not in self.rows]
        assert len(found) == len(self.rows) + len(new)
        self.rows = found
        return sorted(new, key=str)


def test_tail_hands_each_record_out_once(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    a, b = tmp_path / "logs/a.log", tmp_path / "logs/b.log"
    tail = Tail(spark, tmp_path)
    a.write_bytes(log.MAGIC + frame(b"1") + frame(b"") + frame(b"three")[:-2])
    assert tail.run() == [("a.log", 17, b"", None), ("a.log", 25, None, "TruncatedPayload"), ("a.log", 8, b"1", None)]
    assert tail.run() == []  # a damaged tail is told once for each size
    with a.open("ab") as f:
        f.write(frame(b"three")[-2:] + frame(b"four"))
    b.write_bytes(log.MAGIC + frame(b"b") + b"\x01")
    assert tail.run() == [("a.log", 25, b"three", None), ("a.log", 38, b"four", None), ("b.log", 17, None, "TruncatedHeader"), ("b.log", 8, b"b", None)]
    with b.open("r+b") as f:
        f.seek(17)
        f.write(frame(b"wrong", 5))
    assert tail.run() == [("b.log", 17, None, "Checksum")]
    with b.open("ab") as f:
        f.write(frame(b"next"))
    assert tail.run() == [("b.log", 17, b"wrong", "Checksum"), ("b.log", 30, b"next", None)]


def test_tail_in_small_steps_and_of_a_store(spark, tmp_path):
    values = [f"r{i}".encode() for i in range(300)]
    written(spark, f"{tmp_path}/logs", values[:200])
    tail = Tail(spark, tmp_path, maxBytesPerTrigger=500)
    seen = []
    for k in range(40):
        if k == 5:
            written(spark, f"{tmp_path}/logs", values[200:])
        new = tail.run()
        seen += [r[2] for r in new]
        if k > 5 and not new:
            break
    assert sorted(seen) == sorted(values)


def damaged_logs():
    rnd = random.Random(2)
    body = [frame(rnd.randbytes(rnd.randrange(0, 60))) for _ in range(200)]
    whole = log.MAGIC + b"".join(body)
    wrong = bytearray(whole)
    at = 8 + sum(map(len, body[:120]))
    wrong[at + 4] ^= 255
    huge = log.MAGIC + b"".join(body[:50]) + log.HEADER.pack(log.MAX_PAYLOAD + 1, 0) + b"".join(body[50:])
    return {"whole": whole, "wrong": bytes(wrong), "huge": huge, "payload": whole[:-1], "header": whole + b"\1\2\3", "magic": b"nothing here", "short": b"WF", "none": log.MAGIC, "zero": b""}


@pytest.mark.parametrize("split", [2_000, 1 << 20])
def test_split_log_equals_the_whole(spark, tmp_path, split):
    for name, data in damaged_logs().items():
        (tmp_path / name).write_bytes(data)
    key = lambda r: (r["path"].rsplit("/", 1)[-1], r["offset"], r["payload"], r["tail"])
    want = sorted(map(key, log.read_log(spark, f"{tmp_path}/*").collect()), key=str)
    got = log.read_log_split(spark, f"{tmp_path}/*", split)
    assert sorted(map(key, got.collect()), key=str) == want
    assert {r[0]: r[3]["kind"] for r in want if r[3]} == {"wrong": "Checksum", "huge": "HeaderPayloadTooLarge", "payload": "TruncatedPayload", "header": "TruncatedHeader", "magic": "BadMagic", "short": "BadMagic"}  # Spark lists no empty file


def test_several_tasks_read_one_log(spark, tmp_path):
    (tmp_path / "one").write_bytes(log.MAGIC + b"".join(frame(bytes([i % 256]) * 5000) for i in range(1000)))
    got = log.read_log_split(spark, f"{tmp_path}/one", 500_000)
    assert got.groupBy(F.spark_partition_id()).count().count() >= 4 and got.count() == 1000


def random_trace(rnd):
    lines = []
    for _ in range(rnd.randrange(1, 40)):
        n = rnd.choice([0, 1, 5, 16, 17, 40])
        size = f"length={n}" if rnd.random() < 0.9 else ""
        lines += ["noise [buffer dump: length=3]"] * rnd.randrange(2) + [f"[buffer dump: x {size}]"]
        data = [f"{rnd.randrange(256):02X}" for _ in range(n)]
        for k in range(0, n, 16):
            lines += [""] * rnd.randrange(2) + [" ".join(data[k : k + 16]) + rnd.choice(["", "  gutter é"])]
        if rnd.random() < 0.3:
            lines.pop(rnd.randrange(len(lines)))
        if rnd.random() < 0.2:
            lines.append(rnd.choice(["[buffer dump end]", "zz", ""]))
    return "\n".join(lines) + rnd.choice(["", "\n"])


@pytest.mark.parametrize("seed", range(4))
def test_any_cut_of_a_trace_gives_the_same_dumps(tmp_path, seed):
    import pyarrow as pa

    rnd = random.Random(seed)
    for _ in range(20):
        data = random_trace(rnd).encode()
        frames, dropped = files.frames_of(data.decode())
        for size in (1, 3, 10, 37, 200, 10_000):
            got = [d for a in range(0, len(data), size) for d in files.dumps_between(pa.BufferReader(data), a, min(a + size, len(data)))]
            assert [f for _, f in got if f is not None] == frames and sum(f is None for _, f in got) == dropped
            assert all(data[at:].startswith(b"[buffer dump:") for at, _ in got) and len({at for at, _ in got}) == len(got)


def test_trace_source(spark, tmp_path):
    rnd = random.Random(9)
    texts = {f"t{i}.txt": random_trace(rnd) * 5 for i in range(3)}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "_hidden.txt").write_text("[buffer dump: length=1]\n00\n")
    got = spark.read.format("paywire_trace").option("splitBytes", 100).option("suffix", ".txt").load(str(tmp_path)).collect()
    for name, text in texts.items():
        frames, dropped = files.frames_of(text)
        mine = sorted((r for r in got if r["path"].endswith("/" + name)), key=lambda r: r["at"])
        assert [bytes(r["frame"]) for r in mine if r["frame"] is not None] == frames and sum(r["frame"] is None for r in mine) == dropped
    assert {r["path"].rsplit("/", 1)[-1] for r in got} == set(texts)


def test_append_in_segments(spark):
    """Many new records of a key make further logs, none larger than asked for by much; nothing is lost."""
    logs = spark.createDataFrame([("a", bytearray(log.MAGIC + frame(b"old"))), ("bad", bytearray(b"no log"))], "path string, content binary")
    more = spark.createDataFrame([("a", i, bytes([i % 256]) * 100) for i in range(300)] + [("bad", i, b"x" * 100) for i in range(100)] + [("new", 1, b"n")], "path string, o long, payload binary")
    got = log.appended(logs, more, segment_bytes=5000)
    rows = got.collect()
    assert sum(r["path"] == "a" for r in rows) == 7 and [(r["content"], r["offset"]) for r in rows if r["path"] == "bad"] == [(b"no log", None)]
    assert sorted(r["offset"] for r in rows if r["path"] == "a") == [8] * 6 + [19] and max(len(r["content"]) for r in rows) < 12_000
    read_back = log.explode_logs(got.where("path != 'bad'"))
    assert read_back.where("tail is not null").count() == 0 and read_back.count() == 302
