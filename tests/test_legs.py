"""Three legs that arrive apart."""

import random

from pyspark.sql import functions as F

from paywire.operators import conformance as conf
from paywire.operators import iso8583 as iso
from paywire.streaming import legs

SPEC = conf.MaskSpec("x", (conf.Mask(11, "volatile"),))


def wires(spark, n):
    rows = spark.range(n).select(F.col("id").cast("string").alias("capture"), F.col("id").alias("i"))
    field = lambda c: F.array(F.struct(F.lit(3).alias("number"), F.encode(c, "US-ASCII").alias("value")))
    old, new = F.lpad(F.col("i").cast("string"), 6, "0"), F.lpad((F.col("i") - F.col("i") % 3).cast("string"), 6, "0")
    wire = lambda mti, v: iso.build(F.lit(mti), field(v), "hybrid")["wire"]
    return rows.select("capture", wire("0200", old).alias("request"), wire("0210", old).alias("legacy"), wire("0210", new).alias("migrated"))


def test_shuffled_arrival_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rnd = random.Random(1)
    captures = {r["capture"]: r for r in wires(spark, 24).collect()}
    lacking = {"3": {"migrated"}, "4": {"request", "legacy"}, "5": {"legacy"}}
    events = [(k, x, r[x], rnd.randrange(100)) for k, r in captures.items() for x in legs.LEGS if x not in lacking.get(k, ())]
    events += [("7", "legacy", captures["8"]["legacy"], 150), ("9", "other", b"?", 20)]  # the first of two counts; an unknown leg is none
    rnd.shuffle(events)
    events.sort(key=lambda e: e[3] // 50)
    events += [("end", "request", b"x", 10_000), ("end", "request", b"x", 20_000)]  # time goes on
    size = -(-len(events) // 6)
    for k in range(0, len(events), size):
        part = spark.createDataFrame(events[k : k + size], "key string, leg string, wire binary, s int").select("key", "leg", "wire", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("time"))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("key string, leg string, wire binary, time timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in")
    found = legs.diff_of_legs(stream, "key", "leg", "wire", "time", SPEC, wait="20 minutes", late="5 minutes")
    query = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    assert query.awaitTermination(150)
    got = spark.read.parquet(f"{tmp_path}/out").where("capture != 'end'")
    whole = spark.createDataFrame([r for k, r in captures.items() if k not in lacking], "capture string, request binary, legacy binary, migrated binary")
    want = conf.check_wires(whole.withColumn("missing", F.lit(None).cast("string")), ["capture", "missing"], *legs.LEGS, SPEC)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, got.where("missing is null").collect())) == sorted(map(key, want.select(*got.columns).collect()))
    assert {(r["capture"], r["missing"], r["verdict"]) for r in got.where("missing is not null").collect()} == {("3", "migrated", "error"), ("4", "request,legacy", "error"), ("5", "legacy", "error")}
