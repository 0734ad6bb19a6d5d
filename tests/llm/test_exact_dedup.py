import hashlib
import re

import pytest
from pyspark.sql import functions as F

from paywire.llm import blocks, exact_dedup

ROWS = [(4, "a  b"), (2, "a\tb"), (9, None), (7, ""), (8, "x"), (8, "x"), (3, "a b"), (None, "a b"), (5, "A b"), (6, "a\xa0b"), (11, "y" * 300_000), (10, "y" * 300_000)]


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("bounds", [{}, {"max_filter_bytes": 1}, {"bits_per_row": 1}])
def test_report(spark, bounds):
    docs = spark.createDataFrame([(*r, "s") for r in ROWS], "doc_id long, text string, digest string")
    found = exact_dedup.duplicate_report(docs, **bounds).collect()
    assert len(found) == len(ROWS)
    groups = {}
    for k, t in ROWS:
        groups.setdefault(normal(t), []).append(k)
    shas = {hashlib.sha256(t.encode()).hexdigest(): sorted(k, key=lambda x: (x is None, x or 0)) for t, k in groups.items()}
    for r in found:
        ids = shas[r["text_sha256"]]
        assert (r["keep_id"], r["group_size"]) == (ids[0], len(ids))
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in found) == len(shas)


@pytest.mark.parametrize("bounds", [{}, {"max_filter_bytes": 1}])
def test_deduplicate_keeps_whole_rows(spark, bounds):
    docs = spark.createDataFrame([(*r, f"s{r[0]}", i) for i, r in enumerate(ROWS)], "doc_id long, text string, row string, maybe int")
    found = exact_dedup.deduplicate(docs, **bounds)
    assert found.columns == docs.columns
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == [2, 5, 6, 7, 8, 10]
    assert all(r["row"] == f"s{r['doc_id']}" for r in rows)


def test_many_copies_and_empty_table(spark):
    many = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 'hot', concat('t', id)) as text")
    found = exact_dedup.duplicate_report(many)
    assert found.where("kept").count() == 2001
    assert found.where("group_size = 1000 and keep_id = 0").count() == 1000
    assert exact_dedup.duplicate_report(many.limit(0)).count() == 0
    assert exact_dedup.deduplicate(many.limit(0)).count() == 0


def test_filter_of_repeated_digests_only(spark):
    """A filter far over 1,024 bytes, in ranges of at most that: texts without a copy still pass straight through."""
    docs = spark.range(6000).selectExpr("id as doc_id", "concat('t', if(id < 80, id % 40, id)) as text")
    found = exact_dedup.deduplicate(docs, max_filter_bytes=1024)
    assert sorted(r["doc_id"] for r in found.collect()) == [*range(40), *range(80, 6000)]
    cut = exact_dedup.blocks_of(docs.select(docs.doc_id.alias("id"), exact_dedup.text_digest(docs.text).alias("digest")), 1000)
    assert exact_dedup.Filter(6000, 16, 1024).ranges == 12 and cut.count() > 1
    marked = exact_dedup.possibly_repeated(cut, max_filter_bytes=1024)
    maybe = {r["id"] for r in marked.where("maybe").collect()}
    assert marked.count() == 6000 and set(range(80)) <= maybe and len(maybe) < 80 + 200


def test_text_ids_ties_and_odd_names(spark):
    rows = [("b", "x  y", 1), ("b", "x y", 2), ("a", "z", 3), (None, "x\ty", 4), ("c", None, 5), ("d", "", 6)]
    docs = spark.createDataFrame(rows, "`my id` string, `my text` string, `a.b c` int")
    found = exact_dedup.deduplicate(docs, "my id", "my text")
    assert found.columns == docs.columns
    assert sorted(r["my id"] for r in found.collect()) == ["a", "b", "c"]
    report = {(r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.duplicate_report(docs, "my id", "my text").collect()}
    assert report == {("b", "b", 3), (None, "b", 3), ("a", "a", 1), ("c", "c", 2), ("d", "c", 2)}


def test_fewer_buckets_than_tasks(spark):
    """The session allows three buckets: tasks share them, and rows and messages still meet."""
    docs = spark.range(0, 9000, 1, 8).selectExpr("id as doc_id", "concat('t', id % 6000) as text")
    old = spark.conf.get("spark.sql.sources.bucketing.maxBuckets")
    spark.conf.set("spark.sql.sources.bucketing.maxBuckets", "3")
    try:
        rows = blocks.blocks_of(docs.select(docs.doc_id.alias("row")))
        assert rows.select("place").distinct().count() == 8
        found = exact_dedup.deduplicate(docs)
        assert sorted(r["doc_id"] for r in found.collect()) == list(range(6000))
        assert exact_dedup.duplicate_report(docs).where("kept").count() == 6000
    finally:
        spark.conf.set("spark.sql.sources.bucketing.maxBuckets", old)


def test_half_of_a_block_dropped(spark):
    docs = spark.range(0, 20_000, 1, 1).selectExpr("id as doc_id", "concat('t', id % 10000) as text")
    found = exact_dedup.deduplicate(docs)
    assert found.agg({"doc_id": "sum"}).first()[0] == sum(range(10_000)) and found.count() == 10_000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.count("Exchange") == 1  # the places move, the blocks don't


def test_messages_at_a_billion_rows(spark):
    """Blocks of 1,000 rows of a table of 10^9: a group of them sends each range one message, not one a row."""
    rows = spark.range(0, 40_000, 1, 1).select(F.col("id"), exact_dedup.text_digest(F.concat(F.lit("t"), "id")).alias("digest"))
    cut = blocks.blocks_of(rows, 1000)
    how = exact_dedup.Filter(10**9, 16, 8 << 20)
    assert how.ranges == 239 and cut.count() >= 4
    sent = exact_dedup.messages_to_ranges(cut, how).selectExpr("range", "group", "length(bits) as n").collect()
    assert len(sent) <= how.ranges and len({r["group"] for r in sent}) == 1
    assert sum(r["n"] for r in sent) >= 4 * 3 * 40_000
