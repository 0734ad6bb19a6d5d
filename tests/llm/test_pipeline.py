"""run() over a small folder of tables against plain Python."""

import random

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from paywire.llm import decontaminate
from tests.llm.test_near_dedup import brute


def test_pipeline(spark, tmp_path):
    rnd = random.Random(9)
    sentence = lambda n: " ".join(rnd.choice("rain falls on the hills and mead where old men sing low songs of kings".split()) + rnd.choice(["", "ing", "ed"]) for _ in range(n))
    junk = lambda n: " ".join(rnd.choice(["BUY!!", "$$$", "WIN##", "CLICK||"]) for _ in range(n))
    items = [(i, sentence(20)) for i in range(3)]
    texts = [sentence(rnd.choice([8, 60, 300])) for _ in range(120)] + [junk(50) for _ in range(60)]
    texts += [texts[3], texts[3].replace(" ", "  ")]  # exact
    long = texts[5] + " " + sentence(200)
    texts += [long, long + " a few more words"]  # near
    dirty = [sentence(30) + ". " + items[1][1], items[2][1].upper()]
    texts += dirty + [sentence(600) + " " + items[0][1]]
    texts += [None, ""]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(not 120 <= i < 180), 0) for i in range(180)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    kept, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = kept.columns
        stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"{k}"))
        kept = spark.read.parquet(str(tmp_path / f"{k}"))
        assert kept.columns == before == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in kept.collect()})
    assert set(seen[0]) & set(range(180)) == set(range(120)), "the classifier"
    want, first = {}, set()
    for i, t in seen[0].items():
        want.setdefault(" ".join((t or "").split()), []).append(i)
    first = {min(v) for v in want.values()}
    assert set(seen[1]) == first and 180 not in seen[1]
    assert set(seen[2]) == {v[1] for v in brute(sorted(seen[1].items())).values()}
    words = {i: decontaminate.words_of(t) for i, t in seen[2].items()}
    bad = set()
    for i, w in words.items():
        hit = {k for _, t in items for v in [decontaminate.words_of(t)] for a in range(len(v) - 12) for b in range(len(w) - 12) if v[a : a + 13] == w[b : b + 13] for k in range(b, b + 13)}
        if hit and 20 * len(hit) >= len(w):
            bad.add(i)
    assert set(seen[3]) == set(seen[2]) - bad and len(bad) == 2
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    total = {}
    for r in packed:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: len(library.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in seen[3].items()}


def test_near_stage_joins_from_four_fifths(spark):
    """Copies with other words at the end: of s shingles t differ, which is a similarity of (s - t) / (s + t)."""
    texts, n = [], 0
    for s, t in [(90, 10), (180, 20), (180, 19), (180, 18), (360, 35), (360, 30), (90, 11), (180, 21), (900, 101)] * 3:
        words = [f"w{n}x{i}" for i in range(s + 4 + t)]
        texts += [" ".join(words[: s + 4]), " ".join(words[: s + 4 - t] + words[s + 4 :])]
        n += 1
    docs = list(enumerate(texts))
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "")
    got = {r["doc_id"] for r in kept.collect()}
    assert got == {v[1] for v in brute(docs, percent=80).values()} and len(got) == 36
    assert len({v[1] for v in brute(docs).values()}) == 54, "none of the pairs reaches 0.85"


def test_stages_on_odd_tables(spark, tmp_path):
    """Extra columns with names of the stages' own and with blanks, repeated rows, NULL ids, a very long text; then an empty table."""
    rows = [(1, "a plain text of some words that nobody else has", 0, "x"), (1, "a plain text of some words that nobody else has", 0, "x"), (None, "text without an id but with words", 1, "y"), (2, None, 2, "z"), (3, "word " * 60_000, 3, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, `my col` string").withColumn("score", F.lit("own score"))
    for name, df in (("labels", spark.createDataFrame([], "doc_id long, quality int, toxic int")), ("benchmark", spark.createDataFrame([], "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    for table, n in ((docs, 4), (docs.limit(0), 0)):
        kept = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            stage(spark, kept, str(tmp_path)).write.parquet(str(tmp_path / f"{n}-{k}"))
            kept = spark.read.schema(docs.schema).parquet(str(tmp_path / f"{n}-{k}"))
            assert kept.columns == docs.columns
        assert kept.count() == n
        packed = corpus_pipeline.packing_stage(spark, kept, str(tmp_path)).collect()
        assert len({(r["doc_id"], r["piece"]) for r in packed}) == len(packed) and len({r["doc_id"] for r in packed}) == n
