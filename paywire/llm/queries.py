"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paywire.llm import chat, common, decontaminate, exact_dedup, hmm_lm, knn_join, langid, merkle, near_dedup, packing, periodic_runs, quality, token_ids, url_reputation

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_ids.write_token_file(common.table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return token_ids.read_token_file(spark, path)


URL_RULES = [
    url_reputation.Rule("block", "com", "/en/"),
    url_reputation.Rule("allow", "example.com", "/en/7"),
    url_reputation.Rule("allow", "net", "/de/"),
    url_reputation.Rule("block", "example.net", "/de/8"),
    url_reputation.Rule("block", "org", "/es/"),
]


@query
def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic labels name ids only: page n takes the outcome of label row n, bad where its quality is 0."""
    outcomes = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge_urls(common.table(spark, sf_dir, "pages"), outcomes, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "n_labelled")


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_hits(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"), ["doc_id"])
    n_hit = decontaminate.n_hit_words()
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        decontaminate.contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(common.table(spark, sf_dir, "documents"))


@query
def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_dedup.tagged(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return near_dedup.near_duplicate_report(rows, percent=85).drop("_tag")


@query
def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = common.id_bucket("doc_id", 4) == 2
    model = langid.fit(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    held_out = common.id_bucket("doc_id", 3) == 1
    net = quality.fit(docs, labels.where(~held_out))
    scored = quality.with_scores(docs.select("doc_id", "text"), net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and -7, whose texts look like template marks."""
    marks = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    messages = rows.select("conv_id", "turn", "role", chat.text_parts(F.coalesce("text", F.lit(""))).alias("content"))
    return chat.digests(chat.format_conversations(messages))


@query
def op3_hmm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score_documents(common.table(spark, sf_dir, "documents"), common.id_bucket("doc_id", 5) == 1)


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where 3 divides the id's crc32, the folded root starts from the leaf of the lower-cased text."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaves = merkle.document_leaves(common.table(spark, sf_dir, "documents"), "doc_id", "lang", ["doc_id", "source", "lang", "n_chars", "text"], tampered)
    text = lambda c: F.lower(F.hex(c)).alias(c)
    proof = merkle.proof_digest(F.col("siblings")).alias("proof_sha256")
    found = merkle.build(leaves).proofs("changed")
    return found.select(F.col("id").alias("doc_id"), text("leaf"), text("subroot"), text("root"), proof, text("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op12_knn_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the vectors whose id 100 divides, against all others."""
    rows = common.table(spark, sf_dir, "embeddings")
    found = knn_join.top_k(rows, F.col("vec_id") % 100 == 0, k=10, id_col="vec_id", vector_col="embedding", scale=1024)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In every tenth text (by the id's crc32) the words from a place on repeat a few of them."""
    found = periodic_runs.find_runs(common.table(spark, sf_dir, "documents").select("doc_id", "text"), repeat=periodic_runs.planted)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
