"""The registered queries on small odd tables: columns, held-out rows, one row a document."""

import random
import zlib

import pytest

from paywire.llm import common, queries

COLUMNS = {
    "op1_token_file": "doc_id start n_tokens ids_crc32",
    "op2_url_reputation": "page_id host path rule verdict",
    "op3_hmm_score": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op5_pack": "doc_id piece start length ids_crc32 sequence_id offset",
    "op6_chat_format": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op7_language_id": "doc_id held_out lang_pred score",
    "op8_exact_dedup": "doc_id keep_id group_size kept text_sha256",
    "op9_near_dedup": "doc_id n_shingles component_id kept",
    "op10_quality": "doc_id held_out score predicted",
    "op11_merkle_manifest": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op12_knn_join": "query_id rank vec_id score",
    "op13_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}
HELD_OUT = {"op3_hmm_score": (5, 1), "op7_language_id": (4, 2), "op10_quality": (3, 1)}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at, rnd = str(tmp_path_factory.mktemp("tables")), random.Random(3)
    words = "the rain in spain falls der die das und le la les et mead hill".split()
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    rows = [(i, text(rnd.choice([1, 8, 40])), ["en", "de", "fr", None][i % 4], f"s{i % 3}", i) for i in range(60)]
    rows += [(60, None, "en", None, None), (61, "", "de", "s", 0), (62, rows[5][1], "en", "s", 1), (63, " \t", None, "s", 2)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, rows[3][1]), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, f"http://h{i % 5}.example.com/en/{i}" if i % 7 else None, "") for i in range(40)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    spark.createDataFrame([(c, t, ["user", "assistant"][t % 2], text(4) if c % 3 else None) for c in range(6) for t in range(4)], "conv_id long, turn long, role string, text string").write.parquet(f"{at}/conversations.parquet")
    spark.createDataFrame([(i, [rnd.gauss(0, 1) for _ in range(4)], 0) for i in range(130)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, tables, name, tmp_path):
    assert set(queries.QUERIES) == set(COLUMNS)
    shared = common.shared_dir(spark).removeprefix("file:")
    import os

    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    with common.scratch(spark):  # the handle: what a query wrote for itself goes with it
        queries.QUERIES[name](spark, tables).write.parquet(f"{tmp_path}/out")
    assert {x for x in set(os.listdir(shared)) - before if x.startswith("paywire")} == set()
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    rows = found.collect()
    if name in HELD_OUT:
        modulus, rest = HELD_OUT[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    if found.columns[0] == "doc_id" and name != "op5_pack":
        assert sorted(r["doc_id"] for r in rows) == list(range(64))
