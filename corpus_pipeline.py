"""The corpus pipeline: quality, exact and near duplicates, contamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again, and what a stage wrote for itself goes once its result is written.
All but the last return the columns of `documents`, whatever further ones it has.

Defined results: a NULL text is judged and packed as the empty text and is no near
copy of anything; of rows with one id and text a single one stays; an empty table
gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paywire.llm import common, decontaminate, exact_dedup, near_dedup, packing, quality

#: SQL can express neither the classifier nor the tokenizer.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.  It learns from the labels that the query op10_quality learns from."""
    labels = common.table(spark, sf_dir, "labels")
    net = quality.fit(docs, labels.where(common.id_bucket("doc_id", 3) != 1))
    return quality.keep_good(docs, net)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for runs of ASCII white space, the document with the smallest id stays; NULL counts as empty."""
    return exact_dedup.deduplicate(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Stages on shingles of five words join from a similarity of 0.8 on; the 0.85 of op9_near_dedup is that query's own."""
    return near_dedup.near_deduplicate(docs, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; the others stay as they are."""
    return decontaminate.remove_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a piece: its place in its document and in a sequence of at most 2,048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", decontamination_stage),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    with common.scratch(spark) as stages:
        for k, (_, stage) in enumerate(STAGES):
            with common.scratch(spark) as own:
                docs = common.saved(stage(spark, docs, sf_dir), f"stage{k}")
                own.keep_last()
        stages.keep_last()
    return docs
