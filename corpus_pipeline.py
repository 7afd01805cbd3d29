"""The corpus pipeline: quality rules, toxicity, near duplicates, mixing, encoding; each stage on all its predecessor kept.

Defined cases: a document with a null or empty text has too few words and goes in the first stage; very long texts pass all
stages whole; a null id is judged like any other, has no near duplicates and may be mixed; rows that repeat an id are each
judged, and one of them stays; equal texts are near duplicates, of which the least id stays; further columns, whatever
their names, come through all stages but the last, which has columns of its own; an empty table, or one of which nothing
is kept, gives an empty result. A stage's table is deleted when the next but one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import op3_bpe, op4_toxicity, op5_mixing, op6_parity_join, op10_quality
from ledgerline.llm.common import dropped, shared_folder, small_batches, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op10_quality.keep_documents(docs)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op6_parity_join.keep_one(docs, words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time the mix takes a document."""
    return op5_mixing.shards(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_bpe.tokenised(docs)


STAGES = [("quality rules", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_duplicates), ("mixing sources", mixing), ("byte-level BPE", encoding)]

#: Toxicity is a trained model and mixing draws by a seed, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = shared_folder(spark, "stage")
        with small_batches(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            dropped(spark, last)
        last = path
    return docs
