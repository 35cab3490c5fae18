"""A training-data pipeline of five stages over the documents table.

Each stage reads what its predecessor kept.  ``run`` applies all to ``documents``; in production each
result is written as Parquet and read again as the next stage's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from slotwise.llm.bpe import encode_documents, rank_file
from slotwise.llm.common import stored, table
from slotwise.llm.exact_dedup import deduplicated
from slotwise.llm.mixing import mixed
from slotwise.llm.near_dedup import near_deduplicated
from slotwise.llm.toxicity import not_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity score is below the threshold."""
    return not_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the document with the smallest id."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by 5-word similarity of 0.8 or more, the document with the smallest id."""
    return near_deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in target proportions: a text once for each time that it is taken, or its taken words."""
    return mixed(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of ids and of the decoded bytes."""
    return encode_documents(docs, rank_file(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: Toxicity, the mix and the tokens have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
    return docs
