"""Five stages that turn a table of documents into token ids.

Toxic documents go, exact copies go, one of each group of near copies stays,
sources are mixed to their target weights, and what is left is encoded.

All stages take null ids, texts, sources and labels, empty and very long texts,
repeated rows and empty tables; columns besides those they read travel along.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from docverify.llm import bpe, exact_dedup, mixing, simhash, toxicity
from docverify.plans.storage import written

#: Words in a shingle of the near-duplicate stage, and the Jaccard similarity from which documents link.
NEAR_WORDS = 5
NEAR_SIMILARITY = 0.8
#: Characters of text that a task of the last stage holds at a time.
BLOCK_CHARS = 2_000_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; models are fitted on the labelled training rows.

    A null or empty text scores as a text without a voter does, which is low.
    Without a toxic training row all documents stay.
    """
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of documents that are equal but for white space: the longest, then the smallest id.

    Null and blank texts are one group. Of rows that repeat an id and a text one stays.
    """
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near copies, found by positional bytes of a min-hash print (see the operator).

    Null and blank texts are one group; rows without an id stay; rows that
    share an id stay or go together.
    """
    return simhash.without_near_duplicates(docs, words=NEAR_WORDS, similarity=NEAR_SIMILARITY)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0, 1 or 2 times); a null source is a source of its own."""
    return mixing.apply_mix(docs, mixing.mix_sources(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each row of the mix: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text counts as empty."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), block_chars=BLOCK_CHARS, stored=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("simhash", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: The toxicity stage and the stages after it can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
