"""The queries of the operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docverify.llm import bpe, decontaminate, exact_dedup, image_copies, language, lm_score, mixing, prefix_trie, simhash, spelling, token_files, toxicity, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(_documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(_documents(spark, sf_dir))


def op3_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over pictures that Spark derives from every row of embeddings, which is the table with vectors for pixels."""
    return image_copies.image_copies(image_copies.images_of_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_duplicates(_documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), stored=True)


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return lm_score.score(_documents(spark, sf_dir), good)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv, turns = F.col("conv_id"), spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(turns, prefix_trie.rule_base(conv), prefix_trie.rule_head(conv)).drop("turn_conv", "turn_place")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mix": op1_source_mix,
    "op2_language": op2_language,
    "op3_image_copies": op3_image_copies,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_simhash": op5_simhash,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_lm_score": op7_lm_score,
    "op8_warc": op8_warc,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_decontaminate": op11_decontaminate,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op8_warc": warc.ORACLE,
    "op11_decontaminate": decontaminate.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
    "op13_spelling": spelling.ORACLE,
}
